"""Projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.functions import geometry as G
from courtspark.functions import labels as L
from courtspark.functions import text as X
from courtspark.operators import matching
from courtspark.plans import domain as D

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(D.with_sql(D.PF) + """
SELECT event_id,
  coalesce(court_x BETWEEN -5e-1 AND 10.5e0 AND court_y BETWEEN -5e-1 AND 20.5e0, false) AS in_play,
  NOT coalesce(court_x BETWEEN -5e-1 AND 10.5e0 AND court_y BETWEEN -5e-1 AND 20.5e0, false) AS is_out,
  CASE WHEN court_x IS NULL OR court_y IS NULL THEN NULL WHEN court_y < 10 THEN 0 ELSE 1 END AS half,
  coalesce(CASE WHEN court_y < 10 THEN court_y BETWEEN 6.95e0 AND 10e0 ELSE court_y BETWEEN 10e0 AND 13.05e0 END, false) AS service_box,
  coalesce(abs(court_y - 10) <= 1, false) AS near_net,
  coalesce(court_x BETWEEN -1 AND 11 AND court_y BETWEEN -1 AND 21, false) AS heat_valid
FROM pf""")
def court_zones(spark, sf_dir):
    """P4-P9 on every player position."""
    pf = D.player_frames(spark, sf_dir)
    half = G.court_half("court_x", "court_y")
    return pf.select(
        "event_id", G.in_play("court_x", "court_y").alias("in_play"), G.is_out("court_x", "court_y").alias("is_out"),
        half.alias("half"), G.in_service_box("court_y", half).alias("service_box"),
        G.near_net("court_y").alias("near_net"), G.valid_position("court_x", "court_y").alias("heat_valid"),
    )


H = "CASE WHEN match_id % 8 = 7 THEN NULL ELSE [1e-2, 2e-4, -1e0, 1e-4, 3e-2, -2e0, 1e-5, 2e-5, 1e0 + match_id * 1e-2] END"


@query(D.with_sql(D.PF, f"hh AS (SELECT event_id, (x1 + x2) / 2 AS fx, y2 AS fy, {H} AS h FROM pf)") + """
SELECT event_id, fx, fy, round((h[1]*fx + h[2]*fy + h[3]) / (h[7]*fx + h[8]*fy + h[9]), 6) AS court_x,
  round((h[4]*fx + h[5]*fy + h[6]) / (h[7]*fx + h[8]*fy + h[9]), 6) AS court_y
FROM hh""")
def homography_project(spark, sf_dir):
    """P2 feet point, J5 homography per match, P1 projection."""
    pf = D.player_frames(spark, sf_dir)
    h = F.expr("CASE WHEN match_id % 8 <> 7 THEN array(0.01D, 0.0002D, -1D, 0.0001D, 0.03D, -2D, 0.00001D, 0.00002D, 1D + match_id * 0.01D) END")
    feet = pf.select("event_id", G.feet_x("x1", "x2").alias("fx"), F.col("y2").alias("fy"), h.alias("h"))
    x, y = F.col("fx"), F.col("fy")
    return feet.select("event_id", "fx", "fy", F.round(G.project_x(F.col("h"), x, y), 6).alias("court_x"), F.round(G.project_y(F.col("h"), x, y), 6).alias("court_y"))


POSE = """
pose AS (SELECT match_id, frame, slot AS pose_idx, x1 + k % 60 AS x1, y1 + k % 9 AS y1, x2 + k % 60 AS x2, y2 + k % 9 AS y2
         FROM pf WHERE event_type <> 'view')"""
IOU = """CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN
  (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) /
  ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
   - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) ELSE 0 END"""


@query(D.with_sql(D.PF, POSE, f"""
pairs AS (SELECT a.match_id, a.frame, a.slot, b.pose_idx, {IOU} AS v FROM pf a JOIN pose b USING (match_id, frame)),
best AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame, slot ORDER BY v DESC, pose_idx) AS r FROM pairs)""") + """
SELECT pf.match_id, pf.frame, pf.slot, CASE WHEN v > 0.3 THEN pose_idx END AS pose_idx, CASE WHEN v > 0.3 THEN round(v, 6) END AS iou
FROM pf LEFT JOIN best b ON b.match_id = pf.match_id AND b.frame = pf.frame AND b.slot = pf.slot AND r = 1""")
def box_iou_best_match(spark, sf_dir):
    """J3 with P3: best pose box per player and frame."""
    pf = D.player_frames(spark, sf_dir)
    pose = pf.filter("event_type <> 'view'").selectExpr(
        "match_id", "frame", "slot AS pose_idx", "x1 + k % 60 AS x1", "y1 + k % 9 AS y1", "x2 + k % 60 AS x2", "y2 + k % 9 AS y2"
    )
    out = matching.best_pose_box(pf.select("match_id", "frame", "slot", "x1", "y1", "x2", "y2"), pose)
    return out.select("match_id", "frame", "slot", "pose_idx", F.round("iou", 6).alias("iou"))


@query(D.with_sql(D.PF, D.FRAMES, """
j AS (SELECT event_id, ball_x, ball_y, x1, y1, x2, y2, k % 4 AS mode,
       x1 + k % 50 AS lx, y1 + k % 40 AS ly, CASE WHEN k % 4 IN (0, 1) THEN 9e-1 ELSE 1e-1 END AS lv,
       x2 - k % 30 AS rx, y1 + k % 20 AS ry, CASE WHEN k % 4 IN (0, 2) THEN 3e-1 ELSE 2e-1 END AS rv
      FROM pf JOIN fr USING (match_id, frame) WHERE ball_x IS NOT NULL),
w AS (SELECT *, CASE WHEN mode = 3 OR lv < 0.3 THEN NULL ELSE sqrt((lx-ball_x)*(lx-ball_x) + (ly-ball_y)*(ly-ball_y)) END AS ld,
        CASE WHEN mode = 3 OR rv < 0.3 THEN NULL ELSE sqrt((rx-ball_x)*(rx-ball_x) + (ry-ball_y)*(ry-ball_y)) END AS rd FROM j)""") + """
SELECT event_id, CASE WHEN ld IS NOT NULL OR rd IS NOT NULL THEN least(coalesce(ld, 1e9), coalesce(rd, 1e9)) <= 80
  ELSE ball_x BETWEEN x1 - 60 AND x2 + 60 AND ball_y BETWEEN y1 - 100 AND y2 + 60 END AS contact
FROM w""")
def contact_detect(spark, sf_dir):
    """Ball contact by wrist, or by box when no wrist is visible."""
    pf = D.player_frames(spark, sf_dir)
    fr = D.frames(spark, sf_dir).filter("seen").select("match_id", "frame", "ball_x", "ball_y")
    blank = "named_struct('x', 0D, 'y', 0D, 'v', 0D)"
    keypoints = F.expr(
        f"CASE WHEN k % 4 <> 3 THEN transform(sequence(0, 16), i -> CASE i "
        "WHEN 9 THEN named_struct('x', x1 + k % 50, 'y', y1 + k % 40, 'v', CASE WHEN k % 4 IN (0, 1) THEN 0.9D ELSE 0.1D END) "
        f"WHEN 10 THEN named_struct('x', x2 - k % 30, 'y', y1 + k % 20, 'v', CASE WHEN k % 4 IN (0, 2) THEN 0.3D ELSE 0.2D END) ELSE {blank} END) END"
    )
    j = pf.withColumn("keypoints", keypoints).join(fr, ["match_id", "frame"])
    return j.select("event_id", G.is_contact("ball_x", "ball_y", "x1", "y1", "x2", "y2", F.col("keypoints")).alias("contact"))


@query(D.with_sql(D.PF, """
f AS (SELECT event_id, (x1 + x2) / 2 AS x, y2 AS y, y2 - y1 AS h FROM pf),
s AS (SELECT *, (700-200)*(y-150) - (160-150)*(x-200) AS s1, (1100-700)*(y-160) - (600-160)*(x-700) AS s2,
        (100-1100)*(y-600) - (620-600)*(x-1100) AS s3, (200-100)*(y-620) - (150-620)*(x-100) AS s4 FROM f)""") + """
SELECT event_id, (s1 >= 0 AND s2 >= 0 AND s3 >= 0 AND s4 >= 0) OR (s1 <= 0 AND s2 <= 0 AND s3 <= 0 AND s4 <= 0) AS inside,
  h BETWEEN 40 AND 300 AS good_height
FROM s""")
def court_polygon_filter(spark, sf_dir):
    """P10 box height and P11 feet inside a convex polygon."""
    pf = D.player_frames(spark, sf_dir)
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(200, 150), (700, 160), (1100, 600), (100, 620)]])
    return pf.select(
        "event_id", G.inside_polygon(G.feet_x("x1", "x2"), "y2", corners).alias("inside"), G.good_height("y1", "y2").alias("good_height")
    )


@query(D.with_sql(D.ANNS) + """
SELECT image_id, category_id, part, supp,
  round(greatest(0, least(1, (bx + bw / 2) / 1920)), 6) AS cx, round(greatest(0, least(1, (bt + bh / 2) / 1080)), 6) AS cy,
  round(greatest(0, least(1, bw / 1920)), 6) AS w, round(greatest(0, least(1, bh / 1080)), 6) AS h
FROM ann""")
def yolo_boxes(spark, sf_dir):
    """Pixel boxes to clamped normalised centre boxes."""
    a = D.annotations(spark, sf_dir)
    b = F.col("bbox")
    box = L.yolo_box(b[0], b[1], b[2], b[3], 1920, 1080)
    a = a.select("image_id", "category_id", "part", "supp", *box)
    return a.select("image_id", "category_id", "part", "supp", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query(D.with_sql(D.DETS, "n AS (SELECT image_id, class_id, part, supp, (bx - 300) / 1000 AS cx, bt / 1000 AS cy, bw / 500 AS w, bh / 500 AS h FROM det)") + """
SELECT image_id, class_id, part, supp, CAST(trunc((cx - w / 2) * 1280) AS INT) AS x1, CAST(trunc((cy - h / 2) * 720) AS INT) AS y1,
  CAST(trunc((cx + w / 2) * 1280) AS INT) AS x2, CAST(trunc((cy + h / 2) * 720) AS INT) AS y2
FROM n""")
def pixel_corners(spark, sf_dir):
    """Normalised centre boxes to pixel corners, truncated toward zero."""
    d = D.detections(spark, sf_dir).selectExpr("image_id", "class_id", "part", "supp", "(bx - 300) / 1000 AS cx", "bt / 1000 AS cy", "bw / 500 AS w", "bh / 500 AS h")
    return d.select("image_id", "class_id", "part", "supp", *L.pixel_corners("cx", "cy", "w", "h", 1280, 720))


@query(D.with_sql(D.DETS) + """
SELECT image_id, class_id, part, supp, round((bx - 20) / 5e-1, 6) AS x, round((bt - 140) / 5e-1, 6) AS y,
  [round((bx + 1 - 20) / 5e-1, 6), round((bt + 2 - 140) / 5e-1, 6), conf] AS kp
FROM det""")
def letterbox_undo(spark, sf_dir):
    """Model pixels back to source pixels, box corner and keypoints."""
    d = D.detections(spark, sf_dir).withColumn("kp", F.expr("array(named_struct('x', bx + 1, 'y', bt + 2, 'v', conf))"))
    kp = G.undo_letterbox_keypoints(F.col("kp"), 20.0, 140.0, 0.5)
    return d.select(
        "image_id", "class_id", "part", "supp",
        F.round(G.undo_letterbox("bx", 20.0, 0.5), 6).alias("x"), F.round(G.undo_letterbox("bt", 140.0, 0.5), 6).alias("y"), kp.alias("k"),
    ).select("image_id", "class_id", "part", "supp", "x", "y", F.array(F.round(F.col("k")[0]["x"], 6), F.round(F.col("k")[0]["y"], 6), F.col("k")[0]["v"]).alias("kp"))


@query("""
WITH raw AS (SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_discount * 10 AS obj,
  [l_tax * 10, (l_quantity % 10) / 10e0, l_discount * 5] AS scores FROM lineitem),
d AS (SELECT *, list_position(scores, list_max(scores)) - 1 AS c, list_max(scores) * obj AS conf FROM raw WHERE obj >= 0.15)
SELECT image_id, line, part, supp, CAST(c AS INT) AS class_id, round(conf, 6) AS conf FROM d WHERE conf >= 0.15 AND c IN (0, 1)""")
def decode_detections(spark, sf_dir):
    """Objectness gate, best class, score gate, class allow-list."""
    raw = D.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS image_id", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp", "l_discount * 10 AS obj",
        "array(l_tax * 10, (l_quantity % 10) / 10, l_discount * 5) AS scores",
    )
    out = matching.decode_rows(raw, "scores", "obj", classes=[0, 1])
    return out.select("image_id", "line", "part", "supp", "class_id", F.round("conf", 6).alias("conf"))


@query("""
WITH p AS (SELECT vec_id, label AS channel, list_max(embedding) AS mx, list_position(embedding, list_max(embedding)) - 1 AS pos FROM embeddings WHERE label < 8)
SELECT vec_id, channel, (pos % 8) / 8e0 AS x, (pos // 8) / 8e0 AS y, round_even(CAST(mx AS DOUBLE), 4) AS conf FROM p WHERE mx >= CAST(0.1 AS FLOAT)""")
def heatmap_peaks(spark, sf_dir):
    """Peak of each 8x8 map of the first eight channels."""
    maps = D.table(spark, sf_dir, "embeddings").filter("label < 8")
    peak = L.heatmap_peak(F.col("embedding"), 8, 8, 0.1)
    return maps.select("vec_id", F.col("label").alias("channel"), peak.alias("p")).filter("p IS NOT NULL").select("vec_id", "channel", "p.x", "p.y", "p.conf")


@query("""
SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), '^(.+?)(\\.[^.]+)?$', 1), '[^A-Za-z0-9.-]', '_', 'g'), '^[._]+|[._]+$', '', 'g')), ''), 'source')
  || '_' || substring(md5(url), 1, 8) AS source_id FROM pages""")
def source_ids(spark, sf_dir):
    """P20 on page addresses."""
    return D.table(spark, sf_dir, "pages").select("page_id", X.source_id("url").alias("source_id"))


@query(D.with_sql(D.IMAGES) + """
SELECT image_id, CAST(CASE WHEN o_orderstatus = 'P' THEN image_id - 1 ELSE CAST(regexp_extract(file_name, '(?i)frame_([0-9]+)', 1) AS BIGINT) END AS BIGINT) AS frame_no FROM img""")
def frame_index(spark, sf_dir):
    """Frame number from the file name, from the image id where the name has none."""
    name = F.when(F.col("o_orderstatus") == "P", F.lit("still.png")).otherwise(F.col("file_name"))
    return D.images(spark, sf_dir).select("image_id", X.frame_index(name, "image_id").alias("frame_no"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) * 60 + l_partkey % 60 ELSE l_suppkey % 24 * 3600 + CAST(l_quantity AS BIGINT) * 60 + l_partkey % 60 END AS seconds
FROM lineitem""")
def hms_seconds(spark, sf_dir):
    """Clock strings to seconds."""
    li = D.table(spark, sf_dir, "lineitem")
    clock = F.expr("concat(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE concat(l_suppkey % 24, ':') END, CAST(l_quantity AS BIGINT), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'))")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.hms_seconds(clock).alias("seconds"))


@query("""
WITH s AS (SELECT p_partkey, ['train_batch0', 'val_batch1_pred', 'val_batch1_labels', 'val_batch2', 'labels_correlogram', 'Results', 'PR_curve', 'weights'][p_size % 8 + 1] AS stem,
  p_size % 3 = 0 AS named, p_size * 300e0 AS age, p_size AS done, p_partkey % 40 AS total, p_partkey % 25 AS patience, p_partkey % 2 = 0 AS ckpt FROM part),
a AS (SELECT *, named OR age < 5400 AS active FROM s)
SELECT p_partkey, CASE WHEN stem LIKE 'train_batch%' THEN 'train' WHEN stem LIKE 'val_batch%' AND stem LIKE '%pred%' THEN 'predictions'
   WHEN stem LIKE 'val_batch%' AND stem LIKE '%label%' THEN 'val_labels' WHEN stem LIKE 'val_batch%' THEN 'val' WHEN stem LIKE 'labels%' THEN 'dataset'
   WHEN lower(stem) LIKE 'results%' OR lower(stem) LIKE 'pr_curve%' THEN 'chart' ELSE 'other' END AS category, active,
  CASE WHEN active THEN 'training' WHEN total > 0 AND done >= total THEN 'done' WHEN patience > 0 AND done >= patience AND ckpt THEN 'done'
   WHEN done > 0 THEN 'crashed' ELSE 'pending' END AS status
FROM a""")
def run_rules(spark, sf_dir):
    """Artifact category, run activity and status."""
    p = D.table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "element_at(array('train_batch0', 'val_batch1_pred', 'val_batch1_labels', 'val_batch2', 'labels_correlogram', 'Results', 'PR_curve', 'weights'), CAST(p_size % 8 + 1 AS INT)) AS stem",
        "'python train.py --task pose_s' AS proc", "CASE WHEN p_size % 3 = 0 THEN 'configs/pose_s.yaml' ELSE 'configs/bodypose.yaml' END AS data_cfg",
        "p_size * 300D AS age", "p_size AS done", "p_partkey % 40 AS total", "p_partkey % 25 AS patience", "p_partkey % 2 = 0 AS ckpt",
    )
    p = p.withColumn("active", X.run_active("proc", "data_cfg", "age"))
    return p.select("p_partkey", X.image_category("stem").alias("category"), "active", X.run_status("active", "done", "total", "patience", "ckpt").alias("status"))


@query(D.with_sql(D.PF) + """
SELECT event_id, frame % 60 = 0 AS court_due, true AS player_due, frame % 3 = 0 AS pose_due, round(frame / 30e0, 6) AS ts_default,
  round(frame / CASE WHEN k % 3 = 0 THEN 30e0 ELSE k % 3 * 25e0 END, 6) AS ts_fps
FROM pf""")
def cadence_and_time(spark, sf_dir):
    """P25 cadence and P26 seconds."""
    fps = F.expr("CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN NULL ELSE k % 3 * 25D END")
    return D.player_frames(spark, sf_dir).select(
        "event_id", X.cadence_due("frame", 60).alias("court_due"), X.cadence_due("frame", 1).alias("player_due"), X.cadence_due("frame", 3).alias("pose_due"),
        F.round(X.frame_seconds("frame"), 6).alias("ts_default"), F.round(X.frame_seconds("frame", fps), 6).alias("ts_fps"),
    )


@query(D.with_sql(D.ANNS) + """
SELECT image_id, category_id, part, supp,
  [round(kp[1] / 1920, 9), round(kp[2] / 1080, 9), kp[3], round(kp[49] / 1920, 9), round(kp[50] / 1080, 9), kp[51]] AS ends,
  round(list_sum([kp[i] for i in range(1, 52, 3)]) / 1920, 8) AS sum_x
FROM annk WHERE len(kp) = 51""")
def keypoint_triples(spark, sf_dir):
    """Flat keypoint arrays to normalised triples, other lengths rejected."""
    a = D.annotations(spark, sf_dir).filter("size(keypoints) = 51").withColumn("t", L.keypoint_triples(F.col("keypoints"), 1920, 1080))
    end = lambda i: [F.round(F.col("t")[i]["x"], 9), F.round(F.col("t")[i]["y"], 9), F.col("t")[i]["v"].cast("double")]
    return a.select(
        "image_id", "category_id", "part", "supp", F.array(*end(0), *end(16)).alias("ends"),
        F.round(F.aggregate("t", F.lit(0.0), lambda s, k: s + k["x"]), 8).alias("sum_x"),
    )


@query(D.with_sql(D.ANNS) + """
SELECT image_id, category_id, part, supp, CASE category_id WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 6 END AS class_id
FROM ann WHERE category_id BETWEEN 2 AND 7""")
def class_remap(spark, sf_dir):
    """External classes onto the combined set; unmapped classes dropped."""
    a = D.annotations(spark, sf_dir).withColumn("class_id", L.map_class(F.col("category_id"), L.EXTERNAL_TO_CLASS))
    return a.filter("class_id IS NOT NULL").select("image_id", "category_id", "part", "supp", "class_id")


@query(D.with_sql(D.PF) + """
SELECT match_id, slot, ['Player 1', 'Player 2', 'Player 3', 'Player 4'][slot] AS name, ['#3fb950', '#a371f7', '#f778ba', '#79c0ff'][slot] AS colour,
  [[80, 185, 63], [247, 113, 163], [186, 120, 247], [255, 192, 121]][slot] AS bgr, count(*) AS frames
FROM pf GROUP BY match_id, slot""")
def slot_display(spark, sf_dir):
    """Slot names and colours attached to per-slot counts."""
    counts = D.player_frames(spark, sf_dir).groupBy("match_id", "slot").agg(F.count("*").alias("frames"))
    return counts.join(F.broadcast(L.slot_dimension(spark)), "slot").select("match_id", "slot", "name", "colour", "bgr", "frames")


@query(D.with_sql(D.PF) + """
SELECT event_id, CASE WHEN k % 5 = 0 THEN 1 ELSE greatest(0, least(1, (k - 10) / 60e0)) END AS score FROM pf""")
def ball_normalize(spark, sf_dir):
    """Detection scores defaulted and clipped."""
    raw = F.expr("CASE WHEN k % 5 <> 0 THEN (k - 10) / 60D END")
    return D.player_frames(spark, sf_dir).select("event_id", L.normal_score(raw).alias("score"))


@query(D.with_sql(D.LOGS, r"""
c AS (SELECT run_no, line_no, regexp_replace(line, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g') AS line FROM lg),
m AS (SELECT run_no, line_no, string_split(trim(line), ' ') AS p FROM c WHERE line LIKE '%it/s%'),
l AS (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY line_no DESC) AS r FROM m)""") + r"""
SELECT run_no, line_no, CAST(string_split(p[1], '/')[1] AS INT) AS epoch, CAST(string_split(p[1], '/')[2] AS INT) AS total_epochs,
  CAST(string_split(p[12], '/')[1] AS BIGINT) AS batches_done, CAST(string_split(p[12], '/')[2] AS BIGINT) AS batches_total,
  CAST(replace(p[13], 'it/s', '') AS DOUBLE) AS it_per_s,
  CAST(string_split(string_split(p[14], '<')[1], ':')[1] AS BIGINT) * 60 + CAST(string_split(string_split(p[14], '<')[1], ':')[2] AS BIGINT) AS epoch_elapsed_sec,
  CAST(string_split(string_split(p[14], '<')[2], ':')[1] AS BIGINT) * 3600 + CAST(string_split(string_split(p[14], '<')[2], ':')[2] AS BIGINT) * 60
    + CAST(string_split(string_split(p[14], '<')[2], ':')[3] AS BIGINT) AS epoch_remaining_sec,
  round_even(CAST(string_split(p[12], '/')[1] AS BIGINT) / CAST(string_split(p[12], '/')[2] AS DOUBLE), 4) AS batch_progress
FROM l WHERE r = 1""")
def log_progress(spark, sf_dir):
    """The last progress line of each run's log."""
    from courtspark.operators import runs

    return runs.latest_progress(D.log_lines(spark, sf_dir), "run_no", "line_no", "line")
