"""Training-set preparation and training-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.functions import labels as L
from courtspark.operators import datasets, runs
from courtspark.plans import domain as D

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


NUM = """
im AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_no) AS i, count(*) OVER (PARTITION BY video) AS c FROM img)"""
SPLIT85 = "CASE WHEN i <= floor(c * 85e-2) THEN 'train' ELSE 'val' END"
SIX = "printf('%.6f', {})"


def line_sql(cls, cx, cy, w, h):
    return " || ' ' || ".join([cls, *[SIX.format(v) for v in (cx, cy, w, h)]])


def clamp_sql(v, floor="0"):
    return f"greatest({floor}, least(1, {v}))"


BOX = ("(bx + bw / 2) / 1920", "(bt + bh / 2) / 1080", "bw / 1920", "bh / 1080")


@query(D.with_sql(D.IMAGES, D.ANNS) + " SELECT img.image_id, video, frame_no, category_id, part, supp FROM img JOIN ann USING (image_id)")
def image_annotations(spark, sf_dir):
    """J1."""
    j = datasets.join_annotations(D.images(spark, sf_dir), D.annotations(spark, sf_dir))
    return j.select("image_id", "video", "frame_no", "category_id", "part", "supp")


@query(D.with_sql(D.IMAGES, D.ANNS, """
a AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_no) - 1 AS i FROM img WHERE image_id IN (SELECT image_id FROM ann))""") + f"""
SELECT CASE WHEN video = 'vid1' THEN 'val' ELSE 'train' END AS split, printf('%s_f%06d', video, frame_no) AS image,
  {line_sql("'0'", *[clamp_sql(v) for v in BOX])} AS line
FROM a JOIN ann USING (image_id) WHERE i % 6 = 0 AND {clamp_sql(BOX[2])} > 0.002 AND {clamp_sql(BOX[3])} > 0.002""")
def player_boxes(spark, sf_dir):
    """B1 with U3."""
    images = D.images(spark, sf_dir)
    split = images.select("video").distinct().withColumn("split", F.when(F.col("video") == "vid1", "val").otherwise("train"))
    return datasets.player_boxes(images, D.annotations(spark, sf_dir), split)


@query(D.with_sql(D.IMAGES, D.ANNS, NUM) + f"""
SELECT {SPLIT85} AS split, printf('%s_frame_%06d', video, frame_no) AS image, {line_sql("'0'", *BOX)} || ' ' ||
  list_aggregate([printf('%.6f %.6f %d', kp[j] / 1920, kp[j + 1] / 1080, CAST(kp[j + 2] AS INT)) for j in range(1, 50, 3)], 'string_agg', ' ') AS line
FROM im JOIN annk USING (image_id) WHERE len(kp) = 51""")
def pose_labels(spark, sf_dir):
    """B2."""
    return datasets.pose_labels(D.images(spark, sf_dir), D.annotations(spark, sf_dir))


EXT = """
lp AS (SELECT *, string_split(trim(line), ' ') AS p FROM lb),
lx AS (SELECT split, stem, CAST(p[1] AS INT) AS cls, array_to_string(p[2:], ' ') AS rest FROM lp WHERE len(p) >= 5)"""


@query(D.with_sql(D.IMAGES, D.ANNS, D.LABELS, NUM, EXT) + f"""
SELECT {SPLIT85} AS split, printf('%s_frame_%06d', video, frame_no) AS image, {line_sql("'0'", *BOX)} AS line
FROM im JOIN ann USING (image_id) WHERE frame_no % 5 = 0 AND category_id = 1
UNION ALL SELECT CASE split WHEN 'valid' THEN 'val' ELSE 'train' END, 'rf_' || stem, '0 ' || rest FROM lx""")
def ball_labels(spark, sf_dir):
    """B3 with U1."""
    return datasets.ball_labels(D.images(spark, sf_dir), D.annotations(spark, sf_dir), D.label_text(spark, sf_dir))


def ball_points(spark, sf_dir):
    j = datasets.join_annotations(D.images(spark, sf_dir), D.annotations(spark, sf_dir).filter("category_id = 1"))
    b = F.col("bbox")
    centre = F.struct((b[0] + b[2] / 2).alias("x"), (b[1] + b[3] / 2).alias("y"))
    last = j.groupBy("video", "frame_no").agg(F.max_by(centre, F.struct("part", "supp", "cents")).alias("p"))
    return last.select("video", "frame_no", "p.x", "p.y")


POINTS = """
pt AS (SELECT video, frame_no, arg_max(bx + bw / 2, (part, supp, cents)) AS x, arg_max(bt + bh / 2, (part, supp, cents)) AS y
       FROM img JOIN ann USING (image_id) WHERE category_id = 1 GROUP BY ALL),
ax AS (SELECT video, unnest(range(max(frame_no) + 1)) AS frame_no FROM pt GROUP BY video),
cf AS (SELECT video, frame_no, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS visible, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM ax LEFT JOIN pt USING (video, frame_no)),
ch AS (SELECT video, frame_no // 256 AS chunk, count(*) AS frames, sum(visible) AS visible FROM cf GROUP BY ALL),
nc AS (SELECT video, max(frame_no) // 256 + 1 AS n FROM cf GROUP BY video),
kc AS (SELECT ch.*, CASE WHEN chunk >= n - greatest(1, round_even(n * 15e-2, 0)) THEN 'val' ELSE 'train' END AS split
       FROM ch JOIN nc USING (video) WHERE frames >= 8 AND visible / CAST(frames AS DOUBLE) >= 5e-2)"""


@query(D.with_sql(D.IMAGES, D.ANNS, POINTS) + " SELECT * FROM cf")
def frame_completion(spark, sf_dir):
    """U2."""
    return datasets.complete_frames(ball_points(spark, sf_dir))


@query(D.with_sql(D.IMAGES, D.ANNS, POINTS) + " SELECT * FROM kc")
def rally_chunks(spark, sf_dir):
    """W14, A17, T9."""
    return datasets.rally_chunks(datasets.complete_frames(ball_points(spark, sf_dir)))


@query(D.with_sql(D.IMAGES, D.ANNS, POINTS) + """
SELECT split, printf('%s_r%04d', kc.video, chunk) AS rally_id, CAST(frame_no - chunk * 256 AS INT) AS "Frame", cf.visible AS "Visibility",
  CASE WHEN cf.visible = 1 THEN printf('%.2f', x) ELSE '0' END AS "X", CASE WHEN cf.visible = 1 THEN printf('%.2f', y) ELSE '0' END AS "Y"
FROM cf JOIN kc ON kc.video = cf.video AND kc.chunk = frame_no // 256""")
def trajectory_rows(spark, sf_dir):
    """B4 with K6's rows."""
    return datasets.trajectory_rows(ball_points(spark, sf_dir))


@query(D.with_sql(D.PF, D.FRAMES, """
n AS (SELECT match_id, frame, max(frame) OVER (PARTITION BY match_id) + 1 AS n FROM fr)""") + """
SELECT n.match_id, n.frame, w.s AS window_start, n.frame - w.s AS window_pos FROM n JOIN (SELECT unnest(range(0, 3000, 2)) AS s) w
  ON w.s <= n.frame AND n.frame < w.s + 8 AND w.s <= n - 8""")
def sliding_windows(spark, sf_dir):
    """Windows of 8 frames, 2 apart."""
    rows = D.frames(spark, sf_dir).select("match_id", "frame")
    return datasets.sliding_windows(rows, "match_id", "frame", 8, 2)


SEQ = """
sq AS (SELECT video, frame_no, category, frame_no - row_number() OVER (PARTITION BY video, category ORDER BY frame_no) AS g FROM sx WHERE has_shot),
sp AS (SELECT video, frame_no, category, min(frame_no) OVER (PARTITION BY video, category, g) AS seq_start,
         frame_no - min(frame_no) OVER (PARTITION BY video, category, g) AS seq_pos FROM sq)"""


@query(D.with_sql(D.IMAGES, D.SHOTCSV, SEQ) + " SELECT * FROM sp")
def sequence_groups(spark, sf_dir):
    """W10."""
    return datasets.shot_sequences(datasets.shot_rows(D.shot_csv(spark, sf_dir)))


@query(D.with_sql(D.IMAGES, D.SHOTCSV, SEQ) + " SELECT * FROM sp WHERE category = 'Dropshot' OR seq_pos % 3 = 0")
def sequence_subsample(spark, sf_dir):
    """W11."""
    return datasets.subsample(datasets.shot_sequences(datasets.shot_rows(D.shot_csv(spark, sf_dir))))


HITTER = """
sy AS (SELECT image_id, part, supp, cents, bx, bt, bw, bh,
    list_min([kp[j * 3 + 2] for j in [5, 6] if kp[j * 3 + 3] >= 2]) - list_min([kp[j * 3 + 2] for j in [9, 10] if kp[j * 3 + 3] >= 2]) AS swing,
    len([1 for j in range(17) if kp[j * 3 + 3] >= 2]) AS vis FROM annk WHERE len(kp) >= 51),
h1 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY swing DESC NULLS LAST, part, supp, cents) AS r1,
    row_number() OVER (PARTITION BY image_id ORDER BY vis DESC, part, supp, cents) AS r2, max(swing) OVER (PARTITION BY image_id) AS top FROM sy),
hi AS (SELECT * FROM h1 WHERE CASE WHEN top > 5 THEN r1 = 1 ELSE r2 = 1 END)"""


@query(D.with_sql(D.ANNS, HITTER) + " SELECT image_id, top AS swing, part, supp, cents FROM hi")
def hitter_choice(spark, sf_dir):
    """A16."""
    return datasets.hitters(D.annotations(spark, sf_dir), ["image_id"], ["part", "supp", "cents"]).drop("bbox")


@query(D.with_sql(D.IMAGES, D.SHOTCSV, D.ANNS, D.LABELS, SEQ, HITTER, EXT, f"""
pk AS (SELECT img.image_id, sp.video, sp.frame_no, CASE category WHEN 'Forehand' THEN 0 WHEN 'Smash' THEN 2 WHEN 'Dropshot' THEN 8 END AS cls
       FROM sp JOIN img ON img.video = sp.video AND img.frame_no = sp.frame_no WHERE (category = 'Dropshot' OR seq_pos % 3 = 0) AND category <> 'Unclear'),
bo AS (SELECT pk.*, {clamp_sql(BOX[0])} AS cx, {clamp_sql(BOX[1])} AS cy, {clamp_sql(BOX[2], "1e-3")} AS w, {clamp_sql(BOX[3], "1e-3")} AS h,
         row_number() OVER (PARTITION BY video ORDER BY frame_no) AS i, count(*) OVER (PARTITION BY video) AS c FROM pk JOIN hi USING (image_id))""") + f"""
SELECT {SPLIT85} AS split, printf('%s_frame_%06d', video, frame_no) AS image, {line_sql("CAST(cls AS VARCHAR)", "cx", "cy", "w", "h")} AS line FROM bo
UNION ALL SELECT CASE split WHEN 'valid' THEN 'val' ELSE 'train' END, 'rf_' || stem,
  CASE cls WHEN 0 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 6 WHEN 8 THEN 3 ELSE 4 END || ' ' || rest
FROM lx WHERE cls <> 1 AND split <> 'test'""")
def shot_labels(spark, sf_dir):
    """W10, W11, J2, A16, P15, T9, P28, U1."""
    return datasets.shot_labels(D.shot_csv(spark, sf_dir), D.images(spark, sf_dir), D.annotations(spark, sf_dir), D.label_text(spark, sf_dir), ["part", "supp", "cents"])


COURT = """
lk AS (SELECT *, row_number() OVER (PARTITION BY split, stem, kpt ORDER BY line_no DESC) AS r FROM lm WHERE kpt < 26),
lb2 AS (SELECT split, stem, min(cx - w / 2) AS l, max(cx + w / 2) AS r, min(cy - h / 2) AS t, max(cy + h / 2) AS b FROM lm WHERE kpt < 26 GROUP BY ALL),
ks AS (SELECT split, stem, string_agg(CASE WHEN kx IS NULL THEN '0.000000 0.000000 0' ELSE printf('%.6f %.6f %d', kx, ky, kv) END, ' ' ORDER BY i.kpt) AS kp
       FROM (SELECT split, stem, unnest(range(26)) AS kpt FROM lb2) i LEFT JOIN (SELECT * FROM lk WHERE r = 1) k USING (split, stem, kpt) GROUP BY split, stem)"""


@query(D.with_sql(D.LANDMARKS, COURT) + f"""
SELECT CASE split WHEN 'train' THEN 'train' ELSE 'val' END AS split, stem AS image, {line_sql("'0'", "(l + r) / 2", "(t + b) / 2", "r - l", "b - t")} || ' ' || kp AS line
FROM lb2 JOIN ks USING (split, stem)""")
def court_labels(spark, sf_dir):
    """B6 over A15."""
    return datasets.court_labels(D.landmark_text(spark, sf_dir))


def predictions(spark, sf_dir):
    d = D.detections(spark, sf_dir).selectExpr(
        "concat('vid', match_id) AS video", "frame AS frame_no", "conf", "class_id", "part", "supp", "(bx + bw / 2) / 1920 AS cx", "(bt + bh / 2) / 1080 AS cy", "bw / 1920 AS w", "bh / 1080 AS h"
    )
    return d


@query(D.with_sql(D.DETS, D.LANDMARKS, COURT, """
pr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, class_id, part, supp) AS r FROM det WHERE conf >= 0.5),
pb AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS i, count(*) OVER (PARTITION BY match_id) AS c FROM pr WHERE r = 1)""") + f"""
SELECT CASE WHEN i <= floor(c * 9e-1) THEN 'train' ELSE 'val' END AS split, printf('pseudo_vid%d_frame_%06d', match_id, frame) AS image, {line_sql("'0'", *BOX)} AS line FROM pb
UNION ALL SELECT CASE split WHEN 'train' THEN 'train' ELSE 'val' END, 'v1_' || stem, {line_sql("'0'", "(l + r) / 2", "(t + b) / 2", "r - l", "b - t")} || ' ' || kp
FROM lb2 JOIN ks USING (split, stem)""")
def pseudo_labels(spark, sf_dir):
    """T3, T9, U1."""
    return datasets.pseudo_labels(predictions(spark, sf_dir), court_labels(spark, sf_dir), ["class_id", "part", "supp"])


def _image_lists(spark, sf_dir):
    labels = D.label_text(spark, sf_dir)
    a = labels.select("split", "stem").distinct()
    b = D.landmark_text(spark, sf_dir)
    return a, labels.filter("line_no % 4 <> 3"), b.select("split", "stem").distinct(), b


@query(D.with_sql(D.LABELS, D.LANDMARKS, """
ll AS (SELECT split, stem, 'l ' || kpt AS line FROM lm)""") + """
SELECT CASE i.split WHEN 'train' THEN 'train' ELSE 'val' END AS split, 'web_' || i.stem AS image, l.line
FROM (SELECT DISTINCT split, stem FROM lb) i LEFT JOIN (SELECT * FROM lb WHERE line_no % 4 <> 3) l USING (split, stem)
UNION ALL SELECT CASE i.split WHEN 'train' THEN 'train' ELSE 'val' END, 'court_' || i.stem, l.line FROM (SELECT DISTINCT split, stem FROM lm) i LEFT JOIN ll l USING (split, stem)""")
def combined_set(spark, sf_dir):
    """U1 and left J12."""
    a, la, b, lb = _image_lists(spark, sf_dir)
    lb = lb.withColumn("line", F.concat(F.lit("l "), F.split("line", " ")[0]))
    return datasets.combined_set([("web", a, la), ("court", b, lb)], {"train": "train", "valid": "val", "test": "val"})


@query(D.with_sql(D.LABELS) + " SELECT DISTINCT split, stem FROM lb WHERE (split, stem) IN (SELECT (split, stem) FROM lb WHERE line_no % 4 = 3)")
def labelled_images(spark, sf_dir):
    """J12, semi."""
    labels = D.label_text(spark, sf_dir)
    return datasets.labelled_images(labels.select("split", "stem").distinct(), labels.filter("line_no % 4 = 3"))


@query(D.with_sql(D.LABELS, EXT) + """
SELECT CASE split WHEN 'valid' THEN 'val' ELSE 'train' END AS split, cls AS class_id, count(*) AS labels FROM lx WHERE cls <> 1
GROUP BY ROLLUP (1, 2)""")
def class_counts(spark, sf_dir):
    """A18."""
    lines = datasets.external_labels(D.label_text(spark, sf_dir), {"train": "train", "valid": "val", "test": "train"}, {c: c for c in range(11) if c != 1})
    return datasets.class_counts(lines)


@query(D.with_sql(D.ANNS, """
g AS (SELECT image_id, category_id, part, supp, bx / 1920 AS cx, bt / 1080 AS cy, bw / 1920 AS w, bh / 1080 AS h, kp FROM annk WHERE len(kp) = 51)""") + """
SELECT image_id, category_id, part, supp, CAST(trunc((cx - w / 2) * 960) AS INT) AS x1, CAST(trunc((cy - h / 2) * 540) AS INT) AS y1,
  CAST(trunc((cx + w / 2) * 960) AS INT) AS x2, CAST(trunc((cy + h / 2) * 540) AS INT) AS y2,
  len([1 for e in [[0,1],[0,2],[1,3],[2,4],[5,6],[5,7],[7,9],[6,8],[8,10],[5,11],[6,12],[11,12],[11,13],[13,15],[12,14],[14,16]] if kp[e[1]*3+3] > 0 AND kp[e[2]*3+3] > 0]) AS n_limbs,
  coalesce(list_sum([CAST(trunc(kp[e[1]*3+1] / 1920 * 960) AS BIGINT) + CAST(trunc(kp[e[2]*3+2] / 1080 * 540) AS BIGINT)
    for e in [[0,1],[0,2],[1,3],[2,4],[5,6],[5,7],[7,9],[6,8],[8,10],[5,11],[6,12],[11,12],[11,13],[13,15],[12,14],[14,16]] if kp[e[1]*3+3] > 0 AND kp[e[2]*3+3] > 0]), 0) AS limb_sum
FROM g""")
def sample_geometry(spark, sf_dir):
    """B9."""
    b = F.col("bbox")
    a = D.annotations(spark, sf_dir).filter("size(keypoints) = 51").withColumn("kp", L.keypoint_triples(F.col("keypoints"), 1920, 1080))
    a = a.select("image_id", "category_id", "part", "supp", "kp", (b[0] / 1920).alias("cx"), (b[1] / 1080).alias("cy"), (b[2] / 1920).alias("w"), (b[3] / 1080).alias("h"))
    g = datasets.sample_geometry(a, 960, 540)
    total = F.aggregate("limbs", F.lit(0).cast("bigint"), lambda s, e: s + e["x1"] + e["y2"])
    return g.select("image_id", "category_id", "part", "supp", "x1", "y1", "x2", "y2", F.size("limbs").alias("n_limbs"), total.alias("limb_sum"))


# --- training runs -------------------------------------------------------------------------------
def metrics(spark, sf_dir):
    return runs.read_metrics(D.run_metrics(spark, sf_dir), ["time", "map50"])


RUN = """
rn AS (SELECT run_id, epoch, try_cast(nullif(time, '') AS DOUBLE) AS time, try_cast(map50 AS DOUBLE) AS map50 FROM rm),
dl AS (SELECT * FROM (SELECT run_id, epoch, time - lag(time) OVER (PARTITION BY run_id ORDER BY epoch) AS delta FROM rn WHERE time IS NOT NULL) WHERE delta > 0),
me AS (SELECT run_id, list_sort(list(delta))[len(list(delta)) // 2 + 1] AS per_epoch FROM dl GROUP BY run_id),
la AS (SELECT run_id, max(epoch) AS epochs_done, arg_max((time, map50), epoch) AS l FROM rn GROUP BY run_id)"""


def run_info(spark, sf_dir):
    """Configuration of each run, keyed like the metrics."""
    return D.table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS run_id", "c_custkey * 10 AS total", "c_custkey % 7 * 1000 AS patience", "'python train.py --task building' AS proc",
        "concat('configs/', lower(c_mktsegment), '.yaml') AS data_cfg", "c_nationkey * 400D AS age_seconds", "c_custkey % 2 = 0 AS has_checkpoint", "CAST(c_acctbal AS BIGINT) AS dataset_total",
        "c_custkey % 3 = 0 AS active", "1.7e9D + c_custkey AS anchor",
    )


INFO = """
ri AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_custkey * 10 AS total, c_custkey % 7 * 1000 AS patience, lower(c_mktsegment) = 'building' OR c_nationkey * 400 < 5400 AS live,
  c_nationkey * 400e0 AS age_seconds, c_custkey % 2 = 0 AS ckpt, CAST(trunc(c_acctbal) AS BIGINT) AS dataset_total, c_custkey % 3 = 0 AS active, 17e8 + c_custkey AS anchor FROM customer)"""


@query(D.with_sql(D.RUNS, RUN) + " SELECT run_id, epoch, delta FROM dl")
def epoch_deltas(spark, sf_dir):
    """W8 over S8."""
    return runs.epoch_deltas(metrics(spark, sf_dir))


@query(D.with_sql(D.RUNS, RUN) + " SELECT * FROM me")
def epoch_median(spark, sf_dir):
    """A19."""
    return runs.upper_median(runs.epoch_deltas(metrics(spark, sf_dir)), "run_id", "delta", "per_epoch")


@query(D.with_sql(D.RUNS, RUN, INFO) + """
SELECT ri.run_id, live AS active, coalesce(epochs_done, 0) AS epochs_done, total AS epochs_total, l[2] AS last_map50, dataset_total, age_seconds,
  CASE WHEN total > 0 THEN round_even(coalesce(epochs_done, 0) / CAST(total AS DOUBLE), 3) ELSE 0 END AS progress,
  CASE WHEN live THEN 'training' WHEN total > 0 AND coalesce(epochs_done, 0) >= total THEN 'done' WHEN patience > 0 AND coalesce(epochs_done, 0) >= patience AND ckpt THEN 'done'
    WHEN coalesce(epochs_done, 0) > 0 THEN 'crashed' ELSE 'pending' END AS status
FROM ri LEFT JOIN la USING (run_id)""")
def run_status(spark, sf_dir):
    """A21 with P24."""
    return runs.run_list(metrics(spark, sf_dir), run_info(spark, sf_dir))


def live_progress(spark, sf_dir):
    p = runs.latest_progress(D.log_lines(spark, sf_dir), "run_no", "line_no", "line")
    return p.withColumn("run_id", F.col("run_no").cast("string"))


@query(D.with_sql(D.RUNS, RUN, INFO, D.LOGS, r"""
cl AS (SELECT run_no, line_no, string_split(trim(regexp_replace(line, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g')), ' ') AS p FROM lg WHERE line LIKE '%it/s%'),
pp AS (SELECT CAST(run_no AS VARCHAR) AS run_id, arg_max(p, line_no) AS p FROM cl GROUP BY run_no),
pv AS (SELECT run_id, CAST(string_split(p[1], '/')[1] AS INT) AS ep, round_even(CAST(string_split(p[12], '/')[1] AS BIGINT) / CAST(string_split(p[12], '/')[2] AS DOUBLE), 4) AS done,
  CAST(replace(p[13], 'it/s', '') AS DOUBLE) AS rate,
  CAST(string_split(string_split(p[14], '<')[2], ':')[1] AS BIGINT) * 3600 + CAST(string_split(string_split(p[14], '<')[2], ':')[2] AS BIGINT) * 60
    + CAST(string_split(string_split(p[14], '<')[2], ':')[3] AS BIGINT) AS lft FROM pp),
tj AS (SELECT la.run_id, epochs_done, total, active, anchor, per_epoch, l[1] AS last_time, CASE WHEN active THEN ep END AS ep, CASE WHEN active THEN done END AS done,
         CASE WHEN active THEN rate END AS rate, CASE WHEN active THEN lft END AS lft, greatest(total - epochs_done, 0) AS rest
       FROM la JOIN ri USING (run_id) LEFT JOIN me USING (run_id) LEFT JOIN pv USING (run_id)),
tt AS (SELECT *, nullif(CASE WHEN lft IS NOT NULL AND per_epoch > 0 THEN lft + per_epoch * greatest(rest - 1, 0) ELSE coalesce(per_epoch, 0) * rest END, 0) AS tot FROM tj)""") + """
SELECT run_id, epochs_done, total AS epochs_total, round_even(per_epoch, 1) AS per_epoch_sec, round_even(nullif(last_time, 0), 1) AS elapsed_sec,
  coalesce(ep, CASE WHEN active AND total > 0 THEN epochs_done + 1 END) AS current_epoch, done AS current_epoch_progress, lft AS current_epoch_remaining_sec,
  round_even(rate, 2) AS it_per_s, round_even(tot, 1) AS total_remaining_sec, CASE WHEN active THEN anchor + tot END AS eta_at FROM tt""")
def run_timing(spark, sf_dir):
    """A19 with the live progress line."""
    return runs.run_timing(metrics(spark, sf_dir), run_info(spark, sf_dir), live_progress(spark, sf_dir))


CLEAN = r"rtrim(regexp_replace(line, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g'))"


@query(D.with_sql(D.RUNS, RUN, INFO, D.LOGS, f"""
tl AS (SELECT CAST(run_no AS VARCHAR) AS run_id, {CLEAN} AS line, row_number() OVER (PARTITION BY run_no ORDER BY line_no DESC) AS r FROM lg),
ts AS (SELECT run_id, count(*) AS tail_lines, max(line) FILTER (r = 1) AS last_line FROM tl WHERE r <= 60 AND trim(line) <> '' GROUP BY run_id),
ds AS (SELECT lower(p_type) AS cfg, count(*) FILTER (p_size % 4 <> 0) AS train_count, count(*) FILTER (p_size % 4 = 0) AS val_count FROM part GROUP BY ALL),
rd AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, train_count, val_count FROM customer JOIN ds ON cfg = (SELECT min(lower(p_type)) FROM part WHERE p_partkey % 50 = c_custkey % 50))""") + """
SELECT rn.run_id, epoch // 1000 AS part, count(*) AS epochs, max(CASE WHEN ri.run_id IS NULL THEN NULL ELSE round_even(per_epoch, 1) END) AS per_epoch_sec,
  max((SELECT count(*) FROM supplier WHERE CAST(s_suppkey % 20 AS VARCHAR) = rn.run_id AND s_nationkey % 3 = 1)) AS charts,
  coalesce(max(train_count), 0) AS train_count, coalesce(max(val_count), 0) AS val_count, coalesce(max(train_count + val_count), 0) AS dataset_total,
  coalesce(max(tail_lines), 0) AS tail_lines, max(last_line) AS last_line
FROM rn LEFT JOIN me USING (run_id) LEFT JOIN ri ON ri.run_id = rn.run_id LEFT JOIN ts ON ts.run_id = rn.run_id LEFT JOIN rd ON rd.run_id = rn.run_id GROUP BY ALL""")
def run_detail(spark, sf_dir):
    """A26, with the documents reduced to what SQL can state."""
    d = _run_documents(spark, sf_dir)
    charts = F.coalesce(F.try_element_at("artifacts", F.lit("chart")), F.lit(0))
    tail = [F.size("log_tail").alias("tail_lines"), F.try_element_at("log_tail", F.lit(-1)).alias("last_line")]
    return d.select("run_id", "part", F.size("series").alias("epochs"), "per_epoch_sec", charts.alias("charts"), "train_count", "val_count", "dataset_total", *tail)


def _run_documents(spark, sf_dir):
    """Images stand in a train and a val folder per part type; a run uses the first type among the parts of its number."""
    rows = metrics(spark, sf_dir)
    artifacts = D.table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey % 20 AS STRING) AS run_id", "concat(CASE s_nationkey % 3 WHEN 0 THEN 'train_batch' WHEN 1 THEN 'results' ELSE 'val_batch' END, s_suppkey) AS stem")
    part = D.table(spark, sf_dir, "part")
    files = part.selectExpr("concat(lower(p_type), CASE WHEN p_size % 4 = 0 THEN '/val' ELSE '/train' END) AS folder")
    sets = part.selectExpr("lower(p_type) AS data_cfg", "concat(lower(p_type), '/train') AS train", "concat(lower(p_type), '/val') AS val").distinct()
    used = part.groupBy(F.expr("p_partkey % 50").alias("no")).agg(F.min(F.lower("p_type")).alias("data_cfg"))
    run_sets = D.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS run_id", "c_custkey % 50 AS no").join(used, "no").join(runs.dataset_counts(sets, files), "data_cfg")
    tails = runs.log_tail(D.log_lines(spark, sf_dir), "run_no", "line_no", "line", 60).withColumn("run_id", F.col("run_no").cast("string"))
    return runs.run_detail(rows, runs.run_timing(rows, run_info(spark, sf_dir)), artifacts, datasets=run_sets, tails=tails)


PLANS = """
pc AS (SELECT lower(replace(p_type, ' ', '_')) || '_' || p_size AS stem, max(p_name) AS base, count(*) AS epochs, max(p_size) AS batch, CAST(min(p_partkey) * 32 AS VARCHAR) AS imgsz, sum(p_partkey) AS dataset_total FROM part GROUP BY 1),
pm AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) || '_' || p_size || '_best.pt' AS output_model FROM part WHERE p_retailprice % 100 < 3),
pa AS (SELECT stem AS id, stem AS label, base, epochs, batch, imgsz, stem || '_best.pt' AS output_model, true AS is_yolo, dataset_total FROM pc
  UNION ALL SELECT 'ball', 'Ball Tracking (TrackNetV3)', 'TrackNetV3 (shuttlecock pretrained)', 30, 8, '288×512', 'ball_best.pt', false, 264),
pl AS (SELECT pa.*, pm.output_model IS NOT NULL AS model_exists,
    CASE WHEN pm.output_model IS NOT NULL THEN 'done' WHEN is_yolo AND contains('train --task economy_11', '--task ' || id) THEN 'running' ELSE 'queued' END AS status
  FROM pa LEFT JOIN pm ON pm.output_model = pa.output_model)"""


@query(D.with_sql(PLANS) + " SELECT *, CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END AS status_rank FROM pl")
def planned_list(spark, sf_dir):
    """J14, T1."""
    stem = "concat(lower(replace(p_type, ' ', '_')), '_', p_size)"
    part = D.table(spark, sf_dir, "part")
    configs = part.groupBy(F.expr(stem).alias("stem")).agg(
        F.max("p_name").alias("base"), F.count("*").alias("epochs"), F.max("p_size").alias("batch"), (F.min("p_partkey") * 32).alias("imgsz"), F.sum("p_partkey").alias("dataset_total")
    )
    models = part.filter("p_retailprice % 100 < 3").select(F.expr(f"concat({stem}, '_best.pt')").alias("file_name"))
    return runs.planned_list(configs, models, "train --task economy_11")


@query(D.with_sql(D.RUNS, RUN, INFO, PLANS, """
rs AS (SELECT ri.run_id, live AS active, age_seconds, coalesce(epochs_done, 0) AS epochs_done, l[2] AS last_map50,
    CASE WHEN live THEN 'training' WHEN total > 0 AND coalesce(epochs_done, 0) >= total THEN 'done' WHEN patience > 0 AND coalesce(epochs_done, 0) >= patience AND ckpt THEN 'done'
      WHEN coalesce(epochs_done, 0) > 0 THEN 'crashed' ELSE 'pending' END AS status FROM ri LEFT JOIN la USING (run_id)),
ar AS (SELECT * FROM rs WHERE active ORDER BY age_seconds, run_id LIMIT 1)""") + """
SELECT true AS training_running, count(*) AS runs, count(*) FILTER (status = 'training') AS runs_training, count(*) FILTER (status = 'done') AS runs_done,
  count(*) FILTER (status = 'crashed') AS runs_crashed, count(*) FILTER (status = 'pending') AS runs_pending,
  (SELECT run_id FROM ar) AS active_run, (SELECT epochs_done FROM ar) AS active_epochs, (SELECT last_map50 FROM ar) AS active_map50,
  (SELECT count(*) FROM pl) AS planned, (SELECT count(*) FROM pl WHERE status = 'running') AS planned_running, (SELECT count(*) FROM pl WHERE status = 'queued') AS planned_queued,
  (SELECT count(*) FROM pl WHERE status = 'done') AS planned_done FROM rs""")
def run_overview(spark, sf_dir):
    """A21, the dashboard's head."""
    o = runs.overview(run_status(spark, sf_dir), planned_list(spark, sf_dir), "train --task economy_11").withColumnRenamed("active_run", "a")
    return o.select(*[c for c in o.columns if c not in ("process", "a")], F.col("a.run_id").alias("active_run"), F.col("a.epochs_done").alias("active_epochs"), F.col("a.last_map50").alias("active_map50"))


@query(D.with_sql(D.LOGS, r"""
t AS (SELECT *, row_number() OVER (PARTITION BY run_no ORDER BY line_no DESC) AS r FROM lg)""") + r"""
SELECT run_no, line_no, rtrim(regexp_replace(line, chr(27) || '\[[0-9;]*[A-Za-z]', '', 'g')) AS line FROM t WHERE r <= 15""")
def log_tail(spark, sf_dir):
    """S11."""
    return runs.log_tail(D.log_lines(spark, sf_dir), "run_no", "line_no", "line", 15)
