"""Detection, evaluation, sampling and carry-forward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.blocks import Lane
from courtspark.operators import carry, detections, matching
from courtspark.plans import domain as D

QUERIES, ORACLE = {}, {}
MODELS = ["player", "court", "shot_classifier", "pose"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def eval_rows(spark, sf_dir):
    """Detections with the video of their image, and the image list."""
    video = F.when(F.col("image_id") % 2 == 0, "FinalF").otherwise("FinalM").alias("video")
    det = D.detections(spark, sf_dir).select("image_id", "model", "class_id", "conf", video)
    return D.images(spark, sf_dir).select("image_id", video), det


EVAL = """
im AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'FinalF' ELSE 'FinalM' END AS video FROM img),
ed AS (SELECT image_id, model, class_id, conf, CASE WHEN image_id % 2 = 0 THEN 'FinalF' ELSE 'FinalM' END AS video FROM det),
md AS (SELECT unnest(['player', 'court', 'shot_classifier', 'pose']) AS model),
q AS (SELECT md.model, t.video, t.images, coalesce(dets, 0) AS dets, coalesce(conf, 0) AS conf, coalesce(hit, 0) AS hit, coalesce(low, 0) AS low
  FROM (SELECT video, count(*) AS images FROM im GROUP BY video) t CROSS JOIN md
  LEFT JOIN (SELECT model, video, count(*) AS dets, sum(conf) AS conf, count(DISTINCT image_id) AS hit, count(*) FILTER (conf < 0.5) AS low FROM ed GROUP BY ALL) d
    ON d.model = md.model AND d.video = t.video),
ev AS (SELECT model, video, images, round_even(dets / CAST(images AS DOUBLE), 2) AS avg_dets, CASE WHEN dets > 0 THEN round_even(conf / dets, 4) ELSE 0 END AS avg_conf,
  round_even((images - hit) / CAST(images AS DOUBLE) * 100, 1) AS zero_det_pct, CASE WHEN dets > 0 THEN round_even(low / CAST(dets AS DOUBLE) * 100, 1) ELSE 0 END AS low_conf_pct FROM q)"""


@query(D.with_sql(D.DETS) + " SELECT match_id, frame, model, count(*) AS count, round_even(avg(conf), 4) AS avg_conf FROM det GROUP BY ALL")
def detection_frame_stats(spark, sf_dir):
    """A7."""
    return detections.frame_stats(D.detections(spark, sf_dir))


@query(D.with_sql(D.DETS, D.IMAGES, """
v AS (SELECT image_id // 5000 AS match_id, count(*) AS frames_analyzed, count(*) * 5e-2 AS elapsed_s FROM img GROUP BY ALL),
p AS (SELECT match_id, model, count(*) AS detections, round_even(avg(conf), 4) AS avg_conf FROM det GROUP BY ALL)""") + """
SELECT v.match_id, m.model, coalesce(detections, 0) AS detections, coalesce(avg_conf, 0) AS avg_conf, frames_analyzed, round_even(frames_analyzed / elapsed_s, 1) AS infer_fps
FROM v CROSS JOIN (SELECT unnest(['player', 'court', 'shot_classifier', 'pose']) AS model) m LEFT JOIN p ON p.match_id = v.match_id AND p.model = m.model""")
def detection_summary(spark, sf_dir):
    """A8."""
    videos = D.images(spark, sf_dir).groupBy(F.expr("image_id div 5000").alias("match_id")).agg(F.count("*").alias("frames_analyzed"), (F.count("*") * 0.05).alias("elapsed_s"))
    return detections.video_summary(D.detections(spark, sf_dir), videos, MODELS)


@query(D.with_sql(D.DETS) + """
SELECT match_id, coalesce(['Bandeja', 'Bola', 'Contrapared', 'Globo', 'Golpe de derecha', 'Golpe de reves', 'Remate', 'Salida de pared', 'Saque', 'Volea de derecha', 'Volea de reves'][class_id * 2 + 1], 'Unknown') AS label,
  count(*) AS shots FROM det WHERE model = 'shot_classifier' GROUP BY ALL""")
def shot_distribution(spark, sf_dir):
    """A9 (class ids doubled, so that some are unknown)."""
    return detections.shot_distribution(D.detections(spark, sf_dir).withColumn("class_id", F.col("class_id") * 2))


@query(D.with_sql(D.DETS, D.IMAGES, EVAL) + " SELECT * FROM ev")
def eval_detect(spark, sf_dir):
    """A10."""
    images, det = eval_rows(spark, sf_dir)
    return detections.evaluate(images, det, MODELS)


@query(D.with_sql(D.DETS, D.IMAGES, EVAL) + " SELECT model, video, class_id, count(*) AS detections FROM ed GROUP BY ALL")
def eval_classes(spark, sf_dir):
    """A10, class distribution."""
    return detections.class_distribution(eval_rows(spark, sf_dir)[1])


@query(D.with_sql(D.ANNS, """
v AS (SELECT CASE WHEN category_id < 4 THEN 'pose' ELSE 'pose_s' END AS model, CASE WHEN image_id % 2 = 0 THEN 'FinalF' ELSE 'FinalM' END AS video,
  len(kp) // 3 AS n, len([1 for i in range(3, len(kp) + 1, 3) if kp[i] > 5e-1]) AS s FROM annk)""") + """
SELECT model, video, sum(n) AS keypoints, round_even(sum(s) / CAST(sum(n) AS DOUBLE), 4) AS kpt_visibility FROM v GROUP BY ALL""")
def eval_pose(spark, sf_dir):
    """A11."""
    a = D.annotations(spark, sf_dir).select(
        F.expr("CASE WHEN category_id < 4 THEN 'pose' ELSE 'pose_s' END AS model"), F.expr("CASE WHEN image_id % 2 = 0 THEN 'FinalF' ELSE 'FinalM' END AS video"),
        # every third number, named one by one: generated code instead of an interpreted lambda for each
        F.slice(F.array(*[F.struct(F.get("keypoints", F.lit(i * 3 + 2)).alias("v")) for i in range(D.KEYPOINTS)]), 1, F.expr("CAST(size(keypoints) div 3 AS INT)")).alias("keypoints"),
    )
    return detections.keypoint_visibility(a)


@query(D.with_sql(D.DETS, D.IMAGES, EVAL) + """
SELECT a.model, round_even(abs(a.avg_conf - b.avg_conf), 4) AS conf_gap, round_even(abs(a.avg_dets - b.avg_dets), 2) AS det_gap,
  CASE WHEN abs(a.avg_conf - b.avg_conf) < 0.05 THEN 'good' WHEN abs(a.avg_conf - b.avg_conf) < 0.15 THEN 'moderate' ELSE 'poor' END AS assessment
FROM ev a JOIN ev b ON a.model = b.model AND a.video = 'FinalF' AND b.video = 'FinalM'""")
def eval_gap(spark, sf_dir):
    """A12."""
    return detections.cross_video_gap(eval_detect(spark, sf_dir), ("FinalF", "FinalM"))


@query(D.with_sql(D.DETS) + """
SELECT image_id, model, class_id, part, supp, round(avg(conf) OVER (PARTITION BY match_id, model ORDER BY frame, class_id, part, supp ROWS 99 PRECEDING), 9) AS rolling_conf FROM det""")
def rolling_confidence(spark, sf_dir):
    """W12."""
    lane = Lane(("match_id", "model"), "frame", ("class_id", "part", "supp"))
    out = detections.rolling_mean(D.detections(spark, sf_dir), lane, "conf", 100, "rolling_conf")
    return out.select("image_id", "model", "class_id", "part", "supp", F.round("rolling_conf", 9).alias("rolling_conf"))


@query(D.with_sql(D.DETS, """
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, model ORDER BY frame DESC, class_id DESC, part DESC, supp DESC) AS i FROM det),
l AS (SELECT DISTINCT match_id, model, frame, 5 + frame % 13 AS ms FROM det),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, model ORDER BY frame DESC) AS i FROM l),
t AS (SELECT match_id, model, count(*) AS total_detections, max(frame) AS last_frame FROM det GROUP BY ALL)""") + """
SELECT t.match_id, t.model, total_detections, last_frame, (SELECT count(*) FROM det d WHERE d.match_id = t.match_id AND d.model = t.model AND d.frame = last_frame) AS frame_detections,
  (SELECT round(avg(conf), 6) FROM r WHERE r.match_id = t.match_id AND r.model = t.model AND i <= 100) AS rolling_conf,
  (SELECT round(avg(ms), 6) FROM k WHERE k.match_id = t.match_id AND k.model = t.model AND i <= 30) AS rolling_ms FROM t""")
def model_counters(spark, sf_dir):
    """A25."""
    det = D.detections(spark, sf_dir)
    latency = det.groupBy("match_id", "model", "frame").agg(F.first(5 + F.col("frame") % 13).alias("ms"))
    out = detections.model_counters(det, latency, ["class_id", "part", "supp"])
    return out.withColumn("rolling_conf", F.round("rolling_conf", 6)).withColumn("rolling_ms", F.round("rolling_ms", 6))


@query(D.with_sql(D.DETS, "r AS (SELECT *, row_number() OVER (PARTITION BY image_id, model ORDER BY conf DESC, class_id, part, supp) AS i FROM det WHERE conf >= 0.35)") + """
SELECT image_id, model, class_id, part, supp, conf FROM r WHERE i = 1""")
def best_detection(spark, sf_dir):
    """T3."""
    det = D.detections(spark, sf_dir).select("image_id", "model", "class_id", "part", "supp", "conf")
    return matching.best_by(det, ["image_id", "model"], "conf", ["class_id", "part", "supp"], 0.35)


@query(D.with_sql(D.IMAGES, "n AS (SELECT image_id, video, row_number() OVER (PARTITION BY video ORDER BY image_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS c FROM img)") + """
SELECT image_id, video FROM n WHERE c <= 150 OR (i % (c // 150) = 0 AND i // (c // 150) < 150)""")
def even_sample(spark, sf_dir):
    """T5."""
    return detections.even_sample(D.images(spark, sf_dir).select("image_id", "video"), Lane(("video",), "image_id"), 150)


@query(D.with_sql(D.IMAGES, "n AS (SELECT image_id, video, file_name, row_number() OVER (PARTITION BY video ORDER BY md5('run7/' || video || '/' || file_name), file_name) AS sample_rank FROM img)") + """
SELECT image_id, video, file_name, sample_rank FROM n WHERE sample_rank <= 12""")
def seeded_sample(spark, sf_dir):
    """T6."""
    return detections.seeded_sample(D.images(spark, sf_dir).select("image_id", "video", "file_name"), "video", "file_name", 12, "run7")


@query(D.with_sql(D.PF) + " SELECT event_id, match_id, frame, slot FROM pf WHERE match_id = 3 AND frame BETWEEN 99 AND 199")
def frame_slice(spark, sf_dir):
    """Frames 100 to 200 of match 3, as a player scrubs to them."""
    return detections.frame_slice(D.player_frames(spark, sf_dir), 3, 100, 200).select("event_id", "match_id", "frame", "slot")


@query(D.with_sql(D.IMAGES, "n AS (SELECT image_id, video, row_number() OVER (PARTITION BY video ORDER BY image_id) AS i, count(*) OVER (PARTITION BY video) AS c FROM img)") + """
SELECT image_id, video, CASE WHEN i <= floor(c * 85e-2) THEN 'train' ELSE 'val' END AS split FROM n""")
def temporal_split(spark, sf_dir):
    """T9."""
    return detections.temporal_split(D.images(spark, sf_dir).select("image_id", "video"), Lane(("video",), "image_id"))


@query(D.with_sql(D.PF, """
c AS (SELECT match_id, frame, max(CASE WHEN frame % 60 = 0 AND slot = 2 AND event_type <> 'view' THEN x1 END) AS court_kx FROM pf GROUP BY ALL)""") + """
SELECT match_id, frame, last_value(court_kx IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame) AS court_kx FROM c""")
def locf_court(spark, sf_dir):
    """Court keypoints from every 60th frame, kept until the next good one."""
    seen = F.expr("CASE WHEN frame % 60 = 0 AND slot = 2 AND event_type <> 'view' THEN x1 END")
    rows = D.player_frames(spark, sf_dir).groupBy("match_id", "frame").agg(F.max(seen).alias("kx"))
    return carry.carry_forward(rows, Lane(("match_id",), "frame"), court_kx=F.col("kx")).select("match_id", "frame", "court_kx")


@query(D.with_sql(D.PF, """
s AS (SELECT match_id, slot, frame, CASE WHEN event_type <> 'click' THEN k END AS kp, frame % 3 = 0 AS own,
        frame - lag(frame) OVER (PARTITION BY match_id, slot ORDER BY frame) AS d FROM pf WHERE event_type <> 'signup'),
i AS (SELECT *, sum(CASE WHEN own OR d IS NULL OR d > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, slot ORDER BY frame) AS island FROM s),
f AS (SELECT match_id, slot, island, min_by(CASE WHEN own THEN kp ELSE -1 END, frame) FILTER (own OR d IS NULL OR d > 1) AS v,
        bool_or(own AND kp IS NULL) AS lost FROM i GROUP BY ALL)""") + """
SELECT i.match_id, i.slot, i.frame, CASE WHEN lost OR v = -1 THEN NULL ELSE v END AS carried FROM i JOIN f USING (match_id, slot, island)""")
def locf_pose(spark, sf_dir):
    """Players absent in sign-up frames, pose unmatched in click frames."""
    players = D.player_frames(spark, sf_dir).filter("event_type <> 'signup'").select("match_id", "slot", "frame", F.expr("CASE WHEN event_type <> 'click' THEN k END AS kp"))
    return carry.carry_pose(players, F.col("kp")).select("match_id", "slot", "frame", "carried")


@query(D.with_sql(D.PF, D.FRAMES, """
s AS (SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY frame) AS run FROM fr),
t AS (SELECT match_id, frame, seen, list(ball_x) FILTER (seen) OVER (PARTITION BY match_id, run ORDER BY frame ROWS 29 PRECEDING) AS xs FROM s)""") + """
SELECT match_id, frame, CASE WHEN seen THEN coalesce(xs, []) ELSE [] END AS trail_x FROM t""")
def ball_trail(spark, sf_dir):
    """W13."""
    out = carry.ball_trail(D.frames(spark, sf_dir))
    return out.select("match_id", "frame", F.transform("trail", lambda p: p["x"]).alias("trail_x"))


@query(D.with_sql(D.PF, D.FRAMES, """
an AS (SELECT match_id, frame, frame * 2e0 + frame % 5 * 3e-1 AS t FROM fr WHERE NOT seen),
ph AS (SELECT match_id, event_id AS playhead_id, frame * 2e0 + k * 3e-2 AS t FROM pf),
c AS (SELECT p.match_id, playhead_id, p.t, a.frame, abs(a.t - p.t) AS gap, row_number() OVER (PARTITION BY playhead_id ORDER BY abs(a.t - p.t), a.t) AS r
      FROM ph p JOIN an a ON a.match_id = p.match_id AND abs(a.t - p.t) <= 1)""") + """
SELECT ph.match_id, ph.playhead_id, ph.t, c.frame, round(c.gap, 6) AS gap FROM ph LEFT JOIN c ON c.playhead_id = ph.playhead_id AND r = 1""")
def nearest_frame(spark, sf_dir):
    """J8."""
    frames = D.frames(spark, sf_dir).filter("NOT seen").selectExpr("match_id", "frame", "frame * 2D + frame % 5 * 0.3D AS t")
    heads = D.player_frames(spark, sf_dir).selectExpr("match_id", "event_id AS playhead_id", "frame * 2D + k * 0.03D AS t")
    return carry.nearest_frame(heads, frames).withColumn("gap", F.round("gap", 6))


@query(D.with_sql(D.DETS, D.PF, D.FRAMES, """
bt AS (SELECT match_id, frame, ball_x / 1280 AS x, row_number() OVER (PARTITION BY match_id ORDER BY frame DESC) AS i FROM fr WHERE seen),
bl AS (SELECT match_id, list(x ORDER BY frame) AS trail_x FROM bt WHERE i <= 20 GROUP BY match_id),
hi AS (SELECT match_id, raw_id, count(*) AS hits FROM pf GROUP BY ALL),
pt AS (SELECT pf.match_id, slot, (x1 + x2) / 2560 AS cx, hits >= 20 AS confirmed FROM pf JOIN hi USING (match_id, raw_id)
       WHERE (pf.match_id, frame) IN (SELECT (match_id, max(frame)) FROM pf GROUP BY match_id)),
pl AS (SELECT match_id, list(slot ORDER BY slot) AS track_slots, list(cx ORDER BY slot) AS track_x, list(confirmed ORDER BY slot) AS track_confirmed FROM pt GROUP BY match_id),
ld AS (SELECT DISTINCT match_id, model, frame, 5 + frame % 13 AS ms FROM det WHERE model = 'player'),
lr AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame DESC) AS i FROM ld),
rt AS (SELECT match_id, round_even(1000 / avg(ms), 1) AS fps FROM lr WHERE i <= 30 GROUP BY match_id),
dm AS (SELECT match_id, count(DISTINCT model) AS models FROM det GROUP BY match_id)""") + """
SELECT match_id, coalesce(models, 0) AS models, coalesce(fps, 0) AS fps, coalesce(trail_x, []) AS trail_x, coalesce(track_slots, []) AS track_slots,
  coalesce(track_x, []) AS track_x, coalesce(track_confirmed, []) AS track_confirmed
FROM dm FULL JOIN rt USING (match_id) FULL JOIN bl USING (match_id) FULL JOIN pl USING (match_id)""")
def model_snapshot(spark, sf_dir):
    """A25, what a viewer polls: counters with the ball's trail and the players' tracks."""
    det = D.detections(spark, sf_dir)
    latency = det.groupBy("match_id", "model", "frame").agg(F.first(5 + F.col("frame") % 13).alias("ms"))
    counters = detections.model_counters(det, latency, ["class_id", "part", "supp"])
    balls = D.frames(spark, sf_dir).select("match_id", "frame", (F.col("ball_x") / 1280).alias("x"), (F.col("ball_y") / 720).alias("y"))
    pf = D.player_frames(spark, sf_dir).select("match_id", "frame", "slot", "raw_id", ((F.col("x1") + F.col("x2")) / 2560).alias("cx"), ((F.col("y1") + F.col("y2")) / 1440).alias("cy"))
    hits = pf.groupBy("match_id", "raw_id").agg((F.count("*") >= 20).alias("confirmed"))
    last = pf.groupBy("match_id").agg(F.max("frame").alias("frame"))
    tracks = pf.join(last, ["match_id", "frame"], "left_semi").join(hits, ["match_id", "raw_id"])
    s = detections.model_snapshot(counters, balls, tracks, "player")
    of = lambda c, f: F.transform(c, lambda x: x[f])
    return s.select(
        "match_id", F.size("models").cast("bigint").alias("models"), "fps", of("ball_trail", "x").alias("trail_x"),
        of("player_tracks", "slot").alias("track_slots"), of("player_tracks", "cx").alias("track_x"), of("player_tracks", "confirmed").alias("track_confirmed"),
    )
