"""Court-domain tables derived from the supplied tables, once for Spark and once as DuckDB SQL.

Everything but ``frames`` and ``lifecycle`` is a plain projection: ``event_id`` is dense and
ordered by time, so match, frame and slot follow from it by arithmetic, with no shuffle.
Eight matches run side by side for 2,500 frames, then eight new ones start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOT_TYPES = ["drive", "lob", "smash", "volley", "serve", "bandeja"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def player_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    e = e.selectExpr(
        "(event_id div 80000) * 8 + (event_id div 4) % 8 AS match_id",
        "(event_id % 80000) div 32 AS frame",
        "CAST(event_id % 4 + 1 AS INT) AS slot",
        "event_id", "event_type", "k", "value",
    )
    return e.selectExpr(
        "*",
        "CASE WHEN event_type <> 'signup' THEN value % 10D END AS court_x",
        "CASE WHEN event_type <> 'signup' THEN k * 0.2D END AS court_y",
        "frame * 7D + k % 6 AS t_sec",
        "event_type = 'error' AS outside_court",
        "slot * 250D + frame % 100 + value % 5D AS x1",
        "slot * 100D + k % 7 AS y1",
        "slot * 250D + frame % 100 + value % 5D + 40 + k % 5 AS x2",
        "slot * 100D + k % 7 + CASE WHEN k % 10 = 0 THEN 30D ELSE 100D + (k % 5) * 10 END AS y2",
        "slot * 1000 + frame div 40 AS raw_id",
        "k / 100D AS conf",
    )


PF = """
pf0 AS (
  SELECT (event_id // 80000) * 8 + (event_id // 4) % 8 AS match_id, (event_id % 80000) // 32 AS frame,
         CAST(event_id % 4 + 1 AS INT) AS slot, event_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
pf AS (
  SELECT *,
    CASE WHEN event_type <> 'signup' THEN value % 1e1 END AS court_x,
    CASE WHEN event_type <> 'signup' THEN k * 2e-1 END AS court_y,
    frame * 7e0 + k % 6 AS t_sec,
    event_type = 'error' AS outside_court,
    slot * 250e0 + frame % 100 + value % 5e0 AS x1,
    slot * 100e0 + k % 7 AS y1,
    slot * 250e0 + frame % 100 + value % 5e0 + 40 + k % 5 AS x2,
    slot * 100e0 + k % 7 + CASE WHEN k % 10 = 0 THEN 30e0 ELSE 100e0 + (k % 5) * 10 END AS y2,
    slot * 1000 + frame // 40 AS raw_id,
    k / 100e0 AS conf
  FROM pf0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per analysed frame with the ball point, if any, in pixels."""
    ball = F.expr("slot = 1 AND event_type = 'click'")
    return (
        player_frames(spark, sf_dir)
        .groupBy("match_id", "frame")
        .agg(F.max(F.when(ball, F.col("x1") + F.col("k") * 5)).alias("ball_x"), F.max(F.when(ball, F.col("y1") + F.col("k"))).alias("ball_y"), F.max("t_sec").alias("t_sec"))
        .withColumn("seen", F.col("ball_x").isNotNull())
    )


FRAMES = """
fr AS (
  SELECT match_id, frame,
    max(CASE WHEN slot = 1 AND event_type = 'click' THEN x1 + k * 5 END) AS ball_x,
    max(CASE WHEN slot = 1 AND event_type = 'click' THEN y1 + k END) AS ball_y,
    max(t_sec) AS t_sec,
    max(CASE WHEN slot = 1 AND event_type = 'click' THEN x1 + k * 5 END) IS NOT NULL AS seen
  FROM pf GROUP BY match_id, frame)"""


def shot_type(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SHOT_TYPES]), (k % 6 + 1).cast("int"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier output: one row per attributed shot; ``ord`` is the position in the frame's list."""
    pf = player_frames(spark, sf_dir).filter("event_type = 'purchase'")
    return pf.select("match_id", "frame", F.col("slot").alias("ord"), "slot", shot_type(F.col("k")).alias("shot_type"))


SHOTS = (
    "\nsh AS (SELECT match_id, frame, slot AS ord, slot, CASE k % 6 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SHOT_TYPES))
    + " END AS shot_type FROM pf WHERE event_type = 'purchase')"
)


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match commands. Odd matches also get an automatic start; every fourth is reset and started again."""
    last = player_frames(spark, sf_dir).groupBy("match_id").agg(F.max("frame").alias("top"))
    steps = F.array(
        F.when(F.col("match_id") % 2 == 1, F.struct(F.lit(6).cast("bigint").alias("frame"), F.lit("auto").alias("action"))),
        F.when(F.col("match_id") % 4 == 3, F.struct(F.lit(8).cast("bigint").alias("frame"), F.lit("reset").alias("action"))),
        F.struct(F.lit(10).cast("bigint").alias("frame"), F.lit("start").alias("action")),
        F.struct((F.col("top") - 5).alias("frame"), F.lit("end").alias("action")),
    )
    return last.select("match_id", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("match_id", "s.frame", "s.action")


LIFECYCLE = """
top AS (SELECT match_id, max(frame) AS top FROM pf GROUP BY match_id),
lc AS (
  SELECT match_id, CAST(6 AS BIGINT) AS frame, 'auto' AS action FROM top WHERE match_id % 2 = 1
  UNION ALL SELECT match_id, 8, 'reset' FROM top WHERE match_id % 4 = 3
  UNION ALL SELECT match_id, 10, 'start' FROM top
  UNION ALL SELECT match_id, top - 5, 'end' FROM top)"""


def ball_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate ball points: a drifting ball seen well or badly, and clutter."""
    return player_frames(spark, sf_dir).filter("event_type IN ('click', 'view', 'error')").selectExpr(
        "match_id", "frame", "slot AS det_idx",
        "CASE WHEN event_type = 'error' THEN (value * 20) % 1280D ELSE 100D + (frame % 500) * 2 + value % 3D END AS x",
        "CASE WHEN event_type = 'error' THEN k * 7D ELSE 200D + k % 5 END AS y",
        "CASE event_type WHEN 'click' THEN 0.3D + k / 200D WHEN 'view' THEN k / 400D ELSE k / 100D END AS score",
    )


BALLS = """
bd AS (
  SELECT match_id, frame, slot AS det_idx,
    CASE WHEN event_type = 'error' THEN (value * 20) % 1280e0 ELSE 100e0 + (frame % 500) * 2 + value % 3e0 END AS x,
    CASE WHEN event_type = 'error' THEN k * 7e0 ELSE 200e0 + k % 5 END AS y,
    CASE event_type WHEN 'click' THEN 3e-1 + k / 200e0 WHEN 'view' THEN k / 400e0 ELSE k / 100e0 END AS score
  FROM pf WHERE event_type IN ('click', 'view', 'error'))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output rows; ``(class_id, part, supp)`` orders the rows of one frame."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_linestatus AS video", "l_orderkey div 5000 AS match_id", "l_orderkey % 5000 AS frame", "l_orderkey AS image_id",
        "CASE l_returnflag WHEN 'A' THEN 'player' WHEN 'N' THEN 'court' ELSE 'shot_classifier' END AS model",
        "CAST(l_linenumber AS INT) AS class_id", "round(l_discount * 10, 2) AS conf",
        "l_partkey AS part", "l_suppkey AS supp",
        "l_quantity * 20 AS bx", "l_partkey % 700 * 1D AS bt", "20D + l_suppkey % 300 AS bw", "40D + l_partkey % 200 AS bh",
    )


DETS = """
det AS (
  SELECT l_linestatus AS video, l_orderkey // 5000 AS match_id, l_orderkey % 5000 AS frame, l_orderkey AS image_id,
    CASE l_returnflag WHEN 'A' THEN 'player' WHEN 'N' THEN 'court' ELSE 'shot_classifier' END AS model,
    CAST(l_linenumber AS INT) AS class_id, round(l_discount * 10, 2) AS conf,
    l_partkey AS part, l_suppkey AS supp,
    l_quantity * 20 AS bx, l_partkey % 700 * 1e0 AS bt, 20e0 + l_suppkey % 300 AS bw, 40e0 + l_partkey % 200 AS bh
  FROM lineitem)"""


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tracklet per embedding vector, 64 tracklets per match."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 64 AS match_id", "vec_id AS track_id", "(vec_id * 37) % 1000 AS frame_min",
        "(vec_id * 37) % 1000 + 8 + vec_id % 60 AS frame_max",
        "(label % 5) * 0.2D + 0.1D AS mean_fx", "(vec_id % 10) * 0.1D AS mean_fy", "embedding",
    )


TRACKLETS = """
tr AS (
  SELECT vec_id // 64 AS match_id, vec_id AS track_id, (vec_id * 37) % 1000 AS frame_min,
    (vec_id * 37) % 1000 + 8 + vec_id % 60 AS frame_max,
    (label % 5) * 2e-1 + 1e-1 AS mean_fx, (vec_id % 10) * 1e-1 AS mean_fy, embedding
  FROM embeddings)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated images: 5,000 frames per video."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS image_id", "concat('vid', o_orderkey div 5000) AS video",
        "concat('frame_', lpad(CAST(o_orderkey % 5000 AS STRING), 6, '0'), '.PNG') AS file_name",
        "1920 AS width", "1080 AS height",
        "o_orderstatus", "o_orderpriority", "o_totalprice",
    )


IMAGES = """
img AS (
  SELECT o_orderkey AS image_id, 'vid' || CAST(o_orderkey // 5000 AS VARCHAR) AS video,
    'frame_' || lpad(CAST(o_orderkey % 5000 AS VARCHAR), 6, '0') || '.PNG' AS file_name,
    o_orderkey % 5000 AS frame_no, 1920 AS width, 1080 AS height,
    o_orderstatus, o_orderpriority, o_totalprice
  FROM orders)"""


#: Keypoints of an annotation at most, three numbers each.
KEYPOINTS = 17


def made_keypoints():
    """Flat keypoint arrays of a batch of rows at once. Called non-deterministic so that a filter over the arrays doesn't make them a second time."""

    def made(cents, category):
        import numpy as np
        import pyarrow as pa

        i = np.arange(KEYPOINTS * 3)
        step, size = np.array([31, 17, 1])[i % 3], np.array([1920, 1080, 3])[i % 3]
        values = np.fmod(cents.fill_null(0).to_numpy()[:, None] + i * step, size).astype("float64")
        n = np.where(category.fill_null(0).to_numpy() == 7, 48, KEYPOINTS * 3)
        unknown = np.repeat(cents.is_null().to_numpy(zero_copy_only=False), n)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype("int32"), pa.array(values[i < n[:, None]], mask=unknown))

    return F.arrow_udf(made, "array<double>").asNondeterministic()


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with flat keypoint arrays; rows whose class is 7 carry a short array."""
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS image_id", "CAST(l_linenumber AS INT) AS category_id", "l_partkey AS part", "l_suppkey AS supp",
        "l_quantity", "CAST(round(l_extendedprice) AS BIGINT) AS cents",
    )
    return base.select(
        "image_id", "category_id", "part", "supp", "cents",
        F.expr("array(l_quantity * 38, CAST(part % 1080 AS DOUBLE), CAST(supp % 40 AS DOUBLE) * 8, CAST(part % 90 AS DOUBLE) * 6)").alias("bbox"),
        made_keypoints()("cents", "category_id").alias("keypoints"),
    )


ANNS = """
ann AS (
  SELECT l_orderkey AS image_id, CAST(l_linenumber AS INT) AS category_id, l_partkey AS part, l_suppkey AS supp,
    l_quantity * 38 AS bx, l_partkey % 1080 * 1e0 AS bt, l_suppkey % 40 * 8e0 AS bw, l_partkey % 90 * 6e0 AS bh,
    CAST(round(l_extendedprice) AS BIGINT) AS cents
  FROM lineitem),
annk AS (
  SELECT *, [CASE i % 3 WHEN 0 THEN CAST((cents + i * 31) % 1920 AS DOUBLE) WHEN 1 THEN CAST((cents + i * 17) % 1080 AS DOUBLE)
    ELSE CAST((cents + i) % 3 AS DOUBLE) END for i in range(0, CASE WHEN category_id = 7 THEN 48 ELSE 51 END)] AS kp
  FROM ann)"""


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of an outside set, one row per line; some lines are too short to use."""
    return table(spark, sf_dir, "part").selectExpr(
        "element_at(array('train', 'valid', 'test'), CAST(p_size % 3 + 1 AS INT)) AS split", "concat('img', p_partkey div 4) AS stem", "p_partkey AS line_no",
        "CASE WHEN p_partkey % 11 = 0 THEN concat(p_partkey % 11, ' 0.5') ELSE concat(p_partkey % 11, ' 0.', lpad(CAST(p_partkey % 997 AS STRING), 3, '0'), ' 0.', "
        "lpad(CAST(p_partkey * 7 % 997 AS STRING), 3, '0'), ' 0.', lpad(CAST(p_size AS STRING), 3, '0'), ' 0.2') END AS line",
    )


LABELS = """
lb AS (
  SELECT ['train', 'valid', 'test'][p_size % 3 + 1] AS split, 'img' || (p_partkey // 4) AS stem, p_partkey AS line_no,
    CASE WHEN p_partkey % 11 = 0 THEN (p_partkey % 11) || ' 0.5' ELSE (p_partkey % 11) || ' 0.' || lpad(CAST(p_partkey % 997 AS VARCHAR), 3, '0') || ' 0.'
      || lpad(CAST(p_partkey * 7 % 997 AS VARCHAR), 3, '0') || ' 0.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' 0.2' END AS line
  FROM part)"""


def landmark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court label files: one landmark per line, 30 lines per image, so some landmarks come twice and two ids do not exist."""
    return table(spark, sf_dir, "part").selectExpr(
        "element_at(array('train', 'valid', 'test'), CAST(p_partkey div 30 % 3 + 1 AS INT)) AS split", "concat('court', p_partkey div 30) AS stem", "p_partkey AS line_no",
        "concat(p_partkey % 28, ' 0.', lpad(CAST(p_partkey % 997 AS STRING), 3, '0'), ' 0.', lpad(CAST(p_partkey * 7 % 997 AS STRING), 3, '0'), ' 0.1 0.05 0.', "
        "lpad(CAST(p_partkey * 3 % 997 AS STRING), 3, '0'), ' 0.', lpad(CAST(p_size AS STRING), 3, '0'), ' ', p_partkey % 3) AS line",
    )


LANDMARKS = """
lm AS (
  SELECT ['train', 'valid', 'test'][p_partkey // 30 % 3 + 1] AS split, 'court' || (p_partkey // 30) AS stem, p_partkey AS line_no, p_partkey % 28 AS kpt,
    (p_partkey % 997) / 1e3 AS cx, (p_partkey * 7 % 997) / 1e3 AS cy, 1e-1 AS w, 5e-2 AS h, (p_partkey * 3 % 997) / 1e3 AS kx, p_size / 1e3 AS ky, CAST(p_partkey % 3 AS INT) AS kv
  FROM part)"""


def shot_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame shot labels as the annotation CSV gives them: all columns are text."""
    return images(spark, sf_dir).selectExpr(
        "video", "file_name", "CASE WHEN o_orderstatus = 'O' THEN '0' ELSE '1' END AS has_shot",
        "element_at(array('Forehand', 'Dropshot', 'Smash', 'Unclear'), CAST(image_id div 7 % 4 + 1 AS INT)) AS category",
    )


SHOTCSV = """
sx AS (
  SELECT video, image_id, frame_no, o_orderstatus <> 'O' AS has_shot, ['Forehand', 'Dropshot', 'Smash', 'Unclear'][image_id // 7 % 4 + 1] AS category FROM img)"""


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw training metric rows, as text, the way a CSV reader delivers them."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS run_id", "o_orderkey AS epoch",
        "CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_orderkey * 50 + CAST(o_totalprice AS BIGINT) % 3000 AS STRING) END AS time",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE CAST(CAST(o_totalprice AS BIGINT) % 1000 AS STRING) END AS map50",
    )


RUNS = """
rm AS (
  SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_orderkey AS epoch,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_orderkey * 50 + CAST(trunc(o_totalprice) AS BIGINT) % 3000 AS VARCHAR) END AS time,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) % 1000 AS VARCHAR) END AS map50
  FROM orders)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress-bar lines of trainer logs, with terminal colour codes; a few lines are chatter."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_size AS run_no", "p_partkey AS line_no",
        "CASE WHEN p_size % 10 = 0 AND p_partkey % 3 = 0 THEN concat('saving ', p_name) ELSE concat(chr(27), '[K  ', p_partkey % 100 + 1, '/100  1.71G 0.883 0.358  49  640: ', "
        "p_partkey % 101, '% ===--- ', (p_partkey * 7) % 3531, '/3531 ', p_size, '.', p_partkey % 10, 'it/s ', p_size % 60, ':', "
        "lpad(CAST(p_partkey % 60 AS STRING), 2, '0'), '<1:', lpad(CAST(p_size % 60 AS STRING), 2, '0'), ':', lpad(CAST((p_partkey * 3) % 60 AS STRING), 2, '0')) END AS line",
    )


LOGS = """
lg AS (
  SELECT p_size AS run_no, p_partkey AS line_no,
    CASE WHEN p_size % 10 = 0 AND p_partkey % 3 = 0 THEN 'saving ' || p_name ELSE
      chr(27) || '[K  ' || (p_partkey % 100 + 1) || '/100  1.71G 0.883 0.358  49  640: ' || (p_partkey % 101) || '% ===--- '
      || ((p_partkey * 7) % 3531) || '/3531 ' || p_size || '.' || (p_partkey % 10) || 'it/s ' || (p_size % 60) || ':'
      || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || '<1:' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST((p_partkey * 3) % 60 AS VARCHAR), 2, '0') END AS line
  FROM part)"""


def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live feed: one record per frame with its four players, shots and commands."""
    ball = F.expr("slot = 1 AND event_type = 'click'")
    player = F.struct("slot", "raw_id", "x1", "y1", "x2", "y2", "court_x", "court_y", "outside_court")
    shot = F.when(F.col("event_type") == "purchase", F.struct("slot", shot_type(F.col("k")).alias("shot_type")))
    r = player_frames(spark, sf_dir).groupBy("match_id", "frame").agg(
        F.max("t_sec").alias("t_sec"), F.max(F.when(ball, F.col("x1") + F.col("k") * 5)).alias("ball_x"), F.max(F.when(ball, F.col("y1") + F.col("k"))).alias("ball_y"),
        F.sort_array(F.collect_list(player)).alias("players"), F.sort_array(F.collect_list(shot)).alias("shots"),
    )
    actions = lifecycle(spark, sf_dir).groupBy("match_id", "frame").agg(F.collect_list("action").alias("actions"))
    return r.join(actions, ["match_id", "frame"], "left")


def feed_files(spark: SparkSession, sf_dir: str, steps: int = 3) -> str:
    """Write the feed as JSON files in frame order, a step after the other, each match in one file per step."""
    from courtspark.session import fresh_dir, materialise

    records = materialise(frame_records(spark, sf_dir), "feed-records")
    top = records.agg(F.max("frame")).first()[0]
    folder = fresh_dir(spark, "feed")
    for step in range(steps):
        low, high = top * step // steps, top * (step + 1) // steps + (step == steps - 1)
        records.filter((F.col("frame") >= low) & (F.col("frame") < high)).repartition("match_id").write.mode("append").json(folder)
    return folder


def with_sql(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes)
