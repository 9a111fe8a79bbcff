"""Detector counts, evaluation, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.blocks import Lane, RowNumber, Total, scan, trailing
from courtspark.functions.labels import map_class

# Shot classes of the classifier, in class-id order.
CLASSIFIER_CLASSES = [
    "Bandeja", "Bola", "Contrapared", "Globo", "Golpe de derecha", "Golpe de reves", "Remate", "Salida de pared", "Saque", "Volea de derecha", "Volea de reves",
]


def frame_stats(det: DataFrame) -> DataFrame:
    """Detections and mean confidence per frame and model."""
    return det.groupBy("match_id", "frame", "model").agg(F.count("*").alias("count"), F.bround(F.avg("conf"), 4).alias("avg_conf"))


def video_summary(det: DataFrame, videos: DataFrame, models: list[str]) -> DataFrame:
    """Per video and known model, 0 where a model found nothing. ``videos``: match_id, frames_analyzed, elapsed_s."""
    per = det.groupBy("match_id", "model").agg(F.count("*").alias("detections"), F.bround(F.avg("conf"), 4).alias("avg_conf"))
    dim = videos.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    fps = F.when(F.col("elapsed_s") > 0, F.bround(F.col("frames_analyzed") / F.col("elapsed_s"), 1)).otherwise(0.0)
    return dim.join(per, ["match_id", "model"], "left").select(
        "match_id", "model", F.coalesce("detections", F.lit(0)).alias("detections"), F.coalesce("avg_conf", F.lit(0.0)).alias("avg_conf"), "frames_analyzed", fps.alias("infer_fps")
    )


def shot_distribution(det: DataFrame, model: str = "shot_classifier") -> DataFrame:
    """Classified shots per label."""
    label = F.coalesce(map_class(F.col("class_id"), dict(enumerate(CLASSIFIER_CLASSES))), F.lit("Unknown"))
    return det.filter(F.col("model") == model).groupBy("match_id", label.alias("label")).agg(F.count("*").alias("shots"))


def evaluate(images: DataFrame, det: DataFrame, models: list[str], low: float = 0.5) -> DataFrame:
    """A10: detector quality per model and video; images without detections count.

    Detections are reduced per image first (map-side), so no task sees more than the images of a video.
    ``images``: video, image_id; ``det``: video, image_id, model, conf.
    """
    per_image = det.groupBy("model", "video", "image_id").agg(F.count("*").alias("n"), F.sum("conf").alias("c"), F.count(F.when(F.col("conf") < low, 1)).alias("lo"))
    found = per_image.groupBy("model", "video").agg(F.count("*").alias("hit"), F.sum("n").alias("dets"), F.sum("c").alias("conf"), F.sum("lo").alias("low"))
    total = images.groupBy("video").agg(F.count("*").alias("images")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    j = total.join(found, ["model", "video"], "left").na.fill(0)
    n, d = F.col("images"), F.col("dets")
    return j.select(
        "model", "video", "images", F.bround(d / n, 2).alias("avg_dets"), F.when(d > 0, F.bround(F.col("conf") / d, 4)).otherwise(0.0).alias("avg_conf"),
        F.bround((n - F.col("hit")) / n * 100, 1).alias("zero_det_pct"), F.when(d > 0, F.bround(F.col("low") / d * 100, 1)).otherwise(0.0).alias("low_conf_pct"),
    )


def class_distribution(det: DataFrame) -> DataFrame:
    """A10: detections per class."""
    return det.groupBy("model", "video", "class_id").agg(F.count("*").alias("detections"))


def keypoint_visibility(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of keypoints a pose model is sure of."""
    seen = F.size(F.filter(F.col("keypoints.v"), lambda v: v > threshold))
    sums = det.groupBy("model", "video").agg(F.sum(seen).alias("visible"), F.sum(F.size("keypoints")).alias("keypoints"))
    return sums.select("model", "video", "keypoints", F.when(F.col("keypoints") > 0, F.bround(F.col("visible") / F.col("keypoints"), 4)).otherwise(0.0).alias("kpt_visibility"))


def cross_video_gap(quality: DataFrame, videos: tuple[str, str]) -> DataFrame:
    """How much a model's confidence differs between two videos."""
    a, b = videos
    p = quality.groupBy("model").pivot("video", [a, b]).agg(F.first("avg_conf").alias("conf"), F.first("avg_dets").alias("dets"))
    conf = F.abs(F.col(f"{a}_conf") - F.col(f"{b}_conf"))
    return p.select(
        "model", F.bround(conf, 4).alias("conf_gap"), F.bround(F.abs(F.col(f"{a}_dets") - F.col(f"{b}_dets")), 2).alias("det_gap"),
        F.when(conf < 0.05, "good").when(conf < 0.15, "moderate").otherwise("poor").alias("assessment"),
    )


def rolling_mean(rows: DataFrame, lane: Lane, value: str, n: int, out: str) -> DataFrame:
    """Mean of the last n values, by block scan."""
    return trailing(rows, lane, n, **{out: ("avg", F.col(value))})


def model_counters(det: DataFrame, latency: DataFrame, ties: list[str], n_conf: int = 100, n_lat: int = 30) -> DataFrame:
    """Latest counters per match and model.

    Only the newest rows matter, so the rolling means are top-n queries: Spark keeps n rows
    per model in each map task instead of sorting a model's whole history.
    ``latency``: match_id, model, frame, ms.
    """
    keys = ["match_id", "model"]

    def newest(df, order, n, value, out):
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy(*keys).agg(F.avg(value).alias(out))

    per_frame = det.groupBy(*keys, "frame").agg(F.count("*").alias("n"))
    totals = per_frame.groupBy(*keys).agg(F.sum("n").alias("total_detections"), F.max("frame").alias("last_frame"), F.max_by("n", "frame").alias("frame_detections"))
    return totals.join(newest(det, ["frame", *ties], n_conf, "conf", "rolling_conf"), keys, "left").join(newest(latency, ["frame"], n_lat, "ms", "rolling_ms"), keys, "left")


def model_snapshot(counters: DataFrame, balls: DataFrame, tracks: DataFrame, main: str, trail: int = 20) -> DataFrame:
    """What a viewer polls, one row per match: counters of each model, newest ball points, current tracks, frames a second.

    ``counters``: output of :func:`model_counters`; ``balls``: match_id, frame, x, y of the frames with a ball, in [0, 1];
    ``tracks``: match_id, frame, slot, cx, cy, confirmed. Misses don't empty this trail. Tracks are those of the newest frame
    that has any. The rate is that of the ``main`` model's rolling latency, 0 for a match where it didn't run.
    """
    w = Window.partitionBy("match_id").orderBy(F.col("frame").desc())  # the limit runs before the shuffle
    newest = balls.filter(F.col("x").isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= trail)
    point = F.sort_array(F.collect_list(F.struct("frame", "x", "y")))
    points = newest.groupBy("match_id").agg(F.transform(point, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ball_trail"))
    per_frame = tracks.groupBy("match_id", "frame").agg(F.sort_array(F.collect_list(F.struct("slot", "cx", "cy", "confirmed"))).alias("_t"))
    current = per_frame.groupBy("match_id").agg(F.max_by("_t", "frame").alias("player_tracks"))
    ms = F.max(F.when(F.col("model") == main, F.col("rolling_ms")))
    rate = F.when(ms.isNull(), 0.0).otherwise(F.bround(1000.0 / F.when(ms > 0, ms).otherwise(1.0), 1))
    stat = F.struct("model", "total_detections", "frame_detections", F.bround("rolling_conf", 3).alias("avg_confidence"), F.bround("rolling_ms", 1).alias("avg_latency_ms"))
    out = counters.groupBy("match_id").agg(F.sort_array(F.collect_list(stat)).alias("models"), rate.alias("fps"))
    out = out.join(points, "match_id", "full").join(current, "match_id", "full")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(
        "match_id", empty("models", out.schema["models"].dataType), F.coalesce("fps", F.lit(0.0)).alias("fps"),
        empty("ball_trail", out.schema["ball_trail"].dataType), empty("player_tracks", out.schema["player_tracks"].dataType),
    )


def even_sample(rows: DataFrame, lane: Lane, n: int) -> DataFrame:
    """T5: about n evenly spaced rows per key: every ``count // n``-th, at most n."""
    numbered = scan(rows, lane, _i=RowNumber(), _n=Total(F.lit(1)))
    step = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    i = F.col("_i") - 1
    return numbered.filter((F.col("_n") <= n) | ((i % step == 0) & (i / step < n))).drop("_i", "_n")


def seeded_sample(files: DataFrame, key: str, name: str, n: int, seed: str = "") -> DataFrame:
    """N files per key in an order fixed by a hash of seed, key and name; top-n before the shuffle."""
    order = F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"), F.col(name).cast("string")))
    w = Window.partitionBy(key).orderBy(order, F.col(name))
    return files.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= n)


def frame_slice(rows: DataFrame, match_id, first: int, last: int) -> DataFrame:
    """1-based, inclusive range of a match's frames; a plain filter that reaches the scan."""
    return rows.filter((F.col("match_id") == match_id) & F.col("frame").between(first - 1, last - 1))


def temporal_split(rows: DataFrame, lane: Lane, fraction: float = 0.85, first: str = "train", rest: str = "val") -> DataFrame:
    """The first ``floor(count * fraction)`` rows of each key against the rest."""
    numbered = scan(rows, lane, _i=RowNumber(), _n=Total(F.lit(1)))
    return numbered.withColumn("split", F.when(F.col("_i") <= F.floor(F.col("_n") * fraction), first).otherwise(rest)).drop("_i", "_n")


