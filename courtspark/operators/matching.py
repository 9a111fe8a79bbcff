"""Per-frame matching and best-row selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.functions import geometry as G
from courtspark.functions import labels as L


def best_pose_box(players: DataFrame, poses: DataFrame, threshold: float = 0.3) -> DataFrame:
    """For each player the overlapping pose box of the same frame with the highest IoU, if above the threshold.

    The join is on (match, frame), so a player meets only the boxes of its own frame;
    the winner is kept by a map-side combined ``max_by``.
    """
    keys = ["match_id", "frame", "slot"]
    p = poses.select("match_id", "frame", "pose_idx", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    v = G.iou("x1", "y1", "x2", "y2", "p_x1", "p_y1", "p_x2", "p_y2")
    pairs = players.join(p, ["match_id", "frame"], "left").select(*keys, "pose_idx", v.alias("v"))
    rank = F.struct(F.col("v"), -F.col("pose_idx"))
    best = pairs.groupBy(*keys).agg(F.max_by("pose_idx", rank).alias("pose_idx"), F.max("v").alias("iou"))
    ok = F.col("iou") > threshold
    return best.select(*keys, F.when(ok, F.col("pose_idx")).alias("pose_idx"), F.when(ok, F.col("iou")).alias("iou"))


def decode_rows(raw: DataFrame, scores: str, objectness: str, threshold: float = 0.15, classes: list[int] | None = None) -> DataFrame:
    """Raw detector rows to detections."""
    class_id, conf = L.decode_class(F.col(scores), objectness)
    out = raw.filter(F.col(objectness) >= threshold).select("*", class_id, conf).filter(F.col("conf") >= threshold)
    return out if classes is None else out.filter(F.col("class_id").isin(classes))


def best_by(df: DataFrame, keys: list[str], score: str, ties: list[str], threshold: float | None = None) -> DataFrame:
    """The highest-scoring row per key, ``ties`` ascending; partial top-1 before the shuffle."""
    if threshold is not None:
        df = df.filter(F.col(score) >= threshold)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(score), *[-F.col(t) for t in ties])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
