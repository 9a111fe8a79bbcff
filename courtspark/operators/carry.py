"""Values carried forward in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.blocks import DEFAULT_SPAN, Lane, LastSeen, NextSeen, Prev, scan, trailing


def carry_forward(rows: DataFrame, lane: Lane, **columns: Column) -> DataFrame:
    """Last known value up to the row."""
    return scan(rows, lane, **{name: LastSeen(c) for name, c in columns.items()})


def carry_pose(players: DataFrame, value: Column, every: int = 3, out: str = "carried", span: int = DEFAULT_SPAN) -> DataFrame:
    """Pose frames take their own match, or nothing; other frames repeat the previous frame's value,
    but only for a slot that was in the previous frame."""
    lane = Lane(("match_id", "slot"), "frame", (), span)
    s = scan(players, lane, _prev=Prev(F.col("frame")))
    own = F.col("frame") % every == 0
    broken = F.col("_prev").isNull() | (F.col("frame") - F.col("_prev") > 1)
    start = F.when(own, F.struct(value.alias("v"))).when(broken, F.struct(F.lit(None).cast(s.select(value.alias("v")).schema["v"].dataType).alias("v")))
    return scan(s.withColumn("_start", start), lane, _v=LastSeen(F.col("_start"))).withColumn(out, F.col("_v.v")).drop("_prev", "_start", "_v")


def ball_trail(frames: DataFrame, length: int = 30, span: int = DEFAULT_SPAN) -> DataFrame:
    """Ball points of the current unbroken run of seen frames, newest last; a miss empties it."""
    lane = Lane(("match_id",), "frame", (), span)
    s = scan(frames.select("match_id", "frame", "ball_x", "ball_y", "seen"), lane, _was=Prev(F.col("seen")))
    fresh = F.when(F.col("seen") & ~F.coalesce("_was", F.lit(False)), F.col("frame"))
    s = scan(s.withColumn("_fresh", fresh), lane, _run=LastSeen(F.col("_fresh")))
    s = trailing(s, lane, length, _t=("list", F.struct("frame", "ball_x", "ball_y", "seen")))
    same_run = F.filter("_t", lambda p: p["v"]["seen"] & (p["v"]["frame"] >= F.col("_run")))
    points = F.transform(same_run, lambda p: F.struct(p["v"]["ball_x"].alias("x"), p["v"]["ball_y"].alias("y")))
    return s.select("match_id", "frame", F.when(F.col("seen"), points).otherwise(F.slice(points, 1, 0)).alias("trail"))


def nearest_frame(playheads: DataFrame, frames: DataFrame, tolerance: float = 1.0, span: int = DEFAULT_SPAN) -> DataFrame:
    """The analysed frame closest in time, the earlier one on ties, none beyond the tolerance.

    Both tables are merged in time order and looked through in both directions; frames are
    never joined with all playheads. ``playheads``: match_id, playhead_id, t; ``frames``: match_id, frame, t.
    """
    f = frames.select("match_id", "t", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("playhead_id"), F.struct("t", "frame").alias("hit"))
    p = playheads.select("match_id", "t", F.lit(1).alias("kind"), F.col("playhead_id").cast("bigint"), F.lit(None).cast(f.schema["hit"].dataType).alias("hit"))
    both = f.unionByName(p).withColumn("sec", F.floor("t").cast("bigint"))
    s = scan(both, Lane(("match_id",), "sec", ("t", "kind", "playhead_id"), span), before=LastSeen(F.col("hit")), after=NextSeen(F.col("hit")))
    s = s.filter("kind = 1")
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    take_back = F.col("after").isNull() | (back <= ahead)
    gap = F.when(take_back, back).otherwise(ahead)
    frame = F.when(take_back, F.col("before.frame")).otherwise(F.col("after.frame"))
    return s.select("match_id", "playhead_id", "t", F.when(gap <= tolerance, frame).alias("frame"), F.when(gap <= tolerance, gap).alias("gap"))
