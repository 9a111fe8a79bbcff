"""Per-slot statistics, teams and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.blocks import DEFAULT_SPAN, Lane, LastSeen, Prev, RowNumber, Total, scan


def slot_lane(span: int = DEFAULT_SPAN) -> Lane:
    return Lane(("match_id", "slot"), "frame", (), span)


def movement(players: DataFrame, time: str = "t_sec", max_step: float = 5.0, max_gap: float = 5.0, extra_keys: tuple[str, ...] = (), span: int = DEFAULT_SPAN) -> DataFrame:
    """W1 and W2 in one pass: metres since the last known position and seconds since the last sighting.

    Steps of ``max_step`` or more are not movement, but the new position still becomes the
    previous one; gaps of ``max_gap`` seconds or more do not count as time on court.
    """
    known = F.col("court_x").isNotNull() & F.col("court_y").isNotNull()
    here = F.when(known, F.struct(F.col("court_x").alias("x"), F.col("court_y").alias("y")))
    lane = Lane((*extra_keys, "match_id", "slot"), "frame", (), span)
    s = scan(players, lane, _prev=LastSeen(here, include_current=False), _t=Prev(F.col(time)))
    step = F.hypot(F.col("court_x") - F.col("_prev.x"), F.col("court_y") - F.col("_prev.y"))
    gap = F.col(time) - F.col("_t")
    return (
        s.withColumn("step_m", F.when(known & F.col("_prev").isNotNull(), step))
        .withColumn("moved_m", F.when(F.col("step_m") < max_step, F.col("step_m")).otherwise(0.0))
        .withColumn("elapsed_s", F.when(gap < max_gap, gap).otherwise(0.0))
        .drop("_prev", "_t")
    )


def _last_known():
    known = F.col("court_x").isNotNull() & F.col("court_y").isNotNull()
    at = F.when(known, F.col("frame"))
    return [
        F.max_by("x1", "frame").alias("x1"), F.max_by("y1", "frame").alias("y1"), F.max_by("x2", "frame").alias("x2"), F.max_by("y2", "frame").alias("y2"),
        F.max_by("court_x", at).alias("court_x"), F.max_by("court_y", at).alias("court_y"),
    ]


def batch_stats(players: DataFrame, fps: float = 30.0, span: int = DEFAULT_SPAN) -> DataFrame:
    """A1: whole-match totals per slot; time on court is frames over the frame rate."""
    m = movement(players.filter("slot >= 1"), span=span)
    return m.groupBy("match_id", "slot").agg(
        F.count("*").alias("frames_seen"), F.bround(F.count("*") / F.lit(max(fps, 1.0)), 1).alias("time_on_court"),
        F.bround(F.sum("moved_m"), 1).alias("distance_m"), *_last_known(),
    )


def shots_by_type(shots: DataFrame) -> DataFrame:
    """A3 as rows."""
    return shots.groupBy("match_id", "slot", "shot_type").agg(F.count("*").alias("shots"))


def shot_map(shots: DataFrame) -> DataFrame:
    """A3 as one map per slot (a slot has as many entries as there are shot types)."""
    per_type = shots_by_type(shots)
    return per_type.groupBy("match_id", "slot").agg(
        F.sum("shots").alias("shots"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("shot_type", "shots")))).alias("shots_by_type")
    )


def live_stats(players: DataFrame, shots: DataFrame, max_slots: int = 4, span: int = DEFAULT_SPAN) -> DataFrame:
    """A2: every slot of every match, seen or not; shots here have no cooldown. Needs a ``team`` column."""
    seen = players.filter(F.col("slot").between(1, max_slots))
    m = movement(seen, span=span)
    totals = m.groupBy("match_id", "slot").agg(
        F.count("*").alias("frames_seen"), F.bround(F.sum("elapsed_s"), 1).alias("time_on_court"), F.bround(F.sum("moved_m"), 1).alias("distance_m"),
        F.max_by("team", F.when(F.col("team").isNotNull(), F.col("frame"))).alias("team"), *_last_known(),
    )
    slots = players.select("match_id").distinct().select("match_id", F.explode(F.sequence(F.lit(1), F.lit(max_slots))).alias("slot"))
    out = slots.join(totals, ["match_id", "slot"], "left").join(shot_map(shots), ["match_id", "slot"], "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(
        "match_id", "slot", "team", F.col("frames_seen").isNotNull().alias("active"), zero("frames_seen", 0), zero("time_on_court", 0.0),
        zero("distance_m", 0.0), zero("shots", 0), "shots_by_type", "x1", "y1", "x2", "y2", "court_x", "court_y",
    )


def team_locks(players: DataFrame, net_y: float = 10.0, alpha: float = 0.02, min_frames: int = 240) -> DataFrame:
    """The half a slot's averaged court-y lies in after ``min_frames`` known positions, and the frame of the lock.

    The average is a fixed weighted sum of the first ``min_frames`` values. Spark keeps at most
    that many rows per slot in each map task, so the shuffle does not grow with the match.
    """
    w = Window.partitionBy("match_id", "slot").orderBy("frame")
    first = (
        players.filter("court_x IS NOT NULL AND court_y IS NOT NULL").select("match_id", "slot", "frame", "court_y")
        .withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= min_frames)
    )
    decay = F.pow(F.lit(1 - alpha), F.lit(min_frames) - F.col("_i").cast("double"))
    weight = F.when(F.col("_i") == 1, decay).otherwise(decay * alpha)
    locked = first.groupBy("match_id", "slot").agg(F.sum(F.col("court_y") * weight).alias("mean_y"), F.max("frame").alias("lock_frame"), F.count("*").alias("_n"))
    return locked.filter(F.col("_n") == min_frames).select("match_id", "slot", "lock_frame", "mean_y", F.when(F.col("mean_y") < net_y, 0).otherwise(1).alias("team"))


def attach_teams(players: DataFrame, locks: DataFrame) -> DataFrame:
    """A slot has a team from its lock frame on (four rows per match: Spark broadcasts them while they are small)."""
    l = locks.select("match_id", "slot", "lock_frame", F.col("team").alias("_team"))
    j = players.join(l, ["match_id", "slot"], "left")
    return j.withColumn("team", F.when(F.col("frame") >= F.col("lock_frame"), F.col("_team"))).drop("lock_frame", "_team")


def team_rollup(slots: DataFrame, score: DataFrame) -> DataFrame:
    """A4: players, shots and points of both teams of each match."""
    matches = slots.select("match_id").distinct().select("match_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("team"))
    per_team = slots.groupBy("match_id", "team").agg(F.count("*").alias("players"), F.sum("shots").alias("shots"))
    points = score.select("match_id", F.col("winner_team").alias("team"), "points")
    out = matches.join(per_team, ["match_id", "team"], "left").join(points, ["match_id", "team"], "left")
    return out.na.fill(0, ["players", "shots", "points"])


def position_buffer(players: DataFrame, cap: int = 6000, drop: int = 1000, span: int = DEFAULT_SPAN) -> DataFrame:
    """The positions left in a buffer that drops its ``drop`` oldest whenever it exceeds ``cap``, and the thinning stride."""
    known = players.filter("court_x IS NOT NULL AND court_y IS NOT NULL AND NOT outside_court").select("match_id", "slot", "frame", "court_x", "court_y")
    numbered = scan(known, slot_lane(span), _i=RowNumber(), _n=Total(F.lit(1)))
    n = F.col("_n")
    kept = F.when(n <= cap, n).otherwise(cap - drop + 1 + (n - cap - 1) % drop)
    return numbered.filter(F.col("_i") > n - kept).select("match_id", "slot", "frame", "court_x", "court_y", (F.col("_i") - (n - kept) - 1).alias("buffer_idx"), kept.alias("buffer_len"))


def thin(buffer: DataFrame, limit: int = 6000) -> DataFrame:
    """Every ``len // limit``-th buffered position when there are more than ``limit``."""
    stride = F.greatest(F.floor(F.col("buffer_len") / limit), F.lit(1))
    return buffer.filter((F.col("buffer_len") <= limit) | (F.col("buffer_idx") % stride == 0))
