"""Ball activity, serves, rallies, shots and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.blocks import FOLD_SPAN, DEFAULT_SPAN, Lane, LastSeen, Prev, RowNumber, greedy_spacing, scan, trailing


def match_lane(span: int = DEFAULT_SPAN, *ties: str) -> Lane:
    return Lane(("match_id",), "frame", ties, span)


def number_frames(frames: DataFrame, dense: bool, span: int = DEFAULT_SPAN, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """Add ``pos``, the 1-based count of analysed frames. ``dense``: every frame from 0 on has a row, so it is frame + 1."""
    if dense:
        return frames.withColumn("pos", F.col("frame") + 1)
    return scan(frames, Lane(keys, "frame", (), span), pos=RowNumber())


def ball_active(frames: DataFrame, window: int = 10, minimum: int = 3, span: int = DEFAULT_SPAN, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """The ball is in play when seen in at least ``minimum`` of the last ``window`` analysed frames."""
    out = trailing(frames, Lane(keys, "frame", (), span), window, _seen=("sum", F.col("seen").cast("int")))
    return out.withColumn("active", F.col("_seen") >= minimum).drop("_seen")


def serve_starts(frames: DataFrame, stillness: int = 20, history: int = 22, dense: bool = False, span: int = DEFAULT_SPAN) -> DataFrame:
    """Frames where the ball reappears after at least ``stillness`` frames without it."""
    seen = number_frames(frames.select("match_id", "frame", "seen"), dense, span).filter("seen").select("match_id", "frame", "pos")
    s = scan(seen, match_lane(span), prev=Prev(F.col("pos")))
    gap = F.col("pos") - F.coalesce("prev", F.lit(0)) - 1
    return s.filter((F.col("pos") >= history) & (gap >= stillness)).select("match_id", "frame", gap.alias("still_frames"))


def islands(
    frames: DataFrame, window: int = 10, minimum: int = 3, miss: int = 12, dense: bool = False, span: int = DEFAULT_SPAN, keys: tuple[str, ...] = ("match_id",),
) -> DataFrame:
    """Stretches of seen frames without ``miss`` analysed frames in a row that lack the ball: ``(keys, seen_frame, start_frame, end_frame)``.

    ``seen_frame`` is the first of them, ``start_frame`` the first active one (null if there is none), ``end_frame`` the
    analysed frame that closes it, ``miss`` frames after the last seen one (null while it is open).
    """
    lane = Lane(keys, "frame", (), span)
    f = number_frames(frames.select(*keys, "frame", "seen"), dense, span, keys)
    seen = ball_active(f, window, minimum, span, keys).filter("seen").select(*keys, "frame", "pos", "active")
    s = scan(seen, lane, prev=Prev(F.col("pos")))
    fresh = F.col("prev").isNull() | (F.col("pos") - F.col("prev") > miss)
    s = scan(s.withColumn("_first", F.when(fresh, F.col("pos"))), lane, island=LastSeen(F.col("_first")))
    found = s.groupBy(*keys, "island").agg(
        F.min("frame").alias("seen_frame"), F.min(F.when(F.col("active"), F.col("frame"))).alias("start_frame"), (F.max("pos") + miss).alias("pos")
    )
    if dense:
        top = frames.groupBy(*keys).agg(F.max("frame").alias("_top"))
        closed = found.join(top, list(keys)).withColumn("end_frame", F.when(F.col("pos") - 1 <= F.col("_top"), F.col("pos") - 1))
    else:
        closed = found.join(f.select(*keys, "pos", F.col("frame").alias("end_frame")), [*keys, "pos"], "left")
    return closed.select(*keys, "seen_frame", "start_frame", "end_frame")


def rallies(frames: DataFrame, window: int = 10, minimum: int = 3, miss: int = 12, dense: bool = False, span: int = DEFAULT_SPAN) -> DataFrame:
    """Closed rallies ``(match_id, start_frame, end_frame)``: islands with an active frame that have closed."""
    found = islands(frames, window, minimum, miss, dense, span)
    return found.filter("start_frame IS NOT NULL AND end_frame IS NOT NULL").select("match_id", "start_frame", "end_frame")


def accepted_shots(shots: DataFrame, cooldown: int = 8, span: int = FOLD_SPAN, keys: tuple[str, ...] = ("match_id", "slot")) -> DataFrame:
    """Per slot, a shot counts when at least ``cooldown`` frames passed since the last one that counted."""
    return greedy_spacing(shots, Lane(keys, "frame", ("ord",), span), cooldown)


def shots_in_rallies(shots: DataFrame, found: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Accepted shots with the rally they belong to: after its start frame, up to and including its end frame.

    Rallies of a match do not overlap, so the candidate is the last one started before the
    shot: an as-of join by a merged scan, never a join of all shots with all rallies.
    """
    none = F.lit(None)
    marks = found.select(
        "match_id", F.col("start_frame").alias("frame"), F.lit(1).alias("_kind"), F.lit(0).alias("ord"),
        F.struct("start_frame", "end_frame").alias("_rally"), none.cast("int").alias("slot"), none.cast("string").alias("shot_type"),
    )
    rally_type = marks.schema["_rally"].dataType
    rows = shots.select("match_id", "frame", F.lit(0).alias("_kind"), "ord", none.cast(rally_type).alias("_rally"), "slot", "shot_type")
    merged = scan(rows.unionByName(marks), match_lane(span, "_kind", "ord"), rally=LastSeen(F.col("_rally"), include_current=False))
    return (
        merged.filter("_kind = 0")
        .select("match_id", "frame", "ord", "slot", "shot_type", "rally.start_frame", "rally.end_frame")
        .filter(F.col("frame") <= F.col("end_frame"))
    )


def rally_ends(found: DataFrame, in_rally: DataFrame, players: DataFrame) -> DataFrame:
    """Closed rallies with shot count, last hitter and coarse winner.

    The point goes to the last hitter's team as known in the rally's end frame; unknown when
    that player is absent from it or has no team yet. ``players``: match_id, frame, slot, team.
    """
    hits = in_rally.groupBy("match_id", "start_frame").agg(
        F.count("*").alias("shots_in_rally"), F.max_by("slot", F.struct("frame", "ord")).alias("last_hitter")
    )
    r = found.join(hits, ["match_id", "start_frame"], "left")
    team = players.select("match_id", F.col("frame").alias("end_frame"), F.col("slot").alias("last_hitter"), F.col("team").alias("winner_team"))
    r = r.join(team, ["match_id", "end_frame", "last_hitter"], "left")
    return r.select(
        "match_id", "start_frame", "end_frame", (F.col("end_frame") - F.col("start_frame")).alias("duration_frames"),
        F.coalesce("shots_in_rally", F.lit(0)).alias("shots_in_rally"), "last_hitter", "winner_team",
    )


def team_score(ends: DataFrame) -> DataFrame:
    """A5: points per team."""
    return ends.filter(F.col("winner_team").isin(0, 1)).groupBy("match_id", "winner_team").agg(F.count("*").alias("points"))


def with_team(rows: DataFrame, players: DataFrame) -> DataFrame:
    """The team of a slot in the row's own frame."""
    return rows.join(players.select("match_id", "frame", "slot", "team"), ["match_id", "frame", "slot"], "left")


def last_rows(rows: DataFrame, n: int = 50, ties: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The last n rows per match; Spark limits each map task to n rows per match before the shuffle."""
    w = Window.partitionBy("match_id").orderBy(F.col("frame").desc(), *[F.col(t).desc() for t in ties])
    return rows.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
