"""Match lifecycle: warmup, live, ended (L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.blocks import DEFAULT_SPAN, Lane, Next, RunningSum, scan
from courtspark.operators.rallies import serve_starts

# Order of commands given in the same frame.
ACTION_ORDER = ["reset", "auto", "start", "end"]


def _judged(commands: DataFrame, span: int) -> DataFrame:
    """Commands with their reset epoch, its end, and whether they started it by hand or by themselves."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTION_ORDER]), F.col("action")).cast("int")
    c = commands.select("match_id", "frame", "action").withColumn("_rank", rank)
    reset = F.when(F.col("action") == "reset", 1).otherwise(0)
    c = scan(c, Lane(("match_id",), "frame", ("_rank",), span), epoch=RunningSum(reset))
    c = c.withColumn("_at", F.struct("frame", "_rank"))
    keys = ["match_id", "epoch"]

    def first(action):
        return F.min(F.when(F.col("action").isin(*action), F.col("_at")))

    live = c.groupBy(*keys).agg(first(["start", "auto"]).alias("_live"))
    after = c.join(live, keys)
    ended = after.groupBy(*keys).agg(
        F.first("_live").alias("_live"),
        F.min(F.when((F.col("action") == "end") & (F.col("_at") > F.col("_live")), F.col("_at"))).alias("_end"),
    )
    judged = c.join(ended, keys).withColumn("_ok", F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    is_start = F.col("_ok") & (F.col("action") == "start")
    is_auto = F.col("_ok") & (F.col("action") == "auto") & (F.col("_at") == F.col("_live"))
    return judged.withColumn("_by_hand", is_start).withColumn("_by_itself", is_auto)


def lifecycle_states(commands: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """L1: the state each reset epoch of a match ends in.

    Rules: ``auto`` starts a match only from warmup; ``start`` starts or re-anchors it until it
    has ended, discarding what an automatic start counted; ``end`` works only while live;
    ``reset`` opens a new epoch. Within an epoch these are minima and maxima over command
    positions, so three small aggregations replace the state machine.
    """
    out = _judged(commands, span).groupBy("match_id", "epoch").agg(
        F.max(F.when(F.col("_by_hand"), F.col("frame"))).alias("_last_start"), F.min(F.when(F.col("_by_hand"), F.col("frame"))).alias("_first_start"),
        F.max(F.when(F.col("_by_itself"), F.col("frame"))).alias("auto_start_frame"), F.max("_end.frame").alias("ended_at"),
    )
    live_at = F.coalesce("_last_start", "auto_start_frame")
    return out.select(
        "match_id", "epoch",
        F.when(live_at.isNull(), "warmup").when(F.col("ended_at").isNotNull(), "ended").otherwise("live").alias("state"),
        F.when(F.col("_last_start").isNotNull(), "button").when(F.col("auto_start_frame").isNotNull(), "auto").alias("started_by"),
        live_at.alias("live_started_at"), "auto_start_frame", "ended_at",
        F.coalesce(F.col("_first_start") - F.col("auto_start_frame"), F.lit(0)).alias("discarded_warmup_frames"),
    )


def live_spans(commands: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Stretches of live play, ``(match_id, epoch, live_from, live_to)``; ``live_to`` is the first frame after it, null while it lasts.

    Each start that counts begins counting anew, so it ends the stretch before it, as an end and a reset do. Unlike the
    states of ``lifecycle_states`` this tells what was counted at the time, also before a later start.
    """
    marks = _judged(commands, span).filter("_by_hand OR _by_itself OR action = 'reset'")
    marks = scan(marks.select("match_id", "epoch", "frame", F.col("_rank").alias("turn"), "action", F.col("_end.frame").alias("_end")), Lane(("match_id",), "frame", ("turn",), span), _next=Next(F.col("frame")))
    spans = marks.filter("action <> 'reset'").select("match_id", "epoch", F.col("frame").alias("live_from"), F.least("_next", "_end").alias("live_to"))
    return spans.filter("live_to IS NULL OR live_to > live_from")


def live_rows(rows: DataFrame, states: DataFrame) -> DataFrame:
    """L2: only frames counted as live, tagged with their epoch; frames before the final start do not count.

    A match has few epochs, so this joins rows with a table a hundred thousand times smaller.
    """
    spans = states.filter("live_started_at IS NOT NULL").select("match_id", "epoch", "live_started_at", "ended_at")
    j = rows.join(spans, "match_id")
    live = (F.col("frame") >= F.col("live_started_at")) & (F.col("ended_at").isNull() | (F.col("frame") < F.col("ended_at")))
    return j.filter(live).drop("live_started_at", "ended_at")


def counted_players(players: DataFrame, states: DataFrame) -> DataFrame:
    """L2: live rows of players on the court."""
    return live_rows(players.filter("NOT outside_court"), states)


def auto_start(frames: DataFrame, commands: DataFrame, dense: bool = False, span: int = DEFAULT_SPAN) -> DataFrame:
    """L3: the first serve seen before the first start, as an ``auto`` command."""
    first = commands.filter("action = 'start'").groupBy("match_id").agg(F.min("frame").alias("_start"))
    hits = serve_starts(frames, dense=dense, span=span).join(first, "match_id", "left")
    hits = hits.filter(F.col("_start").isNull() | (F.col("frame") < F.col("_start")))
    return hits.groupBy("match_id").agg(F.min("frame").alias("frame")).withColumn("action", F.lit("auto"))
