"""Tracking rules over match tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.blocks import DEFAULT_SPAN, Lane, LastSeen, Prev, RunningSum, scan


def primary_ball(tracks: DataFrame) -> DataFrame:
    """T4: per frame the matched track with most hits, then confidence; in gaps the one seen last, then most hits."""
    seen = F.when(F.col("matched"), F.struct(F.lit(1).alias("m"), F.lit(0).alias("u"), F.col("hits").alias("h"), F.col("score").alias("s"), (-F.col("track_id")).alias("i")))
    rank = F.coalesce(seen, F.struct(F.lit(0).alias("m"), (-F.col("unseen")).alias("u"), F.col("hits").alias("h"), F.lit(0.0).alias("s"), (-F.col("track_id")).alias("i")))
    rest = [c for c in tracks.columns if c not in ("match_id", "frame")]
    best = tracks.groupBy("match_id", "frame").agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return best.select("match_id", "frame", "_r.*")


def presence(tracks: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Stretches of consecutive frames a raw id is present in; a missed frame starts a new one."""
    lane = Lane(("match_id", "raw_id"), "frame", (), span)
    s = scan(tracks, lane, _p=Prev(F.col("frame")))
    s = s.withColumn("_s", F.when(F.col("_p").isNull() | (F.col("frame") - F.col("_p") > 1), F.col("frame")))
    return scan(s, lane, since=LastSeen(F.col("_s"))).drop("_p", "_s")


def court_filter(tracks: DataFrame, establish: int = 15, confidence: float = 0.40, outside: int = 300, span: int = DEFAULT_SPAN) -> DataFrame:
    """D3. ``tracks``: match_id, raw_id, frame, inside, good_height, conf. Adds since, valid, outside and established.

    A stretch is cut after each frame that ends ``outside`` + 1 frames outside in a row: only there can an established
    track be lost, whatever came before. Within a segment a track is established from the first frame that closes a long
    enough good run at a sufficient mean confidence. A run that starts right behind a loss keeps the count of the run
    that had established the track, so it needs no length. Whether a segment begins behind a loss is settled on the
    segments alone: the last one that doesn't depend on its forerunner decides.
    """
    lane = Lane(("match_id", "raw_id"), "frame", (), span)
    keys = ["match_id", "raw_id", "since", "seg"]
    ok = F.col("inside") & F.col("good_height")
    p = presence(tracks.select("match_id", "raw_id", "frame", "inside", "good_height", "conf"), span)
    p = scan(p, lane, _sum=RunningSum(F.col("conf")), _bad=LastSeen(F.when(~ok, F.col("frame"))), _in=LastSeen(F.when(F.col("inside"), F.col("frame"))))
    before = F.col("since") - 1
    lost_here = F.col("frame") - F.greatest(F.coalesce("_in", before), before) == outside + 1
    p = scan(
        p, lane, _base=LastSeen(F.when(F.col("frame") == F.col("since"), F.col("_sum") - F.col("conf"))),
        _cut=LastSeen(F.when(lost_here, F.col("frame")), include_current=False),
    )
    run = F.col("frame") - F.greatest(F.coalesce("_bad", before), before)
    sure = (F.col("_sum") - F.col("_base")) / (F.col("frame") - F.col("since") + 1) >= confidence
    p = p.select("match_id", "raw_id", "since", F.greatest(F.coalesce("_cut", before), before).alias("seg"), "frame", "inside", lost_here.alias("_end"), run.alias("_run"), sure.alias("_sure"))
    behind = (F.col("_run") > 0) & (F.col("frame") - F.col("_run") == F.col("seg")) & (F.col("seg") >= F.col("since"))
    first = lambda cond: F.min(F.when(cond & F.col("_sure"), F.col("frame")))
    segs = p.groupBy(*keys).agg(first(F.col("_run") >= establish).alias("_own"), first(behind).alias("_kept"))
    order = Window.partitionBy(*keys[:3]).orderBy("seg")
    told = F.when(F.col("_own").isNotNull(), True).when(F.col("_kept").isNull(), False)
    segs = segs.withColumn("_est", F.coalesce(F.last(told, ignorenulls=True).over(order), F.lit(False)))
    segs = segs.withColumn("_was", F.coalesce(F.lag("_est").over(order), F.lit(False)))
    segs = segs.select(*keys, F.least("_own", F.when(F.col("_was"), F.col("_kept"))).alias("_from"))
    p = p.join(segs, keys)
    held = F.coalesce(F.col("frame") >= F.col("_from"), F.lit(False))
    stays = held & ~F.col("_end")
    return p.select("match_id", "raw_id", "since", "frame", stays.alias("valid"), (held & ~F.col("inside")).alias("outside"), stays.alias("established"))


def first_established(tracks: DataFrame, establish: int = 15, confidence: float = 0.40) -> DataFrame:
    """D3, window form of the first establishment per presence stretch (for stretches cut by nothing but a missed frame)."""
    p = presence(tracks)
    ok = F.col("inside") & F.col("good_height")
    lane = Lane(("match_id", "raw_id"), "frame")
    p = scan(p, lane, _sum=RunningSum(F.col("conf")), _bad=LastSeen(F.when(~ok, F.col("frame"))))
    base = p.filter("frame = since").select("match_id", "raw_id", "since", (F.col("_sum") - F.col("conf")).alias("_base"))
    p = p.join(base, ["match_id", "raw_id", "since"])
    run = F.col("frame") - F.greatest(F.coalesce("_bad", F.lit(-1)), F.col("since") - 1)
    n = F.col("frame") - F.col("since") + 1
    hit = (run >= establish) & ((F.col("_sum") - F.col("_base")) / n >= confidence)
    return p.filter(hit).groupBy("match_id", "raw_id", "since").agg(F.min("frame").alias("established_at"))
