"""Connected components of a table of links, in shuffles of small rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import stored


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns ``u``, ``v``, longs); the label is the component's smallest node.

    Large-star and small-star steps alternate until nothing changes; each step is a minimum per node (combined before
    the shuffle) and one join. A round is written to the shared folder, so lineage stays short. Self links and nulls
    are ignored; an empty table gives an empty result.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every link of ``large`` points down already: its smaller neighbours are the v of each u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    up = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return up.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
