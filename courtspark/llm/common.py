"""Helpers shared by the text operators: stored tables, row keys, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.session import materialise, ship_package

#: A side of a join is broadcast only when its stored rows are at most this many.
BROADCAST_ROWS = 50_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps reuse it, lost executors don't undo it."""
    ship_package(df.sparkSession)
    return materialise(df, label)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str = "text") -> Column:
    """Second half of a row's identity: rows that share id and text are one document."""
    return F.xxhash64(text_or_empty(text))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names not taken in ``df``, so that helper columns never clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table for broadcast if it is small; otherwise leaves the join to Spark's shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowest(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those of the smallest hash of ``key``; ``total`` is about its number of rows.

    Rows beyond twice the share that is wanted are left out first, so tasks hand on few rows however many they are.
    """
    share, of = min(1.0, 2.0 * n / max(1, total)), 1 << 30
    rank = F.pmod(F.xxhash64(key), F.lit(of))
    return df.where(rank < F.lit(max(1, int(share * of)))).orderBy(rank, key).limit(n)


def blocked_rank(df: DataFrame, keys: list[str], order: str, rows: int, block_rows: int = 100_000) -> DataFrame:
    """``df`` (stored, ``order`` unique) with ``rank``: 0, 1, 2, ... within ``keys``, without a window over a whole key.

    Rows of a key are dealt by the hash of ``order`` into blocks, counted per block, and numbered inside blocks; a block
    starts where the earlier ones end. ``rows`` is the number of rows of ``df``.
    """
    blocks = max(1, -(-rows // block_rows))
    dealt = df.withColumn("block", F.pmod(F.xxhash64(order), F.lit(blocks)))
    counts = dealt.groupBy(*keys, "block").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("block")) - F.col("count")
    offsets = stored(counts.select(*keys, "block", before.alias("base")), "block-offsets")
    inside = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(order)) - 1
    numbered = dealt.withColumn("inside", inside).join(small(offsets), [*keys, "block"])
    return numbered.withColumn("rank", F.col("base") + F.col("inside")).drop("block", "inside", "base")
