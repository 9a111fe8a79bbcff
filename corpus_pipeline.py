"""From documents to packed training sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of ``documents``. Texts and ids may be null, rows may
repeat and the table may be empty; the operators' docstrings say what comes out then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.llm import decontaminate, likeness, line_dedup, packing, quality, simhash
from courtspark.llm.common import small, stored, table, text_key, unused
from courtspark.session import ship_package


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; host is the source, path the language within it."""
    return quality.kept(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; one that loses all its text goes."""
    (removed,) = unused(docs, "n_removed")
    left = line_dedup.without_repeats(docs, removed=removed).where(f"{removed} = 0 or trim(text) <> ''")
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop(removed)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more.

    Texts are held against each other where SimHash groups them (8 of 64 bits) or where they share a min-hash bucket.
    """
    groups = simhash.near_groups(docs, words=5, radius=8, exact=3)
    return likeness.one_per_group(docs, words=5, least=0.8, groups=groups)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    bad_id, bad_key, own_key = unused(docs, "bad_id", "bad_key", "own_key")
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    bad = stored(leaks.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(own_key) == F.col(bad_key))
    return docs.withColumn(own_key, text_key()).join(small(bad), same, "left_anti").drop(own_key)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2,048 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("near-dedup", distinct), ("benchmark decontamination", unleaked), ("packing", sequences)]

#: A trained classifier and a tokenizer are no SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
