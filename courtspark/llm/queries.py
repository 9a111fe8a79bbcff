"""Registered queries of the text operators, with DuckDB SQL where it can state them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from courtspark.llm import decontaminate, fingerprint, html_text, language, lexical, licenses, line_dedup, negatives, packing, quality, sharding, simhash, toxicity
from courtspark.llm.common import table
from courtspark.session import ship_package


def op1_quality(spark, sf_dir):
    """Quality of all documents; host is the source, path the language within it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = quality.scores(docs, labels, F.col("source"), F.col("lang"))
    return rated.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", "keep")


def op2_decontamination(spark, sf_dir):
    """Stretches of all documents that hold benchmark text."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "stop", "edits")


def op3_fingerprint(spark, sf_dir):
    """Bottom-k fingerprints of all documents and of their edited texts."""
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    """All documents without later occurrences of repeated three-line windows."""
    return line_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op5_licenses(spark, sf_dir):
    """Licence notices in all documents, by lines and by runs of lines."""
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "pos", "lines", "family", "template", "probability", "coverage", "confirmed")


def op6_simhash(spark, sf_dir):
    """SimHash groups of all documents: four-word shingles, four differing bits."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), words=4, radius=4, exact=4)
    hex_fp = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", hex_fp.alias("fingerprint"), "component_id")


def op7_sharding(spark, sf_dir):
    """All documents in eight shards of nearly equal bytes."""
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op8_toxicity(spark, sf_dir):
    """Toxicity scores of all documents; a quarter of the ids is held out from learning."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = toxicity.scored(docs, toxicity.fitted(docs, labels, usable=~held_out))
    marks = [F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")]
    by_language = (F.col("score") >= F.col("threshold")).cast("int").alias("predicted_by_language")
    return rated.select("doc_id", *marks, "threshold", by_language)


def op9_html_text(spark, sf_dir):
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fitted(pages), keep=("url",))


def op10_packing(spark, sf_dir):
    """All documents packed into sequences of 2,048 tokens."""
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_language(spark, sf_dir):
    """Language of all documents; a quarter of the ids is held out from learning."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    told = language.identified(docs, language.fitted(docs, usable=~held_out))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; a seventh of the labels is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op13_lexical(spark, sf_dir):
    """The twenty best documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _with_package(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {f.__name__: _with_package(f) for f in (op1_quality, op2_decontamination, op3_fingerprint, op4_line_dedup, op5_licenses, op6_simhash, op7_sharding, op8_toxicity, op9_html_text, op10_packing, op11_language, op12_negatives, op13_lexical)}
ORACLE: dict[str, str] = {"op4_line_dedup": line_dedup.SQL, "op12_negatives": negatives.SQL, "op13_lexical": lexical.SQL}
