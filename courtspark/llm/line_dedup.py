"""Line deduplication by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import stored, text_key, unused

#: Lines of a window.
WINDOW = 3
#: White space that doesn't count at either end of a line.
EDGE = " \t\r"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _window_hashes(hashes: Column) -> Column:
    """Hashes of three neighbours each; shorter than ``hashes`` by two."""
    n = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))
    pair = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda x, y: F.xxhash64(x, y))
    return F.zip_with(pair, F.slice(hashes, 3, n), lambda xy, z: F.xxhash64(xy, z))


def windows(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, pos, a, b): each window of three consecutive lines, by two independent 64-bit hashes.

    Lines are compared without white space at their ends. Windows of blank lines only don't count. Texts of fewer than
    three lines and null texts have no window.
    """
    lines = F.transform(_lines(text), lambda line: F.btrim(line, F.lit(EDGE)))
    one = F.transform(lines, lambda line: F.xxhash64(line))
    two = F.transform(lines, lambda line: F.xxhash64(F.lit(1), line))
    both = F.zip_with(_window_hashes(one), _window_hashes(two), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    blank = F.xxhash64(F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), F.posexplode(both).alias("pos", "w"))
    return rows.select("doc_id", "text_key", "pos", "w.a", "w.b").where(F.col("a") != F.xxhash64(F.xxhash64(blank, blank), blank))


def later_windows(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, pos): windows that repeat one earlier in the order of (doc_id, text key, position)."""
    every = stored(windows(docs, text, id), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "pos")
    first = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return every.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_key", "pos")


def without_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", removed: str = "n_removed") -> DataFrame:
    """The documents with later occurrences of repeated three-line windows taken out, plus the count of removed lines.

    A window's first occurrence (smallest id, then text key, then position; null ids last) keeps its lines; every line
    that some later occurrence covers goes, overlapping occurrences merged. Rows that share id and text are one
    document and get the same result. A null text stays null, a text of which nothing is left becomes empty. All other
    columns stay.
    """
    row_id, key, starts, lines = unused(docs, "row_id", "row_key", "starts", "lines")
    # one row per document with repeats; its positions are no more than its lines
    hit = later_windows(docs, text, id).groupBy(F.col("doc_id").alias(row_id), F.col("text_key").alias(key)).agg(F.collect_set("pos").alias(starts))
    own_key = unused(docs, "own_key")[0]
    # the lines travel through the join instead of the text, so they are split once
    cut = docs.withColumn(own_key, text_key(text)).withColumn(lines, _lines(text)).drop(text)
    both = cut.join(hit, F.col(id).eqNullSafe(F.col(row_id)) & (F.col(own_key) == F.col(key)), "left")
    covered = F.flatten(F.transform(F.col(starts), lambda s: F.array(s, s + 1, s + 2)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.transform(left, lambda i: F.get(F.col(lines), i))
    changed = F.col(starts).isNotNull()
    both = both.withColumn(removed, F.when(changed, F.size(F.array_distinct(covered))).otherwise(0))
    both = both.withColumn(text, F.when(changed, F.array_join(kept, "\n")).otherwise(F.array_join(F.col(lines), "\n")))
    return both.select(*docs.columns, removed)


#: DuckDB: the lines that stay, of tables in which doc_id is a key.
SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
w AS (SELECT doc_id, pos, bare AS x, lead(bare, 1) OVER o AS y, lead(bare, 2) OVER o AS z FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k FROM w WHERE z IS NOT NULL AND x || y || z <> ''),
c AS (SELECT DISTINCT doc_id, pos + d AS pos FROM r, (VALUES (0), (1), (2)) v(d) WHERE k > 1),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text, count(c.pos) AS n_removed FROM l LEFT JOIN c USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0)::INTEGER AS n_removed FROM documents d LEFT JOIN k USING (doc_id)
"""
