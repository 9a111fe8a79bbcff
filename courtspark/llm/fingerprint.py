"""Document fingerprints: the bottom-k sketch of a text's shingle hashes.

A sketch holds the k smallest distinct 48-bit hashes of five-word shingles (a shorter text is one shingle), in order.
Sketches of parts merge to the sketch of the whole. Two sketches estimate resemblance and containment, one the number
of distinct shingles; all three are exact while a text has fewer than k of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from courtspark.llm import words
from courtspark.llm.common import small, stored, text_key, text_or_empty

SHINGLE, K, HASH_BITS = 5, 128, 48
#: Documents of a run of neighbours in id order that one task takes, about; there are at most RUNS runs.
RUN, RUNS = 2_000, 20_000


def sketches_of(texts: pa.Array, shingle: int = SHINGLE, k: int = K) -> list[np.ndarray]:
    """The sketch of each text; a text without words (or null) has an empty one."""
    out: list[np.ndarray] = []
    for a, b, raw, offs in words.chunks(texts):
        for c in range(0, b - a, 1 << 15):  # texts are numbered in the bits above the hash
            d = min(b - a, c + (1 << 15))
            own, at = raw[offs[c] : offs[d]], offs[c : d + 1] - offs[c]
            starts, ends, first = words.spans(own, at)
            text, h = words.shingles(words.hashes(own, starts, ends), first, shingle)
            h >>= np.uint64(64 - HASH_BITS)
            # of a long text only hashes small enough to be among the k smallest are sorted, unless repeats leave too few
            n = np.bincount(text, minlength=d - c)
            most = np.where(n > 4 * k, 2.0 * k / np.maximum(n, 1), 1.0) * 2.0**HASH_BITS
            low = h < most[text]
            parts = _lowest(text[low], h[low], d - c, k)
            for i in np.flatnonzero((n > 4 * k) & (np.array([len(p) for p in parts]) < k)):
                parts[i] = np.unique(h[text == i])[:k]
            out += parts
    return out


def _lowest(text: np.ndarray, h: np.ndarray, texts: int, k: int) -> list[np.ndarray]:
    key = np.unique((text.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
    bounds = np.searchsorted(key, np.arange(texts + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
    value = key & np.uint64((1 << HASH_BITS) - 1)
    return [value[s : min(e, s + k)] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of two sketches; two empty ones are alike, an empty one is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    number = np.cumsum(new)  # of the distinct value each entry is
    return float(np.count_nonzero(~new & (number <= k)) / min(k, number[-1]))


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = K, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, sketch array<long>), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.astype(np.int64) for s in sketches_of(b.column(2), shingle, k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_key", "sketch"])

    chosen = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, text_key long, sketch array<long>")


def merged(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches (column ``sketch``) merged per ``keys``: the k smallest distinct values of each group.

    Each map task keeps k values a group before the shuffle, so a group of any size is safe.
    """
    values = parts.select(*keys, F.explode("sketch").alias("value"))
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("value"))
    best = values.withColumn("place", place).where(F.col("place") <= k).dropDuplicates([*keys, "value"])
    full = best.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("sketch"))
    every, at = parts.select(*keys).distinct().alias("e"), full.alias("f")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    return every.join(at, same, "left").select("e.*", F.coalesce("f.sketch", F.array().cast("array<long>")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of two sketches."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)
    )


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * 2.0**HASH_BITS / F.element_at(sketch, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too: resemblance times size of the union over size of a."""
    both = F.array_sort(F.array_union(a, b))
    whole = F.when(F.size(both) < k, F.size(both).cast("double")).otherwise((k - 1) * 2.0**HASH_BITS / F.element_at(both, k))
    share = resemblance(a, b, k) * whole / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def _written(sketch: np.ndarray) -> str:
    """A sketch as text: the upper 32 bits of each value, base64."""
    return base64.b64encode((sketch >> np.uint64(HASH_BITS - 32)).astype(">u4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def neighbours(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(run, extra, doc_id, text_key, text), sorted within partitions: runs of documents by descending id.

    After each run follows, marked ``extra``, the document that comes next: the first of the run below, after the last
    the first of all. Rows of equal id go by text key, rows without id come last. Ids are numbers.
    """
    keyed = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    rows = keyed.count()
    runs = min(max(1, rows // RUN), RUNS)
    ids = keyed.where("doc_id is not null").select("doc_id")
    marks = np.unique(np.array(ids.approxQuantile("doc_id", [n / runs for n in range(1, runs)], 0.1 / runs) if runs > 1 else [], dtype=float))

    @pandas_udf("long")
    def run_of(values):
        return values.where(values.isna(), np.searchsorted(marks, values.astype(float), "right") + 1).fillna(0).astype("int64")

    keyed = keyed.withColumn("run", run_of("doc_id"))
    first = stored(keyed.groupBy("run").agg(F.max(F.struct("doc_id", "text_key")).alias("first")), "runs")
    found = sorted(r[0] for r in first.select("run").collect())  # RUNS at most
    above = {low: high for low, high in zip(found, [*found[1:], *found[:1]], strict=True)}
    if not found:
        return keyed.withColumn("extra", F.lit(0)).select("run", "extra", "doc_id", "text_key", "text")
    target = F.create_map(*(F.lit(x) for pair in above.items() for x in pair)) if len(found) < 200 else None
    if target is None:
        pairs = docs.sparkSession.createDataFrame(list(above.items()), "run long, above long")
        first = first.join(pairs, "run")
    else:
        first = first.withColumn("above", target[F.col("run")])
    first = first.select(F.col("run").alias("first_run"), F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "above")
    is_first = (F.col("run") == F.col("first_run")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    marked = keyed.join(small(stored(first, "run-heads")), is_first, "left")
    own = F.struct(F.col("run"), F.lit(0).alias("extra"))
    places = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("run"), F.lit(1).alias("extra"))))
    dealt = marked.select(F.explode(places).alias("p"), "doc_id", "text_key", "text").select("p.run", "p.extra", "doc_id", "text_key", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts * 2, "run").sortWithinPartitions("run", "extra", F.desc_nulls_last("doc_id"), F.desc("text_key"))


def with_edits(docs: DataFrame, shingle: int = SHINGLE, k: int = K, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike these and the next document's are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles): the edit
    replaces the last third of a text by the start of the next document's, in descending order of id.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far, with its sketch: its successor is still to come
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                runs, extra, ids, body = (part.column(c).to_pylist() for c in (0, 1, 2, 4))
                rows = held + list(zip(runs, extra, ids, body, sketches_of(part.column(4), shingle, k), strict=True))
                held = rows[-1:]
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1]]
                changed = [edited(x[3], y[3]) for x, y in pairs]
                new = sketches_of(pa.array(changed, pa.large_string()), shingle, k)
                own = [x[4] for x, _ in pairs]
                count = [len(s) if len(s) < k else round((k - 1) * 2.0**HASH_BITS / float(s[-1])) for s in own]
                cols = [
                    pa.array([x[2] for x, _ in pairs], part.schema.field(2).type), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([_written(s) for s in own], pa.string()), pa.array([_written(s) for s in new], pa.string()),
                    pa.array([likeness(s, t, k) for s, t in zip(own, new, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4], k) for x, y in pairs], pa.float64()), pa.array(count, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles long"
    return neighbours(docs, text, id).mapInArrow(run, schema)
