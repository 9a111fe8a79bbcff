"""Hard negatives by an inverted multi-index over labelled vectors.

Each half of the vectors has a codebook (k-means on a bounded sample; every row is indexed). A pair of codewords is a cell.
For an anchor each codeword has a bound, its half score plus the anchor half's length times the codeword's radius; a heap
visits the cells in order of the summed bounds (multi-sequence). Every score of the cells not yet visited is at most the
next bound, so a search stops once what it looks for lies above it: the answer is exact, whatever the codebooks.

Rows are dealt by hash into shards of about ``SHARD_ROWS`` and anchors into blocks of about ``BLOCK_ANCHORS``; a task holds
one shard's index and streams one block's anchors past it, so neither rows of one label nor all anchors ever meet in a
task. A first pass finds each anchor's best rows of its own label, a second the windows below them; both merge the few
rows that each shard hands on.

Cases: rows with a null id, a null label, a null vector or any null or non-finite component take no part. Rows repeated in
id, label and vector count once; rows that only share the id are rows of their own, and equal scores of the same id go by
label and vector. Shorter vectors are filled up with zeros. Scores are exact 64-bit integers (vectors whose products pass
that are an error). Fewer positives or negatives than asked for give what there is; an empty table gives no rows.
Columns of the caller don't clash, as only the named ones are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm.common import lowest, stored

#: Rows that the codebooks are fitted on, at most, and codewords of a half.
FIT_ROWS, CODEWORDS = 20_000, 16
#: Rows of a shard and anchors of a block, about.
SHARD_ROWS, BLOCK_ANCHORS = 16_384, 16_384
#: Rows scored at once before the stopping rule is looked at again.
VISIT_ROWS = 1_024


def exact_type(peak: int, width: int):
    """A number type in which inner products of integers up to ``peak`` are exact."""
    most = max(1, width) * max(1, peak) ** 2
    if most >= 1 << 63:
        raise ValueError("inner products pass 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """At most ``k`` centres by Lloyd's rounds; always at least one."""
    x = np.unique(x, axis=0) if len(x) else np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        code = nearest(x, centres)
        for c in np.unique(code):
            centres[c] = x[code == c].mean(0)
    return centres


@dataclass
class Index:
    """Rows of one shard by cell, then label; the halves' radii are those of this shard's rows."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, books: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Index:
        cut, codes, radii = books[0].shape[1], [], []
        for half, book in zip((x[:, :cut], x[:, cut:]), books, strict=True):
            half = half.astype(np.float64)
            code, radius = nearest(half, book), np.zeros(len(book))
            np.maximum.at(radius, code, np.sqrt(((half - book[code]) ** 2).sum(1)))
            codes.append(code)
            radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((labels, cell))
        first = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        return cls(books, (radii[0], radii[1]), ids[order], keys[order], labels[order], x[order], first)

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling bound; no row of a cell scores above its bound."""
        cut, ranked = self.books[0].shape[1], []
        for half, book, radius in zip((q[:cut], q[cut:]), self.books, self.radii, strict=True):
            half = half.astype(np.float64)
            bound = book @ half + np.sqrt(half @ half) * radius
            order = np.argsort(-bound, kind="stable")
            ranked.append((bound[order].tolist(), order.tolist()))
        (one, code_1), (two, code_2) = ranked
        slack = 1 + 1e-9 * (abs(one[0]) + abs(two[0]) + abs(one[-1]) + abs(two[-1]))  # of rounding
        heap, done = [(-one[0] - two[0], 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield slack - bound, code_1[i] * len(two) + code_2[j]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(one) and b < len(two) and (a, b) not in done:
                    done.add((a, b))
                    heapq.heappush(heap, (-one[a] - two[b], a, b))

    def visits(self, q: np.ndarray, label: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(rows, their scores, bound of what is left) cell by cell, of the anchor's label or of all others."""
        rows: list[np.ndarray] = []
        held = 0
        for bound, cell in self.cells(q):
            if held >= VISIT_ROWS:
                at = np.concatenate(rows)
                yield at, (self.vectors[at] @ q).astype(np.int64), bound
                rows, held = [], 0
            a, b = self.first[cell], self.first[cell + 1]
            if a < b:
                low, high = (a + np.searchsorted(self.labels[a:b], label, side) for side in ("left", "right"))
                rows += [np.arange(low, high)] if same else [np.arange(a, low), np.arange(high, b)]
                held += sum(len(r) for r in rows[-2 + same :])
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield at, (self.vectors[at] @ q).astype(np.int64), -np.inf

    def _best(self, at: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.keys[at], self.ids[at], -score))[:n]
        return at[order], score[order]

    def positives(self, q: np.ndarray, label: int, id: int, key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``n`` best other rows of the label."""
        top, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, s, left in self.visits(q, label, True):
            own = (self.ids[at] == id) & (self.keys[at] == key)
            top, score = self._best(np.concatenate([top, at[~own]]), np.concatenate([score, s[~own]]), n)
            if len(top) == n and score[-1] > left:
                break
        return top, score

    def windows(self, q: np.ndarray, label: int, highs: np.ndarray, lows: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the ``n`` best rows of other labels for each window of scores."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in highs]
        for at, s, left in self.visits(q, label, False):
            for k, (high, low) in enumerate(zip(highs, lows, strict=True)):
                fit = np.flatnonzero((s <= high) & (s >= low))
                if len(fit):
                    out[k] = self._best(np.concatenate([out[k][0], at[fit]]), np.concatenate([out[k][1], s[fit]]), n)
            if all(left < low or len(found[0]) == n and found[1][-1] > left for found, low in zip(out, lows, strict=True)):
                break
        return out


def prepared(rows: DataFrame, vector: str, id: str, label: Column) -> DataFrame:
    """(id, key, label, x): the rows that take part, components as integers, repeated rows once."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    huge = F.exists(vector, lambda v: F.abs(v.cast("double")) >= F.lit(1e16))
    told = F.when(~whole, False).when(huge, F.raise_error(F.lit("inner products pass 64 bits"))).otherwise(True)
    kept = rows.where(F.col(id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()).where(told)
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * 256).cast("bigint"))
    kept = kept.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x"))
    return kept.withColumn("key", F.xxhash64("label", "x"))


def _paired(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, parallel: int) -> DataFrame:
    """Every shard's rows, then every block's anchors, for each pair of shard and block, in one task each."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = rows.select(deal(shards).alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), "id", "key", "label", "x", F.lit(None).cast("array<bigint>").alias("highs"))
    other = anchors.select(every(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "key", "label", "x", "highs")
    both = side.unionByName(other).repartition(max(parallel, shards * blocks), "shard", "block")
    return both.sortWithinPartitions("shard", "block", "kind", "id", "key")


FOUND = "anchor bigint, anchor_key bigint, slot int, id bigint, key bigint, score bigint"


def _searched(pairs: DataFrame, books: tuple, width: int, kind, n: int) -> DataFrame:
    """Candidates of each shard: for anchors without ``highs`` the best of their label, else the best of each window."""
    ship = pairs.sparkSession.sparkContext.broadcast(books)  # two codebooks of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        index, at = None, None
        for b in batches:
            place = np.stack([b.column(k).to_numpy() for k in (0, 1, 2)], axis=1)
            cuts = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                x = dense(part.column(6), width).astype(kind)
                ids, keys, labels = (part.column(k).to_numpy() for k in (3, 4, 5))
                if at != tuple(place[lo][:2]):
                    held, index, at = {"ids": [], "keys": [], "labels": [], "x": []}, None, tuple(place[lo][:2])
                if place[lo][2] == 0:
                    for name, value in zip(held, (ids, keys, labels, x), strict=True):
                        held[name].append(value)
                    continue
                if not held["ids"]:
                    continue
                if index is None:
                    index = Index.of(ship.value, *once(*(np.concatenate(v) for v in held.values())))
                yield found(index, ids, keys, labels, x, part.column(7).to_pylist(), n)

    return pairs.mapInArrow(run, FOUND)


def once(ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple:
    """Without repeated rows; they come next to each other."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return ids[new], keys[new], labels[new], x[new]


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter lists end in zeros."""
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(values) == width * len(lists):
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def lowest_score(high: int, part: int) -> int:
    """Smallest score of at least ``part`` hundredths of ``high``."""
    return -(-part * high // 100)


def found(index: Index, ids, keys, labels, x, highs: list, n: int, part: int = 80) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(6)]
    for k in range(len(ids)):
        if highs[k] is None:
            parts = [index.positives(x[k], labels[k], ids[k], keys[k], n)]
        else:
            parts = index.windows(x[k], labels[k], np.array(highs[k]), np.array([lowest_score(h, part) for h in highs[k]]), n)
        for slot, (at, score) in enumerate(parts):
            for column, value in zip(out, ([ids[k]] * len(at), [keys[k]] * len(at), [slot] * len(at), index.ids[at], index.keys[at], score), strict=True):
                column.extend(value)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64), pa.int64()).cast(t) for v, t in zip(out, kinds, strict=True)], ["anchor", "anchor_key", "slot", "id", "key", "score"])


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column | str = "label", vector: str = "embedding", id: str = "vec_id", positives: int = 5, negatives: int = 5,
    shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS, codewords: int = CODEWORDS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    ``anchor`` is a condition on the column ``id``. Negatives are rows of another label whose score is from 80 hundredths
    of the positive's up to it, best first.
    """
    n = max(positives, negatives)
    spark = rows.sparkSession
    all_rows = stored(prepared(rows, vector, id, F.col(label) if isinstance(label, str) else label), "vectors")
    peak = F.greatest(F.abs(F.coalesce(F.array_max("x"), F.lit(0))), F.abs(F.coalesce(F.array_min("x"), F.lit(0))))
    count, width, most, queries = all_rows.agg(F.count("*"), F.max(F.size("x")), F.max(peak), F.count_if(anchor)).first()
    kind = exact_type(most or 0, width or 0)
    drawn = lowest(all_rows, F.col("key"), FIT_ROWS, count).select("x").collect()
    sample = np.zeros((len(drawn), width or 0))
    for k, r in enumerate(drawn):
        sample[k, : len(r.x)] = r.x
    cut = (width or 0) // 2
    books = (codebook(sample[:, :cut], codewords), codebook(sample[:, cut:], codewords))
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-queries // block_anchors))
    parallel = spark.sparkContext.defaultParallelism
    blocks = max(blocks, min(-(-parallel // shards), -(-queries // 64)))  # a small table still gives every core some anchors
    chosen = all_rows.where(anchor).dropDuplicates(["id", "key"])

    def best(df: DataFrame, keep: int) -> DataFrame:
        order = Window.partitionBy("anchor", "anchor_key", "slot").orderBy(F.desc("score"), "id", "key")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    first = _searched(_paired(all_rows, chosen.withColumn("highs", F.lit(None).cast("array<bigint>")), shards, blocks, parallel), books, width or 0, kind, positives)
    top = stored(best(first, positives).select("anchor", "anchor_key", (F.col("rank") - 1).alias("slot"), "id", "score"), "positives")
    highs = top.groupBy("anchor", "anchor_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "score"))), lambda p: p["score"]).alias("highs"))
    asked = chosen.join(highs, (F.col("id") == F.col("anchor")) & (F.col("key") == F.col("anchor_key"))).select("id", "key", "label", "x", "highs")
    second = _searched(_paired(all_rows, asked, shards, blocks, parallel), books, width or 0, kind, negatives)
    below = best(second, negatives).select("anchor", "anchor_key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    top = top.select("anchor", "anchor_key", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    columns = [F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return below.join(top, ["anchor", "anchor_key", "slot"]).select(*columns)


SQL = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
long AS (SELECT vec_id, label, unnest(range(len(x))) AS k, unnest(x) AS v FROM part),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
         CAST(sum(a.v * b.v) AS BIGINT) AS score
  FROM long a JOIN long b ON a.k = b.k AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE anchor_label = other_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.anchor_label <> s.other_label
  AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
