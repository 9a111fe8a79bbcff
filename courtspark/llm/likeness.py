"""Near-duplicates by the Jaccard similarity of word shingles.

Texts of equal shingle sets are one node. Nodes meet in buckets of equal min-hash bands and in groups that the caller
found otherwise, such as those of SimHash; pairs that meet are verified by the exact similarity of their texts. With 25
bands of 4 hashes a pair of similarity s misses every bucket with probability (1 - s^4)^25: 2 in a million at 0.8, less
above. A bucket is first connected by a few pairs a node; only nodes of it that are then in different groups are compared
with each other, those of large buckets inside tasks, which hand on no more links than it takes to span the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm import words as W
from courtspark.llm.common import stored, text_key, text_or_empty, unused
from courtspark.llm.graph import components

BANDS, DEEP = 25, 4
#: Centres that each node is compared with first.
FIRST = 2
#: Nodes up to which a bucket is compared pair by pair; linked larger ones are compared in tiles of two blocks of about BLOCK nodes.
WIDE, BLOCK = 16, 1024
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, size=(BANDS * DEEP, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; letter case of A-Z doesn't matter, a shorter text is one shingle."""
    for a, b, raw, offs in W.chunks(texts):
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        starts, ends, first = W.spans(raw, offs)
        text, h = W.shingles(W.hashes(raw, starts, ends), first, words) if len(starts) else (np.empty(0, np.int64), np.empty(0, np.uint64))
        at = np.searchsorted(text, np.arange(b - a + 1))
        for s, e in zip(at[:-1], at[1:], strict=True):
            yield np.unique(h[s:e])


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys of non-empty sets, a row each."""
    at = np.cumsum([0, *map(len, sets)])[:-1]
    h = np.concatenate(sets)
    low = np.stack([np.minimum.reduceat((h ^ flip) * odd, at) for flip, odd in _SEEDS], axis=1)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
    for k in range(DEEP):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, k::DEEP])
    return key


def signatures(docs: DataFrame, words: int, text: str, id: str) -> DataFrame:
    """(doc_id, text_key, node, size, bands): ``node`` names the shingle set (0: empty), which has ``size`` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(2), words))
            node = [xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
            bands, full = [[] for _ in sets], [i for i, s in enumerate(sets) if len(s)]
            for a in range(0, len(full), 256):
                part = full[a : a + 256]
                for i, keys in zip(part, _bands([sets[i] for i in part]), strict=True):
                    bands[i] = keys.view(np.int64)
            cols = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "text_key", "node", "size", "bands"])

    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, text_key long, node long, size long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The ``pairs`` (u, v) whose texts have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(shingle_sets(b.column(2), words), shingle_sets(b.column(3), words), strict=True)
            good = pa.array([similarity(x, y) >= least for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["u", "v"])

    one = texts.select(F.col("node").alias("u"), F.col("text").alias("one"))
    other = texts.select(F.col("node").alias("v"), F.col("text").alias("other"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "one", "other").mapInArrow(run, "u long, v long")


def spanned(node: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that span the similar parts of a set of nodes: each is held against all that no earlier one has reached."""
    at = np.cumsum([0, *map(len, sets)])[:-1]
    size, (names, of) = np.array([len(s) for s in sets]), np.unique(np.concatenate(sets), return_inverse=True)
    mark, left, out = np.zeros(len(names), bool), np.arange(len(node)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            own = of[at[one] : at[one] + size[one]]
            ids = of if len(left) == len(node) else np.concatenate([of[at[i] : at[i] + size[i]] for i in left])
            mark[own] = True
            both = np.add.reduceat(mark[ids].astype(np.int64), np.cumsum([0, *size[left]])[:-1])
            mark[own] = False
            hit = both / (size[one] + size[left] - both) >= least
            out += [(int(node[one]), int(node[i])) for i in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def _spanned_crowds(crowd: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(u, v): links that connect what is similar within each crowd; any two of its nodes meet in a tile of two blocks."""
    parts = crowd.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    rows = crowd.join(parts, "crowd").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("node", "crowd", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(texts, "node")

    def run(table):
        sets = [s for c in table.column("text").chunks for s in shingle_sets(c, words)]
        found = spanned(table.column("node").to_numpy(), sets, least)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.groupBy("crowd", "low", "high").applyInArrow(run, "u long, v long")


def _grouped(sigs: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, size, key): a bucket for each of the ``groups`` (text_key, label). Nodes and groups depend on the text alone."""
    rows = sigs.where("size > 0").select("text_key", "node", "size").distinct().join(groups.select("text_key", "label").distinct(), "text_key")
    return rows.select("node", "size", F.xxhash64("label").alias("key")).distinct()


def links(sigs: DataFrame, docs: DataFrame, words: int, least: float, text: str, id: str, groups: DataFrame | None = None) -> DataFrame:
    """(u, v): links whose components are those of all nodes that share a bucket and have similarity ``least`` or more."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("k")
    nodes = sigs.where("size > 0").groupBy("node").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "likeness-nodes")
    rows = nodes.select("node", "size", F.explode("bands").alias("key"))
    if groups is not None:
        rows = rows.unionByName(stored(_grouped(sigs, groups), "likeness-groups"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = stored(rows.join(shared, "key"), "likeness-buckets")
    met = rows.select("node").distinct()
    named = nodes.join(met, "node", "left_semi").select("node", F.col("k.doc_id").alias("own_id"), F.col("k.text_key").alias("own_key"))
    full = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    texts = stored(full.join(named, same).dropDuplicates(["node"]).select("node", "text"), "likeness-texts")
    near = f"least(size, other_size) >= {least} * greatest(size, other_size)"

    # first each node with the centres of some of its buckets, which joins most groups at once
    centre = F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.struct("node", "size").alias("c")))
    centre = rows.groupBy("key").agg(centre.alias("m")).select("key", F.col("m.c.node").alias("v"), F.col("m.c.size").alias("other_size"))
    met_centre = rows.join(centre, "key").where(f"node <> v and {near}")
    chosen = met_centre.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("v").alias("h"), "v"))), 1, FIRST).alias("some"))
    tested = chosen.select("node", F.explode("some.v").alias("v")).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
    tested = stored(tested, "likeness-pairs")
    linked = stored(_verified(tested, texts, words, least), "likeness-links")

    # then whatever shares a bucket and is not yet in one group: large buckets in tiles inside tasks, others pair by pair
    label = stored(components(linked).withColumnRenamed("label", "low"), "likeness-labels")
    labelled = rows.join(label, "node", "left").withColumn("label", F.coalesce("low", "node")).drop("low")
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre"), F.min("label").alias("a"), F.max("label").alias("b"))
    left = stored(labelled.join(mixed.where("a < b").select("key", "n", "centre"), "key"), "likeness-open")
    crowd = components(left.where(F.col("n") > WIDE).select(F.col("node").alias("u"), F.col("centre").alias("v")))
    crowd = stored(crowd.withColumnRenamed("label", "crowd"), "likeness-crowds")
    linked = linked.unionByName(stored(_spanned_crowds(crowd, texts, words, least), "likeness-links"))
    small = left.where(F.col("n") <= WIDE).join(crowd, "node", "left").withColumn("crowd", F.coalesce("crowd", "node"))
    apart = small.groupBy("key").agg(F.min("crowd").alias("a"), F.max("crowd").alias("b")).where("a < b").select("key")
    small = small.join(apart, "key")
    other = small.select("key", F.col("node").alias("v"), F.col("size").alias("other_size"), F.col("label").alias("other_label"), F.col("crowd").alias("other_crowd"))
    pairs = small.join(other, "key").where(f"label <> other_label and crowd <> other_crowd and node < v and {near}")
    pairs = pairs.select(F.col("node").alias("u"), "v").distinct().join(tested, ["u", "v"], "left_anti")
    return linked.unionByName(_verified(stored(pairs, "likeness-pairs"), texts, words, least))


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, text: str = "text", id: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, label): documents of equal ``label`` are linked, directly or over others, by similarity ``least``.

    Texts that share one of the ``groups`` (text_key, label) are compared too, besides those that share a bucket. A null text counts as empty, texts without words are alike, repeated rows share their group, an empty table gives an
    empty result.
    """
    sigs = stored(signatures(docs, words, text, id), "likeness")
    label = components(links(sigs, docs, words, least, text, id, groups))
    joined = sigs.select("doc_id", "text_key", "node").join(label, "node", "left")
    return joined.select("doc_id", "text_key", F.coalesce("label", "node").alias("label"))


def one_per_group(docs: DataFrame, words: int = 5, least: float = 0.8, text: str = "text", id: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """The documents without near-duplicates: of each group of ``near_groups`` the row with the smallest (id, text key) stays.

    A group whose ids are all null keeps one row; identical rows count once. All columns are kept.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("k")
    kept_id, kept_key, own_key = unused(docs, "kept_id", "kept_key", "own_key")
    kept = near_groups(docs, words, least, text, id, groups).groupBy("label").agg(first)
    kept = kept.select(F.col("k.doc_id").alias(kept_id), F.col("k.text_key").alias(kept_key))
    same = F.col(id).eqNullSafe(F.col(kept_id)) & (F.col(own_key) == F.col(kept_key))
    marked = docs.withColumn(own_key, text_key(text))
    return marked.join(stored(kept, "kept"), same, "left_semi").dropDuplicates([id, own_key]).drop(own_key)
