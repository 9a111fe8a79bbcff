"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, cut into ``radius + exact`` ring segments. Two fingerprints within ``radius`` differing bits
agree on at least ``exact`` segments, so each choice of ``exact`` segments is a bucket key. Inside a bucket a pair must
have a *chain*: a start segment from which every run of 1, 2, 3, ... consecutive segments holds no more differing bits
than its share of the radius (length x radius / segments). By the pigeonring principle every pair within the radius has
one. Only pairs with a chain reach the full Hamming count.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import stored, text_key, text_or_empty, unused
from courtspark.llm.graph import components

BITS = 64
#: Shingles of a text are hashed in portions of this many, so a very long text needs no more memory.
PORTION = 1 << 16
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
#: One fingerprint in so many is looked at to find large buckets (this steers only the dealing out, never the result).
SAMPLE = 16
#: Rows gathered before a vectorised comparison.
GATHER = 1 << 18


def fingerprint(text: bytes, words: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included; no word gives 0."""
    tokens = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D separate
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    shingles = zip(*(itertools.islice(tokens, k, None) for k in range(words)), strict=False)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), len(tokens) - words + 1
    while part := [digest(join(s), 42) for s in itertools.islice(shingles, PORTION)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, fp): a row per document; a null text counts as empty, a null id is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ring:
    """The segments of a fingerprint, the bucket keys made of them, and the tests on a pair's difference."""

    def __init__(self, radius: int, exact: int):
        self.radius, self.parts = radius, radius + exact
        edges = [round(i * BITS / self.parts) for i in range(self.parts + 1)]
        self.shift = [np.uint64(a) for a in edges[:-1]]
        self.mask = [np.uint64((1 << (b - a)) - 1) for a, b in itertools.pairwise(edges)]
        self.chosen = [
            (np.uint64(n), np.uint64(sum(int(self.mask[i]) << int(self.shift[i]) for i in c)))
            for n, c in enumerate(itertools.combinations(range(self.parts), exact))
        ]

        self.number = np.zeros(1 << self.parts, np.int64)  # of a choice, by the set of its segments
        for n, c in enumerate(itertools.combinations(range(self.parts), exact)):
            self.number[sum(1 << i for i in c)] = n
        self.exact = exact

    def first_key(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The key of the first bucket that holds both of a linked pair: that of the first segments they share."""
        x, chosen, left = u ^ v, np.zeros(len(u), np.int64), np.full(len(u), self.exact)
        for i, (shift, mask) in enumerate(zip(self.shift, self.mask, strict=True)):
            same = ((x >> shift) & mask == 0) & (left > 0)
            chosen += same.astype(np.int64) << i
            left -= same
        n = self.number[chosen]
        masks = np.array([m for _, m in self.chosen], dtype=np.uint64)[n]
        return _mix(_mix((u & masks) + n.astype(np.uint64)) ^ n.astype(np.uint64))

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """One column per choice of segments. Keys are hashes: a clash only adds a candidate."""
        return np.stack([_mix(_mix((fp & mask) + n) ^ n) for n, mask in self.chosen], axis=1)

    def linked(self, x: np.ndarray) -> np.ndarray:
        """Which of the differences ``x`` have a chain and then at most ``radius`` bits."""
        out, at = np.zeros(len(x), bool), np.arange(len(x))
        d = np.stack([np.bitwise_count((x >> s) & m) for s, m in zip(self.shift, self.mask, strict=True)])
        alive, total = np.ones(d.shape, bool), np.zeros(d.shape, np.uint8)
        for length in range(1, self.parts):
            total = total + np.roll(d, 1 - length, axis=0)  # row s: differing bits of the chain that starts at segment s
            alive &= total <= length * self.radius // self.parts
            some = alive.any(axis=0)
            if not some.all():
                at, d, alive, total = at[some], d[:, some], alive[:, some], total[:, some]
            if not len(at):
                return out
        out[at] = np.bitwise_count(x[at]) <= self.radius
        return out


def _spanned(fp: np.ndarray, ring: Ring) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the linked parts of one bucket: at most one fewer than rows, found breadth first."""
    left, out = fp, []
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            here = queue.pop()
            for n, one in enumerate(here):
                hit = ring.linked(left ^ one)
                if hit.any():
                    found, left = left[hit], left[~hit]
                    out.append((np.repeat(one, len(found)), found))
                    queue += [here[n + 1 :], found]
                    break
    return out


def _compared(key: np.ndarray, fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, u, v) of links among rows of equal key (sorted by key). Buckets without links are compared pair by pair in vectors; a
    bucket that shows a link within its first rows is spanned instead, so a group of copies never yields all its pairs."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], len(key))
    room = np.repeat(ends, ends - starts) - np.arange(len(key))  # rows of the bucket from here on
    bucket = np.repeat(np.arange(len(starts)), ends - starts)
    out_k, out_u, out_v, lag = [], [], [], 1
    at = np.flatnonzero(room > 1)
    while len(at):
        hit = ring.linked(fp[at] ^ fp[at + lag])
        if hit.any():
            i = at[hit]
            wide = (ends - starts)[bucket[i]] > 4
            out_k.append(key[i[~wide]])
            out_u.append(fp[i[~wide]])
            out_v.append(fp[i[~wide] + lag])
            for b in np.unique(bucket[i[wide]]):
                for u, v in _spanned(fp[starts[b] : ends[b]], ring):
                    out_k.append(np.full(len(u), key[starts[b]]))
                    out_u.append(u)
                    out_v.append(v)
            spanned = np.unique(bucket[i[wide]])
            at = at[~np.isin(bucket[at], spanned)]
        lag += 1
        at = at[room[at] > lag]
    if not out_u:
        return np.empty(0, key.dtype), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(out_k), np.concatenate(out_u), np.concatenate(out_v)


def links(fps: DataFrame, radius: int, exact: int) -> DataFrame:
    """(u, v) longs: links whose components are those of all pairs of distinct ``fp`` within ``radius`` bits.

    A link is left to the first bucket that its pair shares. Nothing gets lost: that bucket connects the pair as well,
    by links of its own or of still earlier buckets.
    """
    ring = Ring(radius, exact)

    def dealt_key(key, n, one, other):
        """The key of the part of a large bucket where two blocks meet."""
        return _mix(key + _mix(np.minimum(one, other) * np.uint64(1 << 20) + np.maximum(one, other) + np.uint64(1)))

    def parts_of(key):
        at = np.minimum(np.searchsorted(large_key, key), len(large_key) - 1)
        return np.where(large_key[at] == key, large_parts[at], np.uint64(1))

    def first_bucket(u, v):
        key = ring.first_key(u, v)
        if not len(large_key):
            return key
        n = parts_of(key)
        return np.where(n > 1, dealt_key(key, n, _mix(u) % n, _mix(v) % n), key)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(every), 1024):
                fp = every[a : a + 1024]
                keys = ring.keys(fp)
                row, key = np.repeat(fp, keys.shape[1]), keys.reshape(-1)
                if len(large_key):
                    parts = parts_of(key)
                    dealt = parts > 1
                    n, big_row, big_key = parts[dealt], row[dealt], key[dealt]
                    own, times = _mix(big_row) % n, n.astype(np.int64)
                    again = np.repeat(np.arange(len(n)), times)
                    other = (np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
                    row = np.concatenate([row[~dealt], big_row[again]])
                    key = np.concatenate([key[~dealt], dealt_key(big_key[again], n[again], own[again], other)])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(row.view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(key, fp):
            bucket, u, v = _compared(key, fp.view(np.uint64), ring)
            own = first_bucket(u, v) == bucket.view(np.uint64)
            u, v = u[own], v[own]
            pairs = np.unique(np.stack([u.view(np.int64), v.view(np.int64)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= GATHER:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
                held, size = [(key[cut:], fp[cut:])], len(key) - cut
                if cut:
                    yield emitted(key[:cut], fp[:cut])
        if size:
            yield emitted(*(np.concatenate(x) for x in zip(*held, strict=True)))

    large_key, large_parts = np.empty(0, np.uint64), np.empty(0, np.uint64)
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    # the largest buckets, estimated on a fixed share of the fingerprints; 10,000 at most are dealt out
    seen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(keyed, "key long, fp long").groupBy("key").count()
    large = seen.where(F.col("count") * SAMPLE > BLOCK).orderBy(F.desc("count"), "key").limit(10_000).collect()
    if large:
        order = sorted((r[0] % (1 << 64), -(-r[1] * SAMPLE // BLOCK)) for r in large)
        large_key, large_parts = (np.array(x, dtype=np.uint64) for x in zip(*order, strict=True))
    rows = distinct.mapInArrow(keyed, "key long, fp long")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts * 2, "key").sortWithinPartitions("key", "fp").mapInArrow(compare, "u long, v long")


def near_groups(docs: DataFrame, words: int = 5, radius: int = 8, exact: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, fp, label, component_id): documents linked, directly or over others, by ``radius`` or fewer bits.

    ``component_id`` is the smallest id of the group (null only if all its ids are null). Empty texts have fingerprint
    0 and are linked like any other; ``label`` names the group by a fingerprint; repeated rows share their group; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, words, text, id), "simhash")
    label = components(links(fps, radius, exact))
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    per_fp = per_fp.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    per_fp = stored(per_fp, "simhash-groups")
    group = per_fp.groupBy("label").agg(F.min("low").alias("component_id"))
    return fps.join(per_fp.join(group, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "text_key", "fp", "label", "component_id")


def one_per_group(docs: DataFrame, words: int = 5, radius: int = 8, exact: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest (id, text key) stays.

    A group whose ids are all null keeps one row; identical rows count once. All columns are kept.
    """
    groups = near_groups(docs, words, radius, exact, text, id)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("k")
    kept_id, kept_key, own_key = unused(docs, "kept_id", "kept_key", "own_key")
    kept = groups.groupBy("label").agg(first).select(F.col("k.doc_id").alias(kept_id), F.col("k.text_key").alias(kept_key))
    marked = docs.withColumn(own_key, text_key(text))
    same = F.col(id).eqNullSafe(F.col(kept_id)) & (F.col(own_key) == F.col(kept_key))
    return marked.join(stored(kept, "kept"), same, "left_semi").dropDuplicates([id, own_key]).drop(own_key)
