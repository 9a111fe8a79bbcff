"""Ranked lexical search with per-term geometric blocks and exact summary bounds.

Documents become vectors over the terms of the items: a coordinate is the saturated frequency of a term. They are read
in runs of bounded size. In a run the documents of a term are clustered by the likeness of their whole vectors into
blocks; a block's summary is the largest value of each coordinate, so an item's product with it is at least the score of
each document inside. An item goes through its terms from the one that can give most, passes over the blocks whose bound
is below its twentieth best score so far, and ends when the remaining terms together can't reach that score. Nothing
else is left out, so the ranking is exact. Best scores are carried from run to run in a task; a task hands on at most
``k`` documents for each item.

Terms are the runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased. They
are compared by a 64-bit hash. Counts (documents, terms, document frequencies) cover all documents.

Cases: a null or empty text has no terms; an item without terms or without a document above score 0 gives no rows. Texts
of any length are read whole, in pieces. A repeated document is ranked as often as it stands there; an item repeated with
the same text is ranked once, items that share only the id each. Equal scores go by the integer document id, null last. An
empty table gives no rows. Columns of the caller don't clash, as only the named ones are read. Items are taken in parts of
about ``ITEM_BYTES``, whose terms are sent to every task; each part reads the documents once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm import words
from courtspark.llm.common import stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of item texts handled at once.
ITEM_BYTES = 4 << 20
#: Documents and postings of a run, and documents of a block, about.
RUN_DOCS, RUN_POSTINGS, BLOCK = 8_192, 1 << 20, 64
SKETCH = 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_READ = words.LOWER.copy()
_READ[[c for c in range(128) if not chr(c).isalnum()]] = 32
_SOLID = _READ != 32


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


@dataclass
class Items:
    """Items of one part: numbered terms (by hash) and each item's terms with how often they stand there."""

    ids: list
    hashes: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        counted = [Counter(terms_of(text)) for _, text in rows]
        vocabulary = sorted(set().union(*counted)) if counted else []
        texts = pa.array([" ".join(vocabulary)], pa.large_string())
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if vocabulary else np.zeros(0, np.uint8)
        starts, ends, _ = words.spans(raw, np.array([0, len(raw)]))
        value = words.hashes(raw, starts, ends) if vocabulary else np.zeros(0, np.uint64)
        hashes, number = np.unique(value, return_inverse=True)
        of = dict(zip(vocabulary, number.tolist(), strict=True))
        terms = [np.array([of[t] for t in c], np.int64) for c in counted]
        return cls([r[0] for r in rows], hashes, terms, [np.array(list(c.values()), np.int64) for c in counted])


def counted(texts: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text; text, term, times of the known ones), ordered by text and term."""
    size = np.zeros(len(texts), np.int64)
    keys, times, many = [], [], max(1, len(hashes))
    for a, raw, offs in words.pieces(texts, _SOLID):
        read = _READ[raw]
        starts, ends, first = words.spans(read, offs)
        size[a : a + len(offs) - 1] += np.diff(first)
        if len(starts) and len(hashes):
            value = words.hashes(read, starts, ends)
            at = np.minimum(np.searchsorted(hashes, value), many - 1)
            hit = np.flatnonzero(hashes[at] == value)
            text = a + np.searchsorted(first, hit, side="right") - 1
            key, n = np.unique(text * many + at[hit], return_counts=True)
            keys.append(key)
            times.append(n)
    if not keys:
        none = np.zeros(0, np.int64)
        return size, none, none, none
    key, back = np.unique(np.concatenate(keys), return_inverse=True)  # pieces of one text meet here
    n = np.bincount(back, np.concatenate(times)).astype(np.int64)
    return size, key // many, key % many, n


def postings(docs: DataFrame, items: Items, text: str, id: str) -> DataFrame:
    """(doc_id, n, terms, times) of every document with at least one term; terms are those of the items."""
    ship = docs.sparkSession.sparkContext.broadcast(items.hashes)  # terms of at most about ITEM_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, doc, term, n = counted(b.column(1), ship.value)
            cuts = pa.array(np.searchsorted(doc, np.arange(len(size) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (term, n)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *lists], ["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(size > 0))

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def frequencies(found: DataFrame, many: int) -> np.ndarray:
    """Documents that hold each term: summed up by task, then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=many)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(many, np.int64)
    for r in found.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df  # one row for each term of the items
    return out


@dataclass
class Blocks:
    """One term's documents by block, and the blocks' summaries ordered by coordinate."""

    docs: np.ndarray
    first: np.ndarray
    coordinate: np.ndarray
    block: np.ndarray
    most: np.ndarray

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Product of an item with each summary; ``terms`` are ordered."""
        low, high = np.searchsorted(self.coordinate, terms), np.searchsorted(self.coordinate, terms, side="right")
        at = runs(low, high - low)
        return np.bincount(self.block[at], np.repeat(weights, high - low) * self.most[at].astype(np.float64), len(self.first) - 1)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Run:
    """Vectors of a run of documents, by document and by term; blocks are formed when a term is first asked for."""

    ids: np.ndarray
    first: np.ndarray
    term: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    made: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        sizes = np.diff(self.first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(self.term, kind="stable")
        self.listed = doc[order]
        self.starts = np.searchsorted(self.term[order], np.arange(len(self.weight) + 1))
        self.most = np.zeros(len(self.weight), np.int64)
        np.maximum.at(self.most, self.term, self.value)
        sign = np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (len(self.weight), SKETCH))
        self.sketch = np.zeros((len(sizes), SKETCH), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            part = sign[self.term] * (self.weight[self.term] * self.value).astype(np.float32)[:, None]
            self.sketch[some] = np.add.reduceat(part, self.first[some], axis=0)
        self.sketch /= np.sqrt((self.sketch**2).sum(1, keepdims=True)) + np.float32(1e-9)
        self.used = np.flatnonzero(np.diff(self.starts))
        self.column = np.zeros(len(self.weight), np.int64)
        self.column[self.used] = np.arange(len(self.used))

    def blocks(self, term: int) -> Blocks:
        if term not in self.made:
            docs = self.listed[self.starts[term] : self.starts[term + 1]]
            many = -(-len(docs) // BLOCK)
            centres = self.sketch[docs[:: -(-len(docs) // many)]]
            code = (self.sketch[docs] @ centres.T).argmax(1)
            order = np.argsort(code, kind="stable")
            found, first = np.unique(code[order], return_index=True)
            docs, block = docs[order], np.searchsorted(found, code[order])
            sizes = self.first[docs + 1] - self.first[docs]
            at = runs(self.first[docs], sizes)
            summary = np.zeros((len(self.used), len(found)), np.int32)
            np.maximum.at(summary.reshape(-1), self.column[self.term[at]] * len(found) + np.repeat(block, sizes), self.value[at].astype(np.int32))
            column, number = np.nonzero(summary)
            self.made[term] = Blocks(docs, np.append(first, len(docs)), self.used[column], number, summary[column, number])
        return self.made[term]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; ``weights`` holds the item's weight of every term. Each document has at least one term."""
        sizes = self.first[docs + 1] - self.first[docs]
        at = runs(self.first[docs], sizes)
        return np.add.reduceat(weights[self.term[at]] * self.value[at], np.cumsum(sizes) - sizes)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Adds this run's documents to an item's best ones."""
        own = self.weight[terms] * times
        gain = own * self.most[terms]
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0]
        rest = np.cumsum(gain[order][::-1])[::-1]
        weights = np.zeros(len(self.weight), np.int64)
        weights[terms] = own
        up = np.argsort(terms)
        seen = np.zeros(len(self.ids), bool)
        for k, left in zip(order, rest, strict=True):
            if left < best.least:
                break
            blocks = self.blocks(int(terms[k]))
            bound = blocks.bounds(terms[up], own[up].astype(np.float64))
            line = np.argsort(-bound, kind="stable")
            a, step = 0, 2
            while a < len(line) and bound[line[a]] >= best.least:
                some = line[a : a + step]
                some = some[bound[some] >= best.least]
                docs = blocks.docs[runs(blocks.first[some], blocks.first[some + 1] - blocks.first[some])]
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    best.add(self.scores(docs, weights), self.ids[docs])
                a, step = a + step, 2 * step


NO_ID = np.iinfo(np.int64).max


@dataclass
class Best:
    """The ``k`` best (score, id) so far, ids ascending among equals, and the score that a newcomer must reach."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: int = 1

    def add(self, score: np.ndarray, id: np.ndarray) -> None:
        fit = score >= self.least
        score, id = np.concatenate([self.score, score[fit]]), np.concatenate([self.id, id[fit]])
        order = np.lexsort((id, -score))[: self.k]
        self.score, self.id = score[order], id[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _ranked(found: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents."""
    n, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(found, len(items.hashes))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    ship = found.sparkSession.sparkContext.broadcast((items, weight))

    def vectors(size: np.ndarray, terms: pa.ListArray, times: pa.ListArray) -> np.ndarray:
        m = 100 - 25 + 25 * size * n // total
        tf = times.flatten().to_numpy().astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, terms.value_lengths().to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = ship.value
        best = [Best(k) for _ in own.ids]
        for ids, size, terms, times in gathered(batches):
            one = Run(ids, np.append(0, np.cumsum(terms.value_lengths().to_numpy())).astype(np.int64), terms.flatten().to_numpy().astype(np.int64), vectors(size, terms, times), weights)
            for item in range(len(own.ids)):
                one.search(own.terms[item], own.times[item], best[item])
        item = np.repeat(np.arange(len(best)), [len(b.id) for b in best])
        id, score = (np.concatenate([np.zeros(0, np.int64), *(getattr(b, x) for b in best)]) for x in ("id", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(id, mask=id == NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    return found.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id bigint, score bigint")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.ListArray, pa.ListArray]]:
    """(ids, sizes, terms, times) of runs of documents of bounded size; one document may be larger."""
    held: list[pa.RecordBatch] = []
    docs = known = 0

    def joined() -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        id, size, terms, times = (t.column(c).chunk(0) for c in ("doc_id", "n", "terms", "times"))
        return id.fill_null(NO_ID).to_numpy(), size.to_numpy(), terms, times

    for b in batches:
        while b.num_rows:
            ends = np.cumsum(b.column(2).value_lengths().to_numpy())
            fit = min(RUN_DOCS - docs, int(np.searchsorted(ends, RUN_POSTINGS - known, side="right")))
            fit = min(b.num_rows, max(fit, 0 if held else 1))
            if fit:
                held.append(b.slice(0, fit))
                docs, known = docs + fit, known + int(ends[fit - 1])
            if fit < b.num_rows:
                yield joined()
                held, docs, known = [], 0, 0
            b = b.slice(fit)
    if held:
        yield joined()


def search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, exact."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where(F.coalesce(F.col("item_text"), F.lit("")) != "").distinct()
    asked = stored(asked, "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // ITEM_BYTES))
    out = []
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == part)
        rows = sorted(((r.item_id, r.item_text) for r in mine.collect()), key=repr)  # about ITEM_BYTES
        own = Items.of(rows)
        found = stored(postings(docs, own, text, id), "postings")
        names = docs.sparkSession.createDataFrame([(n, x) for n, x in enumerate(own.ids)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = _ranked(found, own, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names of one part
    return reduce(DataFrame.unionByName, out)


SQL = """
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
tokens AS (
  SELECT row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
counts AS (SELECT row, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(t.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counts, totals t GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
terms AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scores AS (
  SELECT q.item_id, c.row,
         CAST(sum(q.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (100 - 25 + (25 * s.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM terms q JOIN counts c USING (term) JOIN weights w USING (term) JOIN sizes s ON s.row = c.row, totals t
  GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN docs USING (row) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
