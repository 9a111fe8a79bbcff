"""Benchmark decontamination by q-gram filtering and banded alignment.

A benchmark text is cut into patterns of bounded length. A pattern of n characters that occurs in a document with at
most e edits shares at least n + 1 - q - q*e character q-grams with it (the q-gram lemma), all of them on diagonals at
most e apart. So hits are counted per pattern in overlapping diagonal bands; regions that reach the bound are verified
by an edit distance computed in a band of diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from courtspark.llm.common import text_key, text_or_empty
from courtspark.session import ship_package

Q = 10
#: Edits allowed per pattern character.
ERRORS = 0.08
#: A benchmark text of up to LONGEST characters is one pattern; a longer one gives patterns of PIECE characters at every
#: STEP, so each shared stretch of PIECE + STEP - 1 characters holds a whole pattern.
LONGEST, PIECE, STEP = 150, 100, 50
#: Characters of benchmark text that one broadcast holds; a larger benchmark is taken in blocks of this size.
BLOCK_CHARS = 8_000_000
#: Characters of document text that are looked through at once.
CHUNK = 1 << 20
_FOLD = np.array([32 if c.isspace() else ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(map(chr, range(0x3001)))], dtype=np.uint32)


def folded(text: str) -> np.ndarray:
    """Code points, lower case, white space as a plain space; position for position as in ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], codes)


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Positions in a folded text that stay if each run of white space becomes its first place."""
    space = codes == 32
    return np.flatnonzero(~(space & np.append(False, space[:-1])) if len(codes) else space)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on, put together from hashes of 1, 2, 4, ... characters."""
    n, base = len(codes) - q + 1, 0x9E3779B97F4A7C15
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out = codes.astype(np.uint64) * np.uint64(base), 1, 0, np.zeros(n, np.uint64)
    while True:
        if q & size:
            out *= np.uint64(pow(base, size, 1 << 64))
            out += power[done : done + n]
            done += size
        if done == q:
            return out
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


@dataclass
class Patterns:
    """Patterns of a block of the benchmark and the places of their q-grams, sorted by q-gram."""

    item: list
    codes: list
    edits: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    need: np.ndarray
    maybe: np.ndarray
    short: dict

    @classmethod
    def of(cls, rows: list[tuple], q: int, errors: float) -> Patterns:
        item, codes, short = [], [], {}
        for key, text in rows:
            c = folded(" ".join((text or "").split()))
            if 0 < len(c) < q:
                short.setdefault(c.tobytes(), []).append(key)
            last = len(c) - PIECE
            starts = [0] if len(c) <= LONGEST else [*range(0, last, STEP), last]
            for s in starts:
                item.append(key)
                codes.append(c[s : s + PIECE] if len(c) > LONGEST else c)
        keep = [i for i, c in enumerate(codes) if len(c) >= q]
        item, codes = [item[i] for i in keep], [codes[i] for i in keep]
        # at most as many edits as leave the bound something to say
        edits = np.array([min(int(errors * len(c)), (len(c) - q) // q) for c in codes], dtype=np.int64)
        grams = [_grams(c, q) for c in codes]
        n = np.array([len(g) for g in grams], dtype=np.int64)
        gram = np.concatenate([*grams, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(codes)), n)
        place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(gram, kind="stable")
        need = np.array([len(c) for c in codes], dtype=np.int64) + 1 - q - q * edits
        maybe = np.zeros(1 << 22, bool)
        maybe[gram >> np.uint64(42)] = True
        return cls(item, codes, edits, gram[order], owner[order], place[order], need, maybe, short)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions whose q-gram occurs in some pattern."""
        at = np.flatnonzero(self.maybe[grams >> np.uint64(42)])
        if not len(at):
            return at
        lo = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        return at[self.gram[lo] == grams[at]]

    def whole(self, text: np.ndarray, q: int) -> list[tuple]:
        """(item, start, end, 0) of items under ``q`` characters that are the whole text, but for white space around."""
        if not self.short or len(text) > q + 2:
            return []
        low, high = int(len(text) > 0 and text[0] == 32), len(text) - int(len(text) > 1 and text[-1] == 32)
        return [(item, low, high, 0) for item in self.short.get(text[low:high].astype(np.uint32).tobytes(), [])]

    def suspects(self, texts: list[np.ndarray], q: int) -> list[int]:
        """Texts with a stretch that holds as many hits as the least demanding pattern needs; the others can't match."""
        if not self.codes or not texts:
            return []
        ends = np.cumsum([len(t) for t in texts])
        at = self.hits(_grams(np.concatenate(texts), q))
        least, reach = int(self.need.min()), LONGEST + 2 * int(self.edits.max()) + 1
        if len(at) < least:
            return []
        close = at[: len(at) - least + 1][at[least - 1 :] - at[: len(at) - least + 1] <= reach]
        return np.unique(np.searchsorted(ends, close, "right")).tolist()


def _regions(text: np.ndarray, p: Patterns, q: int) -> list[tuple[int, int]]:
    """(pattern, diagonal) of bands that reach the q-gram bound; the diagonal is the band's middle."""
    grams = _grams(text, q)
    at = p.hits(grams)
    if not len(at):
        return []
    lo = np.searchsorted(p.gram, grams[at])
    n = np.searchsorted(p.gram, grams[at], "right") - lo
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
    owner, diagonal = p.owner[entry], np.repeat(at, n) - p.place[entry] + len(text)  # never negative
    width = p.edits[owner] + 1
    band = diagonal // width
    # band b spans the diagonals of b and b + 1, so each run of e + 1 diagonals lies within some band
    span = 2 * len(text) + LONGEST + 2
    key, count = np.unique(np.concatenate([owner * span + band, owner * span + np.maximum(band - 1, 0)]), return_counts=True)
    owner, band = key // span, key % span
    good = count >= p.need[owner]
    return list(zip(owner[good].tolist(), ((band[good] + 1) * (p.edits[owner[good]] + 1) - len(text)).tolist(), strict=True))


def banded_distance(pattern: np.ndarray, text: np.ndarray, first: int, width: int) -> tuple[int, int]:
    """Least edits between ``pattern`` and a piece of ``text``, and where that piece ends.

    Only the diagonals first .. first + width - 1 (text position minus pattern position) are filled in; the piece may
    start on any of them. Among equal distances the earliest end counts.
    """
    steps, far = np.arange(width), np.int64(len(pattern) + width + 1)
    # around the text stand characters unlike any other: pairing with one costs what leaving a pattern character out costs
    around = np.full(len(pattern) + width - 1, -1, dtype=np.int64)
    lo, hi = max(first, 0), max(min(first + len(around), len(text)), max(first, 0))
    around[lo - first : hi - first] = text[lo:hi]
    unlike = np.lib.stride_tricks.sliding_window_view(around, width) != pattern.astype(np.int64)[:, None]
    row, down = np.zeros(width, np.int64), np.full(width, far)
    for i in range(len(pattern)):
        down[:-1] = row[1:] + 1  # pattern character left out
        row = np.minimum(row + unlike[i], down)
        row = np.minimum.accumulate(row - steps) + steps  # text characters left out
    k = int(np.argmin(row))
    return int(row[k]), min(max(first + len(pattern) + k, 0), len(text))


def _find(text: np.ndarray, pattern: np.ndarray) -> int:
    """First position of an exact copy, or -1."""
    raw, wanted, at = text.tobytes(), pattern.tobytes(), -1
    while (at := raw.find(wanted, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def matches_in(codes: np.ndarray, p: Patterns, q: int = Q) -> list[tuple]:
    """(item, start, end, edits) of verified regions of a folded text, one per item and stretch of touching regions."""
    found: dict = {}
    overlap = 2 * LONGEST
    for a in range(0, max(len(codes), 1), CHUNK):
        part = codes[max(a - overlap, 0) : a + CHUNK]
        for owner, diagonal in _regions(part, p, q) if len(p.codes) else []:
            e, pattern = int(p.edits[owner]), p.codes[owner]
            low = max(diagonal - 2 * e - 2, 0)  # from here on the region counts its characters
            piece, base = part[low : diagonal + 2 * e + 2 + len(pattern) + e], max(a - overlap, 0) + low
            spans, same = found.setdefault(p.item[owner], []), _find(piece, pattern)
            if same >= 0:  # no edits: nothing to align
                spans.append((base + same, base + same + len(pattern), 0))
            elif not any(s <= base + 2 * e + 2 and base + len(piece) <= t + 4 * e + 4 for s, t, _ in spans):  # not yet covered
                edits, end = banded_distance(pattern, piece, diagonal - 2 * e - 2 - low, 4 * e + 5)
                if edits <= e:
                    _, length = banded_distance(pattern[::-1], piece[:end][::-1], -e, 2 * e + 1)
                    spans.append((base + end - length, base + end, edits))
    out = []
    for item, spans in ((k, sorted(v)) for k, v in found.items() if v):
        merged = [list(spans[0])]
        for s, t, e in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(t, merged[-1][1]), min(e, merged[-1][2])]
            else:
                merged.append([s, t, e])
        out += [(item, s, t, e) for s, t, e in merged]
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", item_text: str = "text",
    q: int = Q, errors: float = ERRORS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, text_key, item_id, start, stop, edits): stretches of documents that hold benchmark text.

    Positions count code points of the document. Letter case and the kind and amount of white space don't matter; other
    differences are edits. Null texts count as empty; a benchmark text shorter than ``q`` characters is found where it is
    a document's whole text. An item found twice in a document gives a row per stretch; ``edits`` is the least among a
    stretch's patterns. Repeated documents each give their rows, repeated items too; an empty table on either side gives
    none. Texts of any length are looked through whole, ``CHUNK`` characters at a time. The benchmark is held in blocks
    of ``block_chars`` characters; every block meets every document.
    """
    spark = docs.sparkSession
    ship_package(spark)
    chars = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    block_of = F.pmod(F.xxhash64(item, item_text), F.lit(blocks))
    id_kind, item_kind = docs.schema[id].dataType, benchmark.schema[item].dataType
    chosen = docs.select(F.col(id).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))
    out = None
    for b in range(blocks):
        # the driver holds one block at a time, a fixed number of characters
        rows = [tuple(r) for r in benchmark.where(block_of == b).select(item, item_text).collect()]
        shared = spark.sparkContext.broadcast(Patterns.of(rows, q, errors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            for batch in batches:
                ids, found = [], []
                texts, size, first = [], 0, 0
                for i, value in enumerate(batch.column(2)):
                    codes = folded(value.as_py())
                    texts.append(codes[squeezed(codes)])
                    size += len(texts[-1])
                    if size >= CHUNK or i + 1 == batch.num_rows:
                        hits = {j: matches_in(texts[j], patterns, q) for j in patterns.suspects(texts, q)}
                        for j, short in ((j, patterns.whole(t, q)) for j, t in enumerate(texts)):
                            if short:
                                hits[j] = hits.get(j, []) + short
                        for j, here in hits.items():
                            stay = squeezed(folded(batch.column(2)[first + j].as_py()))
                            for item, low, high, edits in here:
                                ids.append(first + j)
                                found.append((item, int(stay[low]), int(stay[high - 1]) + 1, edits))
                        texts, size, first = [], 0, i + 1
                at = pa.array(ids, pa.int64())
                cols = [batch.column(0).take(at), batch.column(1).take(at)]
                cols += [pa.array([m[k] for m in found], kind) for k, kind in enumerate((out_item, pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "item_id", "start", "stop", "edits"])

        out_item = to_arrow_type(item_kind)
        schema = f"doc_id {id_kind.simpleString()}, text_key long, item_id {item_kind.simpleString()}, start long, stop long, edits int"
        part = chosen.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
