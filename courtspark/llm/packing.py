"""Packing of token sequences by minimum bin slack.

Documents are cut into full windows and one rest. Only the counts of the rests' lengths, at most ``window`` numbers
whatever the corpus, decide what goes together: for each window the longest rest left is joined by the multiset of
lengths that fills it best, found by a subset-sum over bit sets with multiplicities and traced back. A filling is used
as often as the counts allow, so each search uses up some length. The assignment of pieces to places is a join of
their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import blocked_rank, stored, text_or_empty

WINDOW = 2048
#: Id that ends a document.
END = 1
#: How a byte-level BPE splits a text before its merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of a text with the byte-level BPE tokenizer in a ``tokenizers`` file.

    The file's vocabulary, in which ids are merge ranks, is run by the faster rank encoder; it gives the same ids for
    all ordinary text (tests compare them). Texts that name one of the file's special tokens go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level vocabularies write each byte as a printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in piece): rank for piece, rank in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece not in self.special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.ranked.encode_to_numpy(text, disallowed_special=())


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, lane, start, length, ids_crc32, doc_tokens): full windows of each document and its rest.

    A null text is empty, so it has the ending id only. ``lane`` differs from row to row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lane = Encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column(1)):
                own = np.append(encode(value.as_py()), np.uint32(END)).astype("<u4")
                rows += [(i, s, min(window, len(own) - s), zlib.crc32(own[s : s + window]), len(own)) for s in range(0, len(own), window)]
            i, start, length, crc, total = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            lanes = lane + np.arange(len(rows))
            lane += len(rows)
            doc = batch.column(0).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (lanes, start, length, crc, total))], ["doc_id", "lane", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id].dataType.simpleString()
    chosen = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, lane long, start long, length long, ids_crc32 long, doc_tokens long")


def _fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the multiset within ``counts`` whose sum is the largest that fits into ``room``."""
    reached, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((k for k, c in counts.items() if c and k <= room), reverse=True):
        steps.append((length, reached))
        left, portion = min(counts[length], room // length), 1
        while left:
            portion = min(portion, left)
            reached |= (reached << (portion * length)) & limit
            left -= portion
            portion *= 2
        if reached >> room & 1:
            break
    total, out = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> (total - copies * length) & 1:
            copies += 1
        if copies:
            out.append((length, copies))
            total -= copies * length
    return out


def fillings(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies), ...]) that use up ``counts``; each filling starts with the longest length left."""
    left, out = {k: c for k, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        best = dict(_fill(left, window - longest))
        left[longest] += 1
        best[longest] = best.get(longest, 0) + 1
        times = min(left[k] // c for k, c in best.items())
        out.append((times, sorted(best.items(), reverse=True)))
        for k, c in best.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
    return out


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece of a document.

    Sequences are numbered from 0 and filled from offset 0 without gaps. Repeated rows are packed once each; an empty
    table gives an empty result.
    """
    every = stored(pieces(docs, tokenizer, window, text, id), "pieces")
    counts = {r[0]: r[1] for r in every.groupBy("length").count().collect()}  # at most ``window`` numbers
    lows: dict[int, list[tuple]] = {}
    sequence, used = 0, dict.fromkeys(counts, 0)
    for times, content in fillings(counts, window):
        offset = 0
        for length, copies in content:
            lows.setdefault(length, []).append((used[length], sequence, copies, offset))
            used[length] += times * copies
            offset += copies * length
        sequence += times
    plan = {k: np.array(v, dtype=np.int64).T for k, v in lows.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                here = length == k
                low, first, copies, start = plan[int(k)]
                j = np.searchsorted(low, rank[here], "right") - 1
                n, copy = np.divmod(rank[here] - low[j], copies[j])
                seq[here], off[here] = first[j] + n, start[j] + copy * k
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id].dataType.simpleString()
    ranked = blocked_rank(every, ["length"], "lane", sum(counts.values()))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
