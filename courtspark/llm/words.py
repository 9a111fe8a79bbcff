"""Words of many texts at once in numpy: spans, 64-bit hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once, so that work arrays stay within a few tens of MB.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``size`` bytes; nulls are empty texts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def pieces(texts: pa.Array, solid: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of at most about ``size`` bytes; a longer text is handed on in several pieces.

    Cuts fall where a byte that isn't ``solid`` (a table of 256) stands, so that only a longer word makes a larger piece.
    """
    for a, b, raw, offs in chunks(texts, size):
        if b - a > 1 or len(raw) <= size:
            yield a, raw, offs
            continue
        start = 0
        while start < len(raw):
            stop = min(len(raw), start + size)
            if stop < len(raw):
                gap = np.flatnonzero(~solid[raw[start:stop]])
                while not len(gap) and stop < len(raw):
                    begin, stop = stop, min(len(raw), stop + size)
                    gap = np.flatnonzero(~solid[raw[begin:stop]]) + (begin - start)
                stop = start + int(gap[-1]) + 1 if len(gap) else len(raw)
            yield a, raw[start:stop], np.array([0, stop - start])
            start = stop


def spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space), and the number of the first word of each text."""
    solid = ~SPACE[raw]
    new = np.zeros(len(raw) + 1, bool)
    new[offs] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | new[1:-1]
    end[:-1] &= ~solid[1:] | new[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            power = np.full(max(n, 1 << 17), base, np.uint64)
            power[0] = 1
            _powers[k] = np.multiply.accumulate(power)
    return _powers[0][:n], _powers[1][:n]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: int = 8192) -> np.ndarray:
    """64-bit hash of each span; spans are in order and don't overlap, except that ends may be anywhere after starts."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), run):
        s, e = starts[a : a + run], ends[a : a + run]
        low, high = int(s[0]), int(e.max())
        power, back = _tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        out[a : a + run] = (total[e - low] - total[s - low]) * back[s - low]
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``width`` words; a text of fewer words gives one run of all it has."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(first[:-1], counts)
    size = np.minimum(counts, width)[text]
    head = place + size <= counts[text]  # a run starts here
    at, text, size = np.flatnonzero(head), text[head], size[head]
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        live = size > k
        total[live] = mix(total[live] * np.uint64(_BASE) + words[at[live] + k] + np.uint64(k + 1))
    return text, total
