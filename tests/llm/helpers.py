"""Plain versions of the text operators, and tables with odd rows."""

import re

import xxhash

DATA = "/root/testdata"
#: Extra columns whose names the operators use themselves.
CLASHES = ["text_key", "fp", "label", "pos", "rank", "block", "own_key", "kept_id", "score", "starts", "lines", "row_id", "h", "x", "lane", "arc"]
LONG = " ".join(f"w{i}" for i in range(60_000))


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties and clashing extra columns."""
    rows = [
        (1, "one two three\nfour five six\nseven eight nine\nten", "en", "a", 5), (1, "one two three\nfour five six\nseven eight nine\nten", "en", "a", 5),
        (2, None, "en", None, None), (None, "a text without an id, of some words only", None, "b", 3), (None, None, None, None, None), (3, "", "de", "a", 0),
        (4, LONG, "en", "a", 1), (5, "one two three\nfour five six\nseven eight nine\nelf", "en", "b", 5), (6, " \n\t\n ", "fr", "b", 5), (7, "ünïcödé 😀 text\r\nwith odd signs", "fr", "c", 9),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["clash"] * (len(names) - 5)) for r in rows], kinds)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


def simhash(text, n):
    w = words_of(text)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps: dict, radius: int) -> dict:
    """Smallest key reachable over links of at most ``radius`` differing bits."""
    keys, label = sorted(fps), {}
    for k in keys:
        if k in label:
            continue
        label[k], queue = k, [k]
        while queue:
            one = queue.pop()
            for other in keys:
                if other not in label and (fps[one] ^ fps[other]).bit_count() <= radius:
                    label[other] = k
                    queue.append(other)
    return label


def without_repeats(docs: list[tuple]) -> dict:
    """Texts of (id, text) without later three-line windows, in id order."""
    seen, out = set(), {}
    for key, text in docs:
        lines = text.split("\n")
        bare = [x.strip(" \t\r") for x in lines]
        gone, own = set(), []
        for i in range(len(lines) - 2):
            w = tuple(bare[i : i + 3])
            if any(w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def shingle_set(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0
