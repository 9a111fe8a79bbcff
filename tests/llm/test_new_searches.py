"""Language identification, hard negatives and lexical search against plain versions and on odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA, LONG, odd_docs
from pyspark.sql import functions as F

from courtspark.llm import language, lexical, negatives, queries
from courtspark.llm.common import stored
from oracle import compare, connect


@pytest.fixture(scope="module")
def odd(spark):
    return stored(odd_docs(spark), "odd")


# language


def test_gradients_equal_differences():
    model = language.Model.fresh(["a", "b", "c"], hidden=4)
    for r in (model.ahead, model.behind):
        r.byte, r.back, r.bias = (x.astype(np.float64) for x in (r.byte, r.back, r.bias))
    model.out, model.shift = model.out.astype(np.float64), model.shift.astype(np.float64)
    pieces, label = [b"hello wor", b"bonjou", b"ab"], np.array([0, 1, 2])
    _, given = language.gradients(model, pieces, label)
    for p, g in zip(model.params(), given, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = p[at], []
        for step in (1e-3, -1e-3):
            p[at] = old + step
            losses.append(language.gradients(model, pieces, label)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[at]) < 1e-5


def plain_states(reader, codes):
    """One window, one byte at a time."""
    hid, h, out = len(reader.back), np.zeros(len(reader.back)), []
    for c in codes:
        a, b = reader.byte[c], h @ reader.back + reader.bias
        z, r = ((language.squash(a[k : k + hid] + b[k : k + hid]) + 1) / 2 for k in (0, hid))
        h = (1 - z) * language.squash(a[2 * hid :] + r * b[2 * hid :]) + z * h
        out.append(h)
    return out


def test_evidence_equals_a_network_run_window_by_window():
    model = language.Model.fresh(["a", "b", "c"])
    texts = ["", "x", "é" * 50, "word " * 40, "abc" * 64, "tail of text"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = model.evidence(np.frombuffer(b"".join(raw), np.uint8), offs)
    for k, text in enumerate(raw):
        want = np.zeros(3)
        for a in range(0, len(text), language.WINDOW):
            part = text[a : a + language.WINDOW]
            fore, aft = plain_states(model.ahead, part), plain_states(model.behind, part[::-1])[::-1]
            logit = np.array([np.concatenate([f, b]) @ model.out + model.shift for f, b in zip(fore, aft, strict=True)])
            want += (logit - np.log(np.exp(logit).sum(1, keepdims=True))).mean(0)
        assert np.allclose(got[k], want, atol=1e-3)


def test_language_held_out_accuracy_and_no_use_of_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op11_language(spark, f"{DATA}/sf0.01").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert set(rows) == set(true) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    aside = [d for d, r in rows.items() if r.held_out]
    assert np.mean([rows[d].lang_pred == true[d] for d in aside]) > 0.97
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    wrong = docs.withColumn("lang", F.when(usable, F.col("lang")).otherwise("never"))
    assert language.sample(wrong, usable, "text", "lang") == language.sample(docs, usable, "text", "lang")


def test_language_on_odd_rows(spark, odd):
    model = language.fitted(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))
    rows = language.identified(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (2, 3, 6)) and by[4].lang_pred in model.languages
    same = [(r.lang_pred, round(r.score, 4)) for r in rows if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
    long = spark.createDataFrame([(1, LONG), (2, "x" * 3_000_000), (3, "12 34 !?")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.identified(long, model).orderBy("doc_id").collect()] == [False, False, True]
    assert language.identified(odd.limit(0), model).count() == 0 and language.fitted(odd.limit(0)) is None
    assert {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}


def test_language_sample_is_bounded_and_drops_copies(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_WINDOWS", 5)
    monkeypatch.setattr(language, "FIT_LANGUAGES", 2)
    rows = [(k, f"text number {k} " * (1 + k % 30), "aa" if k % 3 else "bb") for k in range(90)] + [(k, "a copy", "aa") for k in range(100, 200)] + [(300, "rare", "cc")]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None, "text", "lang")
    assert Counter(name for name, _ in got).keys() == {"aa", "bb"} and max(Counter(name for name, _ in got).values()) == 5
    assert sum(p == b"a copy" for _, p in got) <= 1 and all(0 < len(p) <= language.WINDOW for _, p in got)


# hard negatives


def plain_negatives(rows, positives=5, negatives_=5):
    """rows: distinct (id, label, integers)."""
    out = []
    width = max((len(x) for _, _, x in rows), default=0)
    rows = [(i, y, np.array([*x, *[0] * (width - len(x))], object)) for i, y, x in rows]
    for n, (a, label, q) in enumerate(rows):
        if a % 100:
            continue
        scored = [(-int((x * q).sum()) if width else 0, i, y) for m, (i, y, x) in enumerate(rows) if m != n]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            fit = sorted(r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s)[:negatives_]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id string, key string, x string, score string")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("shape", ["clusters", "ties", "one label", "short"])
def test_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(len(shape))
    x = rng.normal(0, 0.15, (700, 12))
    if shape == "clusters":
        x += rng.normal(0, 1, (7, 12))[rng.integers(0, 7, 700)]
    if shape == "ties":
        x = rng.integers(-1, 2, (700, 4)) / 4
    label = np.zeros(700, int) if shape == "one label" else rng.integers(0, 4, 700)
    label[rng.random(700) < 0.3] = 1  # a third of all rows
    rows = [(int(k), int(label[k]), x[k].astype(np.float32).tolist()[: 12 - (k % 5 if shape == "short" else 0)]) for k in range(700)]
    want = plain_negatives([(i, y, [math.floor(256 * v) for v in e]) for i, y, e in rows])
    more = [(*r, "a", "b", "c", "d") for r in rows]
    assert mined(spark, more, shard_rows=150, block_anchors=3, codewords=4) == want
    assert mined(spark, more + more[:300]) == want and (want or shape == "one label")


def test_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, [1.0]), (200, 1, None), (300, 1, [1.0, None]), (None, 1, [1.0]), (400, 1, [nan, 1.0]), (500, 1, [inf, 1.0]), (600, 1, [-inf, 1e30])]
    good = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.4]), (2, 0, [0.8, 0.4]), (3, 0, [0.85, 0.4]), (700, 2, []), (800, 1, [])]
    more = ("a", "b", "c", "d")
    assert mined(spark, [(*r, *more) for r in bad + good]) == plain_negatives([(i, y, [math.floor(256 * v) for v in e]) for i, y, e in good])
    assert mined(spark, []) == [] and mined(spark, [(*r, *more) for r in bad]) == []
    assert mined(spark, [(0, 1, [0.5], *more)]) == []  # neither positives nor negatives
    twins = [(0, 1, [1.0]), (0, 1, [0.5]), (1, 2, [0.5]), (1, 3, [0.5])]
    assert {(r[0], r[1], r[3]) for r in mined(spark, [(*r, *more) for r in twins])} == {(0, 0, 1)}


def test_visited_cells_are_bounded_and_ordered():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 0.2, (500, 10))).astype(np.float32)
    books = negatives.codebook(x[:, :5], 6), negatives.codebook(x[:, 5:], 6)
    index = negatives.Index.of(books, np.arange(500), np.arange(500), np.zeros(500, int), x)
    q = index.vectors[7]
    seen, last = 0, np.inf
    for bound, cell in index.cells(q):
        rows = index.vectors[index.first[cell] : index.first[cell + 1]]
        assert bound <= last and (rows @ q <= bound).all()
        seen, last = seen + len(rows), bound
    assert seen == 500


@pytest.mark.parametrize("peak, kind", [(256, np.float32), (1 << 16, np.float64), (1 << 26, np.int64)])
def test_inner_products_are_exact(peak, kind):
    assert negatives.exact_type(peak, 64) is kind
    x = np.full((1, 64), peak).astype(kind)
    assert int((x @ x[0])[0]) == 64 * peak * peak
    with pytest.raises(ValueError):
        negatives.exact_type(1 << 30, 64)


# lexical search


def plain_search(docs, items, k=20):
    """docs: (id, text); items: distinct (id, text)."""
    counts = [(d, Counter(lexical.terms_of(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n, total = len(counts), sum(s for _, _, s in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        ranked = []
        for d, c, s in counts:
            m = 100 - 25 + (25 * s * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in lexical.terms_of(text))
            ranked += [(-score, d is None, d)] if score > 0 else []
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(ranked[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **more):
    d = docs if hasattr(docs, "schema") else spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(d, i, **more).collect()), key=repr)


def test_search_equals_brute_force_over_small_runs(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights=[1 / (1 + i) for i in range(60)], k=rng.choice([1, 5, 40, 200])))) for k in range(900)]
    docs += [(2000 + k, docs[5][1]) for k in range(300)] + [(None, docs[6][1]), (7, docs[7][1])]  # a group of copies, no id, a repeated row
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for k in range(25)] + [(90, ""), (91, None), (92, "unheard of"), (93, "W1, w1; w1")]
    want = plain_search(docs, [i for i in items if i[1]])
    assert searched(spark, docs, items + items[:2]) == want
    for name, value in (("RUN_DOCS", 64), ("RUN_POSTINGS", 900), ("BLOCK", 7), ("ITEM_BYTES", 200)):
        monkeypatch.setattr(lexical, name, value)
    found = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert searched(spark, found, items) == want


def test_summaries_bound_every_score_of_their_block():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 300)
    term = np.concatenate([np.sort(rng.permutation(40)[:s]) for s in sizes])
    run = lexical.Run(np.arange(300), np.append(0, np.cumsum(sizes)), term, rng.integers(1, 1_000_000, len(term)), rng.integers(0, 9_000, 40))
    asked, weight = np.array([1, 5, 9, 30]), np.array([3, 900, 70, 11])
    weights = np.zeros(40, np.int64)
    weights[asked] = weight
    for t in range(40):
        blocks = run.blocks(t)
        assert sorted(blocks.docs) == sorted(d for d in range(300) if t in term[run.first[d] : run.first[d + 1]])
        bound = blocks.bounds(asked, weight.astype(float))
        for k in range(len(bound)):
            assert (run.scores(blocks.docs[blocks.first[k] : blocks.first[k + 1]], weights) <= bound[k]).all()


def test_long_texts_in_pieces_count_like_whole_ones(monkeypatch):
    text = LONG + "ÀÉ" * 40 + " w1 W1"
    items = lexical.Items.of([(1, "w1 w2 w59999 àé absent " + "ÀÉ" * 40)])
    whole = lexical.counted(pa.array(["w1", text, None, ""]), items.hashes)
    monkeypatch.setattr(lexical.words.pieces, "__defaults__", (64,))
    for a, b in zip(whole, lexical.counted(pa.array(["w1", text, None, ""]), items.hashes), strict=True):
        assert (a == b).all()
    assert whole[0].tolist() == [1, len(lexical.terms_of(text)), 0, 0]


def test_search_on_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "one two ÜNÏCÖDÉ ünïcödé w5 text"), (None, "seven"), (1, "nine")]
    assert searched(spark, odd, items) == plain_search(docs, items)
    assert searched(spark, odd, []) == [] and searched(spark, [], items) == [] and searched(spark, [(1, None), (2, " -")], items) == []


@pytest.mark.parametrize("name", ["op12_negatives", "op13_lexical"])
def test_queries_equal_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), connect("sf0.001"), queries.ORACLE[name]) in (None, "EMPTY")
