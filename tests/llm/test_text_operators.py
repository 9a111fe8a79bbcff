"""Text operators against plain versions, and on odd rows."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import DATA, LONG, groups, jaccard, odd_docs, shingle_set, simhash, without_repeats
from pyspark.sql import functions as F

from courtspark.llm import decontaminate, fingerprint, graph, html_text, licenses, line_dedup, packing, quality, queries, sharding, toxicity, words
from courtspark.llm import simhash as near
from courtspark.llm.common import blocked_rank, stored
from oracle import compare, connect

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return stored(odd_docs(spark), "odd")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# words


def test_words_and_shingles_equal_plain_python():
    given = ["a bb  ccc\ta", "", None, " x ", "é b\nc d e f g", "one"]
    for a, b, raw, offs in words.chunks(pa.array(given), 4):
        starts, ends, first = words.spans(raw, offs)
        found = [raw[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
        assert found == [w for t in given[a:b] for w in (t or "").split()]
    raw, offs = np.frombuffer(b"ab cd ab cd ab", np.uint8), np.array([0, 14])
    starts, ends, first = words.spans(raw, offs)
    h = words.hashes(raw, starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    text, s = words.shingles(h, first, 2)
    assert len(s) == 4 and s[0] == s[2] and s[1] == s[3] and len(set(s.tolist())) == 2
    assert len(words.shingles(h, first, 9)[1]) == 1


def test_ranks_in_blocks_have_no_gaps(spark):
    df = stored(spark.range(1000).select(F.col("id").alias("lane"), F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 3).alias("k")), "ranks")
    rows = blocked_rank(df, ["k"], "lane", 1000, block_rows=64).collect()
    for k in (0, 1, 2):
        assert sorted(r["rank"] for r in rows if r.k == k) == list(range(sum(r.k == k for r in rows)))


def test_components_of_paths_stars_and_loose_links(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near_by = {}
    for u, v in edges:
        if u != v:
            near_by.setdefault(u, set()).add(v)
            near_by.setdefault(v, set()).add(u)
    want = {}
    for n in sorted(near_by):
        queue = [n] if n not in want else []
        while queue:
            x = queue.pop()
            if x not in want:
                want[x] = n
                queue += near_by[x]
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 quality


def test_quality_keeps_the_good_and_finds_most_of_the_bad(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, f"{DATA}/sf0.01").collect()}
    known = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[r.doc_id].keep for r in known if r.quality == 1)
    bad = [r for r in known if r.quality == 0]
    assert sum(not got[r.doc_id].keep for r in bad) >= 0.85 * len(bad)


def test_quality_posteriors_are_shrunk_grouped_rates(spark):
    rng = random.Random(2)
    good = ["the cat sat on the mat and it was good to see that day.", "rain fell over the old town while people went home early."]
    rows = []
    for i in range(240):
        host = "h" + str(i % 4)
        bad = rng.random() < (0.8 if host == "h0" else 0.1)
        rows.append((i, "buy!! now!! $$$ now!! buy!! now!!" if bad else rng.choice(good) + f" {i}", host, "p" + str(i % 8), int(not bad)))
    rows.append((900, "good words of a lone site.", "h9", "p9", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int")
    got = {r.doc_id: r for r in quality.scores(df, df.where("quality is not null").select("doc_id", "quality"), F.col("host"), F.col("path")).collect()}
    for host in ("h0", "h1"):
        own = [r for r in rows if r[2] == host]
        rate, all_rate = np.mean([r[4] for r in own]), np.mean([r[4] for r in rows[:-1]])
        post = got[own[0][0]].host_posterior
        assert min(rate, all_rate) - 0.02 <= post <= max(rate, all_rate) + 0.02 and abs(post - rate) < abs(post - all_rate) + 0.1
    lone, overall = got[900], np.mean([r[4] for r in rows[:-1]])
    assert abs(lone.host_posterior - overall) < 0.25  # one document hardly moves its site
    assert all(got[r[0]].keep == bool(r[4]) for r in rows[:-1])


def _strength(groups, centre):
    """Strength of the prior of sites, by moments; ``groups``: the rates at each site, ``centre`` a function of the site."""
    n, g = sum(map(len, groups)), len(groups)
    if g < 2 or n <= g:
        return 1.0
    rates = [r for own in groups for r in own]
    rate, between = np.mean(rates), sum(len(own) * (np.mean(own) - centre(k)) ** 2 for k, own in enumerate(groups))
    within = max(np.var(rates) - between / n, 1e-9)
    variance = max((between - (g - 1) * within) / max(n - sum(len(own) ** 2 for own in groups) / n, 1e-9), 1e-9)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return min(max(rate * (1 - rate) / variance - 1, 1.0), 1e6)


def test_quality_scores_equal_plain_sums_over_the_other_documents(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        host, bad = rng.choice(["a", "a", "b", None]), rng.random() < 0.4
        text = " ".join(rng.choice(["buy!!", "$$$", "now!!"] if bad and rng.random() < 0.8 else ["the", "cat", "sat", "there.", "on"]) for _ in range(rng.randrange(3, 30)))
        rows.append((i, text, host, rng.choice(["x", "y"]), rng.choice([None, int(not bad)])))
    rows += [(900, "alone at its site.", "z", "z", 0), (901, None, "b", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int")
    got = {r.doc_id: r for r in quality.scores(df, df.select("doc_id", "quality"), F.col("host"), F.col("path")).collect()}
    y = [r[4] for r in rows if r[4] is not None]
    base = np.log(sum(y) / (len(y) - sum(y)))
    rate = {r[0]: r[4] if r[4] is not None else 1 / (1 + np.exp(-(got[r[0]].evidence + base))) for r in rows}
    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r[2], []).append(rate[r[0]])
        paths.setdefault(r[2:4], []).append(rate[r[0]])
    whole = (sum(rate.values()) + 1) / (len(rate) + 2)
    k_host = _strength(list(hosts.values()), lambda k: whole)
    level = {h: (sum(v) + k_host * whole) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = _strength(list(paths.values()), lambda k: level[list(paths)[k][0]])
    for r in rows:
        own = rate[r[0]]
        rest = (sum(rate.values()) - own + 1) / (len(rate) + 1)
        host = (sum(hosts[r[2]]) - own + k_host * rest) / (len(hosts[r[2]]) - 1 + k_host)
        path = (sum(paths[r[2:4]]) - own + k_path * host) / (len(paths[r[2:4]]) - 1 + k_path)
        score = 1 / (1 + np.exp(-(np.log(path / (1 - path)) + got[r[0]].evidence)))
        assert np.allclose([got[r[0]].host_posterior, got[r[0]].path_posterior, got[r[0]].score], [host, path, score], atol=1e-6)
    # a label says nothing about its own document beyond what it taught the regression
    assert abs(got[900].path_posterior - whole) < 0.05


def test_quality_on_odd_rows(spark, odd):
    for known in (labels(spark), labels(spark, [(1, 1, 0), (3, 0, 0), (3, None, None), (None, 0, 0), (4, 0, 0)])):
        assert quality.scores(odd, known, F.col("source"), F.col("lang")).count() == 10
    kept = quality.kept(odd, labels(spark), F.col("source"), F.col("lang"))
    assert kept.columns == odd.columns and kept.count() == 10
    assert quality.scores(odd.limit(0), labels(spark), F.col("source"), F.col("lang")).count() == 0


# 2 decontamination


def _edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (d != c), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance_equals_the_full_table():
    rng = random.Random(4)
    for _ in range(200):
        p = np.array([rng.choice([97, 98, 99]) for _ in range(rng.randint(1, 12))])
        t = np.array([rng.choice([97, 98, 99]) for _ in range(rng.randint(0, 14))], dtype=np.int64)
        assert decontaminate.banded_distance(p, t, -len(p), len(p) + len(t) + 1)[0] == _edit_distance(p.tolist(), t.tolist())


def test_amounts_of_white_space_do_not_matter_and_short_items_are_whole_texts(spark):
    rng = random.Random(9)
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(28))
    words_ = item.split()
    wrapped = "\n    ".join(" ".join(words_[i : i + 5]) for i in range(0, len(words_), 5))
    texts = {1: "x  y " + item.replace(" ", "  ") + "  z", 2: "before\n\n" + wrapped + "\n\nafter", 3: item.replace(" ", "\u2003\u00a0"), 4: item, 5: "\n ok\t? ", 6: "ok ? no"}
    docs = spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "OK  ?"), (3, ""), (4, None)], "item_id long, text string")
    rows = decontaminate.leaks(docs, bench).collect()
    found = {(r.doc_id, r.item_id): " ".join(texts[r.doc_id][r.start : r.stop].split()) for r in rows}
    assert found == {(1, 1): item, (2, 1): item, (3, 1): item, (4, 1): item, (5, 2): "ok ?"}
    assert sum(r.doc_id == 2 for r in rows) == 2 and all(r.edits == 0 for r in rows)


def test_leaks_are_those_of_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_chars=2_000).collect()}
    assert blocks == got
    # edited passages are found where they stand, foreign texts are left alone
    rng, rows = random.Random(5), []
    for n, (i, b) in enumerate(sorted(items.items())[:12]):
        chars = list(b)
        for _ in range(len(b) // 25):
            chars[rng.randrange(len(chars))] = "#"
        rows.append((n, f"foreign words before it {n} " + "".join(chars).upper() + " and after", i, len(f"foreign words before it {n} ")))
    mixed = spark.createDataFrame([r[:2] for r in rows] + [(99, "foreign words before it and after")], "doc_id long, text string")
    spans = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(mixed, bench).collect()}
    assert {(r[0], r[2]) for r in rows} == set(spans)
    for n, text, i, at in rows:
        assert abs(spans[n, i].start - at) <= 60 and spans[n, i].stop <= len(text)


def test_a_long_text_is_searched_to_its_end(spark, odd):
    bench = spark.createDataFrame([(1, "a passage of the benchmark that nobody should have seen before the test"), (2, None), (3, "tiny"), (None, "x" * 40)], "item_id long, text string")
    far = LONG * 4 + " A passage of the benchmark\nthat nobody should have seen before the test."
    more = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit(far)))
    assert [(r.doc_id, r.item_id, r.start) for r in decontaminate.leaks(more, bench).collect()] == [(50, 1, len(LONG) * 4 + 1)]
    assert decontaminate.leaks(odd, bench.limit(0)).count() == decontaminate.leaks(odd.limit(0), bench).count() == 0


def test_few_hits_are_no_suspect():
    item = "an item of more than eighty characters, so that eleven hits at least are needed to be suspected"
    p = decontaminate.Patterns.of([(1, item)], decontaminate.Q, decontaminate.ERRORS)
    least = int(p.need.min())
    assert least >= 11
    for hits in range(least + 1):
        text = "~" * 30 + (item[: decontaminate.Q - 1 + hits] if hits else "") + "~" * 30
        assert len(p.hits(decontaminate._grams(decontaminate.folded(text), decontaminate.Q))) == hits
        assert p.suspects([decontaminate.folded(text)], decontaminate.Q) == ([0] if hits == least else [])


@pytest.mark.parametrize("size", [25, 29, 38, 39])
def test_short_items_are_found_with_the_edits_the_bound_allows(size):
    item = "the quick brown fox jumps over a lazy dog"[:size]
    p = decontaminate.Patterns.of([(1, item)], decontaminate.Q, decontaminate.ERRORS)
    text = decontaminate.folded("~" * 30 + item[: size // 2] + "#" + item[size // 2 + 1 :] + "~" * 30)
    assert p.suspects([text], decontaminate.Q) == [0]
    assert [(m[0], m[3]) for m in decontaminate.matches_in(text, p)] == [(1, 1)]


# 3 fingerprints


def test_fingerprints_equal_plain_python(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(order)
    for n, d in enumerate(order):
        t, after = texts[d], texts[order[(n + 1) % len(order)]]
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = shingle_set(t), shingle_set(changed), shingle_set(after)
        exact = len(a | b) < fingerprint.K
        assert abs(r.near_edited - jaccard(a, b)) < (1e-9 if exact else 0.2) and abs(r.near_next - jaccard(a, c)) < 0.2
        assert abs(r.n_shingles - len(a)) <= (0 if len(a) < fingerprint.K else 0.4 * len(a))


def test_merged_sketches_are_the_sketch_of_the_whole(spark, docs):
    parts = fingerprint.sketches(docs, k=16).withColumn("half", F.coalesce(F.col("doc_id") % 2, F.lit(0)))
    got = {r.half: r.sketch for r in fingerprint.merged(parts, ["half"], 16).collect()}
    for half in (0, 1):
        assert got[half] == sorted({v for r in parts.where(F.col("half") == half).collect() for v in r.sketch})[:16]
    a, b = (sorted((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) >> 16 for i in range(0, 200, step)) for step in (2, 3))
    row = spark.createDataFrame([(a, b, [])], "a array<long>, b array<long>, e array<long>")
    one = row.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("b"), F.col("a")).alias("c"), fingerprint.resemblance(F.col("e"), F.col("e")).alias("e"), fingerprint.distinct_shingles(F.col("a")).alias("n")).first()
    inter = len(set(a) & set(b))
    assert abs(one.r - inter / len(set(a) | set(b))) < 0.1 and abs(one.c - inter / len(b)) < 0.2 and one.e == 1.0 and one.n == 100


def test_fingerprints_on_odd_rows(spark, odd):
    rows = fingerprint.with_edits(odd).collect()
    assert len(rows) == 10 and len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert fingerprint.with_edits(odd.limit(0)).count() == 0
    assert fingerprint.with_edits(odd.where("doc_id = 7")).first().near_next == 1.0  # its own successor


# 4 line dedup


def test_line_dedup_equals_plain_python_and_sql(spark, docs, texts):
    want = without_repeats(sorted(texts.items()))
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == want
    assert compare(queries.QUERIES["op4_line_dedup"](spark, f"{DATA}/sf0.001"), connect("sf0.001"), queries.ORACLE["op4_line_dedup"]) is None


def test_line_dedup_merges_overlaps_and_keeps_the_first(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb \nc\n d\ny"), (3, "a\nb"), (4, "\n\n\n\n\n"), (5, "\n\n\n\n\n"), (6, "q\nq\nq\nq\nq")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("x\ny", 4), 3: ("a\nb", 0), 4: ("\n" * 5, 0), 5: ("\n" * 5, 0), 6: ("q", 4)}


def test_line_dedup_on_odd_rows(spark, odd):
    got = line_dedup.without_repeats(odd)
    assert got.columns == [*odd.columns, "n_removed"]
    rows = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    assert rows.count((1, "one two three\nfour five six\nseven eight nine\nten", 0)) == 2 and (5, "elf", 3) in rows and (2, None, 0) in rows and (4, LONG, 0) in rows
    assert line_dedup.without_repeats(odd.limit(0)).count() == 0


# 5 licences


def test_training_hashes_are_those_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("mit")), F.xxhash64(F.lit("gnu"), F.lit("general"), F.lit("é"))).first()
    assert tuple(row) == (licenses._hash(("mit",)), licenses._hash(("gnu", "general", "é")))


def test_licences_are_found_and_named(spark, odd):
    lines = {10: ("MIT", "This project is licensed under the MIT license."), 11: ("GPL", "released under the GNU GPL, version 2 or later"), 12: ("all rights reserved", "(c) 2020 Someone. All rights reserved."),
             13: ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), 14: (None, "the file was under the stairs and the version of the story changed"), 15: ("CC", "Licensed under CC BY-SA 4.0.")}
    rows = [(k, f"first line here\n{v[1]}\nlast words", "en", "s", 1) for k, v in lines.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(odd, allowMissingColumns=True)
    found = [r for r in licenses.scanned(df.unionByName(df.where("doc_id = 10"))).collect() if r.confirmed]
    assert {(r.doc_id, r.pos): r.family for r in found} == {(k, 1): v[0] for k, v in lines.items() if v[0]} and len(found) == 5
    assert licenses.scanned(odd.limit(0)).count() == 0


def test_wrapped_licences_are_confirmed(spark):
    cases = {}
    for n, (family, which, width) in enumerate([("BSD", 0, 60), ("MIT", 2, 76), ("GPL", 1, 70), ("LGPL", 1, 40), ("Apache-2.0", 2, 50), ("ISC", 0, 64), ("MPL", 0, 48), ("public domain", 1, 30)]):
        notice = textwrap.wrap(licenses.TEMPLATES[family][which], width)
        mark = ["", "# ", "  * ", "// "][n % 4]
        plain = ["the river ran past the old mill and on to the sea"] * (5 * n) + ["and nobody saw it go"]
        cases[n] = (family, licenses.TEMPLATES[family][which], len(plain) + 1, len(notice), "\n".join([*plain, " \t" if n % 2 else "", *(mark + line for line in notice), "", *plain]))
    rows = [(k, v[4]) for k, v in cases.items()] + [(100, "\n".join(["by the version of the story"] * 40)), (101, None), (102, ""), (0, cases[0][4])]
    # no blank line around: pieces of the run overlap, and a line that holds the notice already stands for the run
    rows += [(103, "\n".join(["so it went on"] * 21 + textwrap.wrap(licenses.TEMPLATES["BSD"][0], 50) + ["so it went on"] * 21)), (104, "so it went on\nLicensed under CC BY-SA 4.0.\nso it went on")]
    found = [r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.confirmed]
    runs = {(r.doc_id, r.pos, r.lines): (r.family, r.template) for r in found if r.lines > 1 and r.doc_id < 100}
    assert runs == {(k, v[2], v[3]): v[:2] for k, v in cases.items() if v[3] > 1}
    assert {(r.family, r.template) for r in found if r.doc_id == 103} == {("BSD", licenses.TEMPLATES["BSD"][0])}
    assert [(r.pos, r.lines, r.family) for r in found if r.doc_id == 104] == [(1, 1, "CC")] and not [r for r in found if 99 < r.doc_id < 103]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 24, 40])
def test_every_nine_lines_of_a_run_lie_in_one_piece(spark, n):
    df = spark.createDataFrame([(1, "\n".join(["", *(f"license {i}" for i in range(n)), ""]))], "doc_id long, text string")
    pieces = [(r.pos, r.pos + r.lines) for r in licenses.wrapped(df).collect()]
    assert len(pieces) == len(set(pieces)) and all(1 <= lo < hi <= n + 1 for lo, hi in pieces)
    assert n == 1 or all(any(lo <= i and i + min(n, 9) <= hi for lo, hi in pieces) for i in range(1, n + 2 - min(n, 9)))
    assert n > 9 or len(pieces) == (n > 1)


# 6 SimHash


def test_simhash_groups_equal_brute_force(spark, docs, texts):
    for n, radius, exact in ((4, 4, 4), (5, 8, 3)):
        fps = {d: simhash(t, n) for d, t in texts.items()}
        got = {r.doc_id: r for r in near.near_groups(docs, n, radius, exact).collect()}
        assert {d: r.fp % (1 << 64) for d, r in got.items()} == fps
        assert {d: r.component_id for d, r in got.items()} == groups(fps, radius)


def test_links_of_large_buckets_and_every_radius(spark, monkeypatch):
    rng = random.Random(6)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)} | {0, 1, (1 << 64) - 1}
    fps = {v - (1 << 64) if v >> 63 else v: v for v in values}
    df = spark.createDataFrame([(k,) for k in fps], "fp long")
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "SAMPLE", 1)
    for radius, exact in ((3, 2), (4, 4), (8, 3)):
        edges = near.links(df, radius, exact)
        label = {r.node: r.label for r in graph.components(edges).collect()}
        assert {k: label.get(k, k) for k in fps} == groups(fps, radius)


def test_one_document_of_each_group_stays(spark, odd):
    kept = near.one_per_group(odd)
    assert kept.columns == odd.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len(set(rows)) and [r.doc_id for r in rows].count(1) == 1 and (4, LONG) in rows
    assert sum((r.text or "").strip() == "" for r in rows) == 1  # all texts without words are one group
    assert near.one_per_group(odd.limit(0)).count() == 0
    assert near.fingerprint(b"", 5) == 0 and near.fingerprint(LONG.encode(), 4) == simhash(LONG, 4)


# 7 sharding


def test_shards_are_balanced_and_slots_gapless(spark, docs, texts):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(texts)
    loads, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    longest = max(r.size for r in rows)
    assert max(loads) <= 1.001 * sum(loads) / 8 + longest and all(sorted(s) == list(range(len(s))) for s in slots)


def test_a_new_shard_moves_little(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    a = {r.doc_id: r.shard for r in sharding.sharded(df, spare=0.05).collect()}
    b = {r.doc_id: r.shard for r in sharding.sharded(df, shards=9, spare=0.05).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


def test_arcs_go_on_clockwise(spark):
    place, owner = sharding.ring(3, 4)
    assert (np.diff(place.astype(object)) > 0).all() and sorted(owner) == sorted([0, 1, 2] * 4)
    load = np.zeros(12, np.int64)
    load[0] = 90
    got = sharding.allocation(owner, load, 3, 0.0)
    first = [int(owner[i % 12]) for i in range(12)]
    assert [s for _, _, s in got] == list(dict.fromkeys(first)) and [d for _, d, _ in got] == [0, 30, 60]


def test_sharding_on_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 2)
    rows = sharding.sharded(odd, by="rows").collect()
    assert len(rows) == 10 and {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert sharding.sharded(odd.limit(0)).count() == 0


# 8 toxicity


@pytest.fixture(scope="module")
def toxic_rows(spark):
    docs, known = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs.where("length(text) < 3000").join(known, "doc_id").orderBy("doc_id").limit(1500).select("doc_id", "text", "lang", "toxic").collect()


def test_toxicity_on_held_out_texts(toxic_rows):
    fit = [r for r in toxic_rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    rest = [r for r in toxic_rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    model = toxicity.train([r.text for r in fit[100:]], np.array([r.toxic for r in fit[100:]]))
    toxicity.calibrate(model, [r.text for r in fit[:100]], np.array([r.toxic for r in fit[:100]]), [r.lang for r in fit[:100]], 0.1)
    score = model.scores(pa.array([r.text for r in rest]))
    truth = np.array([r.toxic for r in rest])
    assert ((score >= 0.3) == truth).mean() > 0.93
    english = np.array([r.lang == "en" for r in rest])
    assert score[english & (truth == 1)].mean() > 0.7 > 0.3 > score[english & (truth == 0)].mean()
    # a text's score doesn't depend on what is scored with it, and a long text counts to its end
    assert np.allclose(score[:5], [model.scores(pa.array([r.text]))[0] for r in rest[:5]])
    insults = " idiot moron scum loser worthless pathetic trash clown stupid"
    long, short = model.scores(pa.array([LONG + insults, "some words" + insults]))
    assert abs(long - short) < 0.5 and long > 0.3


def test_pooling_looks_at_each_window():
    model = toxicity.Model.fresh()
    raw = np.frombuffer(b"aa bb cc dd", np.uint8)
    coded = toxicity.Words.of(raw, np.array([0, 5, 5, 11]))
    value, at = model.pooled(coded)
    vec = model.embedding[coded.buckets].mean(axis=1)
    for k, (width, f) in enumerate(zip(toxicity.WIDTHS, model.filters, strict=True)):
        for text, span in ((0, [0, 1]), (2, [2, 3])):
            answers = [sum(vec[coded.word[s + j]] @ f[j] for j in range(width) if s + j in span) for s in span]
            assert np.allclose(np.maximum(np.max(answers, axis=0), 0), value[text, k * 8 : k * 8 + 8])
    assert (value[1] == 0).all() and (at[1] == -1).all()


def test_toxicity_on_odd_rows(spark, odd):
    known = labels(spark, [(1, 1, 1), (5, 1, 0), (3, 1, 0), (None, 1, 1), (7, 1, None)])
    for some in (known, labels(spark)):
        rows = toxicity.scored(odd, toxicity.fitted(odd, some)).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(odd.limit(0), toxicity.train([], np.array([]))).count() == 0


# 9 main text


def test_blocks_of_untidy_pages():
    page = '<!doctype html><title>T</title><nav><ul><li><a href="x>y">A</a><li>B</ul></nav><p>one<br>two &amp;&nbsp;three<p><b>four <i>five</b></i><script>if (a<b) "</p>"</script><!-- <p>no --><div class=ad>six</div>7 < 8'
    assert [t for t, _, _ in html_text.blocks(page)] == ["A", "B", "one two & three", "four five", "six", "7 < 8"]
    for page, want in (
        ("<p>a</p><svg/><p>b</p>", "ab"), ("<p>a</p><iframe src=x /><p>b</p>", "ab"), ("<p>a</p><title-bar>x</title-bar><select-box>y</select-box><p>b</p>", "axyb"),
        ("<div><p>a</p><form><textarea>n</form></div><p>b</p>", "ab"), ("<p>a <math><mi>x</mi></math></p>", "a x"), ("<div>a<select><option>n<option>n</div><p>b", "ab"),
        ("<svg><title>n</title><g><text>n</text></g></svg><p>b", "b"), ("<svg><foreignObject><p>n</p></foreignObject></svg>b", "b"), ("<svg><path><p>b", "b"),
        ("<script>if (a<b) n</script >b<script src=x /><p>c", "bc"), ("<textarea><p>n</textarea>b<textarea>n</textarea>", "b"), ("<object><div>n</div></object>b<object/>c", "bc"),
        ("<title>n<body>b", "b"), ("<style-guide>a</style-guide><scripted>b", "ab"), ("<template><div>n</template>b</div>c", "bc"), ("<svg><svg/><svg>n</svg>n</svg>b", "b"),
    ):
        assert "".join(t for t, _, _ in html_text.blocks(page)) == want, page
    assert [[tag for tag, _ in p] for _, p, _ in html_text.blocks("<ul><li>a<ul><li>b</ul><li>c</ul><p>d<div>e")] == [["ul", "li"], ["ul", "li", "ul", "li"], ["ul", "li"], ["p"], ["div"]]
    for broken in ("", "<", "<p", "<a href='", "<script>never closed <p>x", "<!-- open", "</p></div>", "<p>" * 3000 + "x"):
        html_text.blocks(broken)


def test_gradients_of_the_recurrent_labeller():
    pages = html_text.made_pages(["uno", "dos", "tres"], 3, seed=8)
    model = html_text.Labeller(2)
    coded, lengths, y = html_text.Coded.of([p for p, _ in pages]), [len(p) for p, _ in pages], np.concatenate([y for _, y in pages]).astype(float)

    def loss():
        x, there = html_text._padded(model.vectors(coded), lengths)
        z, goal = model.logits(x, there), html_text._padded(y[:, None], lengths)[0][:, :, 0]
        return float((there * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - goal * z)).sum() / there.sum())

    grads = model.step(coded, lengths, y)
    for name, at in (("wf", (3, 5)), ("wb", (20, 30)), ("bf", (40,)), ("out", (4,)), ("out", (20,)), ("tag", (int(coded.tag[4]), 2)), ("word", (int(coded.word[3]), 1)), ("wb", (-2, 60))):
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_main_text_of_given_and_unseen_pages(spark):
    import re
    from html import unescape

    rows = queries.QUERIES["op9_html_text"](spark, f"{DATA}/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    wrong = 0
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        wrong += r.text != "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert len(rows) == 250 and wrong <= 2
    model = html_text.train(html_text.made_pages(["uno", "dos", "tres", "cuatro"], 300))
    test = html_text.made_pages(["five", "six", "seven"], 100, seed=77)
    found = model.labels([p for p, _ in test])
    assert np.mean(np.concatenate(found) == np.concatenate([y for _, y in test])) > 0.95


def test_main_text_on_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<article><p>a text of some words, long enough to be one.</p></article>"), (3, "w", "<p>" + LONG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extracted(pages, html_text.fitted(pages), keep=("url",)).collect()
    assert len(got) == 5 and sum(r.text == "" for r in got) >= 3
    assert html_text.extracted(pages.limit(0), html_text.fitted(pages.limit(0))).count() == 0


# 10 packing


def test_fillings_are_the_best_that_fit():
    import itertools

    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randint(1, 19): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 25)
        got = packing._fill(counts, room)
        best = max(s for s in (sum(k * n for k, n in zip(counts, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts.values()))) if s <= room)
        assert sum(k * n for k, n in got) == best and all(n <= counts[k] for k, n in got)
        plan = packing.fillings(counts, 20)
        used = {}
        for times, content in plan:
            assert sum(k * n for k, n in content) <= 20
            for k, n in content:
                used[k] = used.get(k, 0) + times * n
        assert used == counts


def _check_packing(rows, bodies):
    from tokenizers import Tokenizer

    tokenizer, seqs, pieces = Tokenizer.from_file(TOKENIZER), {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert set(pieces) == set(bodies)
    for d, own in pieces.items():
        ids = np.array([*tokenizer.encode(bodies[d], add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows) / (2048 * len(seqs))


def test_packing_is_a_round_trip_with_little_padding(docs, texts):
    assert _check_packing(packing.packed(docs, TOKENIZER).collect(), texts) > 0.97


def test_packing_on_odd_rows(spark, odd):
    rows = packing.packed(odd, TOKENIZER).collect()
    bodies = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null and doc_id > 1").collect()}
    _check = [r for r in rows if r.doc_id is not None and r.doc_id > 1]
    assert len([r for r in rows if r.doc_id == 1]) == 2 and {r.doc_id for r in _check} == set(bodies)
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (2, 3)} == {(1, 1)}
    assert packing.packed(odd.limit(0), TOKENIZER).count() == 0
    encode = packing.Encoder(TOKENIZER)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "", " \n  x", "'ll don't 12 ３ é", "​z\x85y"):
        assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
