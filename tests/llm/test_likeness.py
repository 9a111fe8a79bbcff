"""Near-duplicates by Jaccard similarity against all pairs compared."""

import random

import corpus_pipeline as cp
import pytest
from helpers import LONG, jaccard, odd_docs, shingle_set, simhash
from pyspark.sql import functions as F

from courtspark.llm import likeness


def _pairs(rng, n):
    """(text, edited copy) with a Jaccard similarity of five-word shingles around 0.8."""
    for k in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        copy = list(words)
        for _ in range(max(1, round(len(words) * rng.uniform(0.002, 0.04)))):
            copy[rng.randrange(len(copy))] = f"x{k}-{rng.randrange(10**6)}"
        yield " ".join(words), " ".join(copy)


def _kept(sets, least=0.8):
    ids, label = sorted(sets), {}
    for k in ids:
        if k in label:
            continue
        label[k], queue = k, [k]
        while queue:
            one = queue.pop()
            for other in ids:
                if other not in label and jaccard(sets[one], sets[other]) >= least:
                    label[other] = k
                    queue.append(other)
    return set(label.values())


def test_the_stage_takes_copies_of_similarity_08_and_no_others(spark):
    rows, like = [], {}
    for k, (text, copy) in enumerate(_pairs(random.Random(1), 300)):
        rows += [(2 * k, text), (2 * k + 1, copy)]
        like[2 * k + 1] = jaccard(shingle_set(text), shingle_set(copy))
    assert sum(0.8 <= s < 0.9 for s in like.values()) > 50 and sum(0.6 < s < 0.8 for s in like.values()) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in cp.distinct(spark, docs, "").collect()}
    assert kept == {d for d, _ in rows if like.get(d, 0) < 0.8}


def test_the_stage_holds_simhash_groups_against_each_other(spark, monkeypatch):
    """Without a shared min-hash bucket, copies within 8 bits are found by SimHash; the exact similarity decides on them."""
    rows, gone = [(0, "")], set()
    for k, (text, copy) in enumerate(_pairs(random.Random(3), 300), 1):
        rows += [(2 * k, text), (2 * k + 1, copy)]
        if (simhash(text, 5) ^ simhash(copy, 5)).bit_count() <= 8 and jaccard(shingle_set(text), shingle_set(copy)) >= 0.8:
            gone.add(2 * k + 1)
    assert len(gone) > 50
    made = likeness.signatures
    monkeypatch.setattr(likeness, "signatures", lambda *args: made(*args).withColumn("bands", F.array("node")))
    kept = {r.doc_id for r in cp.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {d for d, _ in rows} - gone


@pytest.mark.parametrize("wide", [2, 10**6])
def test_a_large_group_equals_all_pairs(spark, monkeypatch, wide):
    rng, rows = random.Random(2), []
    base = [f"w{k}" for k in range(200)]
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(10)):
            words[rng.randrange(200)] = f"x{rng.randrange(30)}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(likeness, "WIDE", wide)
    monkeypatch.setattr(likeness, "BLOCK", 16)
    monkeypatch.setattr(likeness, "FIRST", 1)
    kept = {r.doc_id for r in likeness.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == _kept({d: shingle_set(t) for d, t in rows})


def test_odd_rows(spark):
    odd = odd_docs(spark)
    kept = likeness.one_per_group(odd)
    rows = kept.select("doc_id", "text").collect()
    assert kept.columns == odd.columns and len(rows) == len(set(rows)) and [r.doc_id for r in rows].count(1) == 1 and (4, LONG) in rows
    assert sum((r.text or "").strip() == "" for r in rows) == 1
    assert likeness.one_per_group(odd.limit(0)).count() == 0
