"""Toxicity is learnt from all labelled texts, in parts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courtspark.llm import toxicity


def _corpus(spark, n, words):
    """Every tenth text is toxic; ``words`` is asked for the mark of each."""
    rng, rows = random.Random(3), []
    for i in range(n):
        text = [rng.choice(("sun", "rain", "road", "tree", "house", "river", "bread", "stone")) for _ in range(12)]
        text.insert(rng.randrange(12), words(i, i % 10 == 0))
        rows.append((i, " ".join(text), ("en", "de")[i % 2]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_counts_come_from_all_labelled_texts(spark, monkeypatch):
    seen = []
    begin = toxicity.begin
    monkeypatch.setattr(toxicity, "begin", lambda counts, total, *a: seen.append((counts, total)) or begin(counts, total, *a))
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    docs, labels = _corpus(spark, 6000, lambda i, bad: "grumph" if bad else "plain")
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 10, F.concat(F.repeat(F.lit("sun "), 10_000), F.col("text"))).otherwise(F.col("text")))
    toxicity.fitted(docs.unionByName(docs.where("doc_id < 50")), labels)
    (counts, total), = seen
    aside = spark.range(6000).where("pmod(xxhash64(id), 5) = 0").collect()
    bad = 600 - sum(r[0] % 10 == 0 for r in aside)
    assert total.tolist() == [6000 - len(aside) - bad, bad]
    raw = np.frombuffer(b"grumph", np.uint8)
    bucket = toxicity.Words.of(raw, np.array([0, 6])).buckets[0, 0]
    assert counts[:, bucket].tolist() == [0, bad]


def test_parts_learn_what_one_list_does(spark, monkeypatch):
    """A rare mark that a sample would miss is told in every part."""
    monkeypatch.setattr(toxicity, "PART", 300)
    docs, labels = _corpus(spark, 2000, lambda i, bad: ("grumph", "blarg")[i // 10 % 2] if bad else "plain")
    model = toxicity.fitted(docs, labels)
    again = toxicity.fitted(docs.repartition(7), labels)
    texts = pa.array(["sun rain grumph road tree", "sun rain blarg road tree", "sun rain plain road tree", ""])
    score = model.scores(texts)
    assert score[:2].min() > 0.7 and score[2:].max() < 0.3
    assert np.array_equal(score, again.scores(texts)) and model.thresholds == again.thresholds
    rows = toxicity.scored(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.toxic for r in rows]) > 0.98


@pytest.mark.parametrize("which", [0, 1])
def test_texts_of_one_label_give_one_score(spark, which):
    docs, labels = _corpus(spark, 40, lambda i, bad: "plain")
    rows = toxicity.scored(docs, toxicity.fitted(docs, labels.where(f"toxic = {which}"))).collect()
    assert len({r.score for r in rows}) == 1 and (rows[0].score > 0.5) == bool(which)


def test_few_texts_without_a_label_are_shuffled(spark):
    """All rows with a label pass the slot bits, whatever the type of the id, and hardly any other."""
    ids = [*range(-3000, 3000), 1 << 60, None]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(i, "x") for i in ids], "known_id long, body string").unionByName(spark.createDataFrame([(7, "y")], "known_id long, body string"))
        docs = docs.withColumn("known_id", F.col("known_id").cast(kind))
        known = docs.where("pmod(CAST(known_id AS long), 7) = 0").select("known_id").distinct()
        rows = toxicity._likely(docs, known)
        got = rows.collect()
        assert rows.columns == docs.columns and sum(int(r[0]) % 7 == 0 for r in got) == docs.join(known, "known_id").count()
        assert len(got) < 900
    assert toxicity._likely(docs, known.withColumn("known_id", F.col("known_id").cast("long"))).count() == docs.count()


def test_texts_without_a_label_are_left_out_before_the_join(spark, monkeypatch, tmp_path):
    joined = []
    stored = toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, label: joined.append(df) or stored(df, label) if label == "toxicity-texts" else stored(df, label))
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    docs, labels = _corpus(spark, 400, lambda i, bad: "grumph" if bad else "plain")
    toxicity.fitted(docs, labels.where("doc_id < 100"))
    plan = joined[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "slot_bits" in plan
