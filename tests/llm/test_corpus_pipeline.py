"""The corpus pipeline, stage by stage, against plain versions on a small corpus."""

import corpus_pipeline as cp
import pytest
from helpers import CLASHES, DATA, odd_docs, shingle_set, without_repeats
from test_likeness import _kept
from test_text_operators import _check_packing

from courtspark.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_stages_equal_plain_versions(spark, sf):
    sf_dir = f"{DATA}/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    tables = []
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        tables.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    first, lines, distinct, clean = ({r.doc_id: r.text for r in t.collect()} for t in tables[:4])
    assert all(d in first for d, good in labels.items() if good) and sum(d in first for d, good in labels.items() if not good) <= 0.3 * sum(not g for g in labels.values())
    want = without_repeats(sorted(first.items()))
    assert lines == {d: t for d, t in want.items() if t == first[d] or t.strip()}
    assert all(r.n_chars == len(r.text) for r in tables[1].collect())
    assert set(distinct) == _kept({d: shingle_set(t) for d, t in lines.items()})
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, t in distinct.items() if not any(b in t for b in items)}
    rows = tables[4].collect()
    assert _check_packing(rows, clean) > 0.95
    assert sorted(r.doc_tokens for r in cp.run(spark, sf_dir).collect()) == sorted(r.doc_tokens for r in rows)


def test_stages_on_odd_rows_and_an_empty_table(spark):
    sf_dir = f"{DATA}/sf0.001"
    odd = odd_docs(spark)
    for start in (odd, odd.limit(0)):
        docs = stored(start, "odd")
        for _, stage in cp.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "stage")
            assert docs.columns == [*COLUMNS, *CLASHES]
        cp.STAGES[-1][1](spark, docs, sf_dir).collect()
