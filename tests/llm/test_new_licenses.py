"""Licence scoring hands on a row per paragraph, and repeated rows count once."""

from courtspark.llm import licenses

TEXT = "some plain words\n\nReleased under the MIT License\nmore plain words here"


def test_repeated_rows_score_like_single_ones(spark, monkeypatch):
    plans = []
    keep = licenses.stored
    monkeypatch.setattr(licenses, "stored", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, label))
    rows = [(i, f"text {i} with words of its own\nand a second line {i * 7}") for i in range(60)] + [(100, TEXT), (101, TEXT), (101, TEXT), (101, TEXT), (None, TEXT), (None, TEXT)]
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    probability = {r.doc_id: r.probability for r in found if r.lines == 1 and r.confirmed and r.family == "MIT"}
    assert set(probability) == {100, 101, None} and max(probability.values()) - min(probability.values()) < 1e-9
    assert len([r for r in found if r.confirmed and r.lines == 1]) == 3
    (plan,) = [p for label, p in plans if label == "licences"]
    assert "distinct gram" not in plan and "Expand" not in plan
