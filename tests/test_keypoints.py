"""Keypoint work over rows with nulls, odd values and other array lengths, and how often its arrays are made."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from courtspark.functions import labels as L
from courtspark.operators import datasets
from courtspark.plans import domain as D
from oracle import DATA

KEYPOINTS = "image_id long, bbox array<double>, keypoints array<double>, part long"


def plan(spark, name):
    return entry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["pose_labels", "keypoint_triples", "sample_geometry", "hitter_choice", "shot_labels", "eval_pose"])
def test_keypoint_arrays_are_made_once_and_by_batch(spark, name):
    text = plan(spark, name)
    assert "sequence(0, CASE WHEN" not in text and text.count("made(cast(round(l_extendedprice") <= 1


def test_made_keypoints_equal_their_formula(spark, tmp_path):
    rows = [(1, 2, 3, 4.0, p, c) for p in (0.4, 7.5, -5000.7, 1e9, None) for c in (1, 7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rest = lambda a, b: abs(a) % b * (1 if a >= 0 else -1)
    got = D.annotations(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        n = 48 if r.category_id == 7 else 51
        assert r.keypoints == [None if r.cents is None else float(rest(r.cents + i * (31, 17, 1)[i % 3], (1920, 1080, 3)[i % 3])) for i in range(n)]


def test_triples_of_a_batch(spark):
    rows = [(list(map(float, range(51))), 10, 4), ([1.0] * 48, 10, 4), (None, 10, 4), ([None, 3.0, 2.9] * 17, 10, 4), ([1.0, 2.0, -1.9] * 17, None, 4)]
    got = [r.t for r in spark.createDataFrame(rows, "k array<double>, w int, h int").select(L.keypoint_triples(F.col("k"), "w", "h").alias("t")).collect()]
    assert [tuple(p) for p in got[0]] == [(3 * i / 10, (3 * i + 1) / 4, 3 * i + 2) for i in range(17)] and got[1:3] == [None, None]
    assert [tuple(p) for p in got[3]] == [(None, 0.75, 2)] * 17 and [tuple(p) for p in got[4]] == [(None, 0.5, -1)] * 17


def test_label_text_of_a_batch(spark):
    """Both ways of writing a batch: lines of one length, and any line."""
    rnd = random.Random(5)
    plain = [tuple(rnd.randrange(1921) / rnd.choice([1920, 1080, 128, 1]) % 9 for _ in range(4)) for _ in range(200)]
    even = [(i % 12, *b, [(rnd.randrange(1921) / 1920, k / 2**20, k % 10) for k in range(17)]) for i, b in enumerate(plain)] + [(0, 0.5046875, 2.5e-6, 0.9999999, 8.9999999, [(0.0000005, 1.0, 2)] * 17)]
    odd = [(1, -0.25, 12345.5, -0.0, -1e-9, [(-0.5, 1e8, 11)]), (2, None, 0.5, 0.25, 1.0, [(None, 0.5, 0), (0.1, None, None)]), (3, 0.5, 0.5, 0.5, 0.5, None), (4, 0.5, 0.5, 0.5, 0.5, [])]
    schema = "c int, cx double, cy double, w double, h double, t array<struct<x:double,y:double,v:int>>"

    def six(values):
        return " ".join(v if isinstance(v, str) else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in values if v is not None)

    for rows in (even, odd):
        got = spark.createDataFrame(rows, schema).coalesce(1).select(L.label_line("c", "cx", "cy", "w", "h", F.col("t")).alias("line")).collect()
        assert [r.line for r in got] == [six([c, *b, t if t is None else " ".join(map(six, t))]) for c, *b, t in rows]
    assert got[0].line == "1 -0.250000 12345.500000 0.000000 -0.000000 -0.500000 100000000.000000 11"


def test_pose_labels_shuffles_annotations_once_and_stores_none(spark):
    df = entry.queries()["pose_labels"](spark, f"{DATA}/sf0.001")
    assert {f.rsplit("/", 1)[1] for f in df.inputFiles()} == {"lineitem.parquet", "orders.parquet"}
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(image_id") == 2 and "SortMergeJoin [image_id" not in text


def test_pose_labels_of_whole_and_other_numbers(spark):
    images = [(k, "v", f"frame_{k:06d}.PNG", 1920, 1080, "more") for k in (1, 2, 2, 3)] + [(None, "v", "frame_000009.PNG", 1920, 1080, "more")]
    base = [float((7 * i) % 1000) for i in range(51)]
    odd = lambda i, v: [*base[:i], v, *base[i + 1 :]]
    keypoints = [base, odd(0, 3.25), odd(1, 40000.0), odd(3, -1.0), odd(4, -0.0), odd(6, 1e9), odd(7, None), base[:48], None, [*base, 1.0]]
    rows = [(k, [10.0, 20.0, 30.0, 40.0], p) for k in (1, 2, 8, None) for p in keypoints]
    got = datasets.pose_labels(
        spark.createDataFrame(images, "image_id long, video string, file_name string, width int, height int, other string"),
        spark.createDataFrame(rows, "image_id long, bbox array<double>, keypoints array<double>"), 0.5,
    ).collect()

    def line(points):
        numbers = [None if v is None else v / (1920, 1080)[i % 3] + 0.0 if i % 3 < 2 else int(v) for i, v in enumerate(points)]
        box = [25 / 1920, 40 / 1080, 30 / 1920, 40 / 1080]
        return " ".join(["0", *[str(v) if isinstance(v, int) else f"{v:.6f}" for v in [*box, *numbers] if v is not None]])

    # two rows of image 2, one in each split
    want = [(s, f"v_frame_{k:06d}", line(p)) for k, s in ((1, "train"), (2, "train"), (2, "val")) for p in keypoints[:7]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_limbs_of_a_batch(spark):
    seen = [(i / 16, 1 - i / 16, 2) for i in range(17)]
    rows = [(1, seen), (2, None), (3, [(x, y, 0) for x, y, _ in seen]), (4, [(None, -0.3, 1)] * 2 + [(0.1, 0.1, None)] * 15)]
    df = spark.createDataFrame(rows, "id int, kp array<struct<x:double,y:double,v:int>>").select("*", *[F.lit(0.5).alias(c) for c in ("cx", "cy", "w", "h")])
    got = {r.id: [tuple(e) for e in r.limbs] for r in datasets.sample_geometry(df, 100, 50).collect()}
    px = lambda i: (int(seen[i][0] * 100), int(seen[i][1] * 50))
    assert got == {1: [(*px(a), *px(b)) for a, b in datasets.SKELETON], 2: [], 3: [], 4: [(None, -15, None, -15)]}


def test_hitters_of_asked_frames_join_scores_not_keypoints(spark):
    def person(image, part, shoulder, wrist, seen):
        k = [(0.0, 0.0, 2.0 if i < seen else 1.0) for i in range(17)]
        k[5], k[9] = (0.0, shoulder, 2.0), (0.0, wrist, 2.0 if wrist is not None else None)
        return image, [float(part)] * 4, [v for p in k for v in p], part

    rows = [person(1, 1, 50.0, 40.0, 3), person(1, 2, 50.0, 20.0, 3), person(2, 3, 50.0, 48.0, 4), person(2, 4, 50.0, None, 9), person(3, 5, 9.0, 1.0, 1), (1, None, None, 6), (2, [0.0], [2.0] * 48, 7)]
    a = spark.createDataFrame(rows, KEYPOINTS)
    frames = spark.createDataFrame([(1, "a"), (2, "b")], "image_id long, name string")
    some = datasets.hitters(a, ["name"], ["part"], frames)
    assert {r.name: (r.swing, r.part) for r in some.collect()} == {"a": (30.0, 2), "b": (2.0, 4)}
    assert {r.image_id: (r.swing, r.part) for r in datasets.hitters(a, ["image_id"], ["part"]).collect()} == {1: (30.0, 2), 2: (2.0, 4), 3: (8.0, 5)}
    joined = some._jdf.queryExecution().optimizedPlan().toString()
    assert "keypoints" not in joined.split("Join Inner")[0]


def test_visibility_is_counted_without_a_lambda_to_pick_it(spark, tmp_path):
    rows = [(o, 2, 3, 4.0, p, c) for o in (1, 2) for p in (0.4, 7.5, 1e6 + 2, None) for c in (1, 3, 4, 7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["eval_pose"](spark, str(tmp_path))
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for o, *_, p, c in rows:
        cents = None if p is None else int(p + 0.5)
        sums = want.setdefault(("pose" if c is not None and c < 4 else "pose_s", "FinalF" if o % 2 == 0 else "FinalM"), [0, 0])
        sums[0] += 16 if c == 7 else 17
        sums[1] += 0 if cents is None else sum((cents + i) % 3 > 0.5 for i in range(2, 48 if c == 7 else 51, 3))
    assert {(r.model, r.video): (r.keypoints, r.kpt_visibility) for r in df.collect()} == {k: (n, round(s / n, 4)) for k, (n, s) in want.items()}


def test_visibility_of_missing_keypoints(spark):
    from courtspark.operators import detections

    rows = [("a", "x", [(0.9,), (None,), None, (0.5,)]), ("a", "x", None), ("b", "x", []), ("c", "x", None)]
    got = detections.keypoint_visibility(spark.createDataFrame(rows, "model string, video string, keypoints array<struct<v: double>>")).collect()
    assert {r.model: (r.keypoints, r.kpt_visibility) for r in got} == {"a": (4, 0.25), "b": (0, 0.0), "c": (None, 0.0)}
