import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtspark import blocks as B


def lane_rows(seed, n=120, top=400):
    rnd = random.Random(seed)
    rows = []
    for key in (1, 2, 3):
        for at in sorted(rnd.sample(range(top), n)):
            rows.append((key, at, rnd.choice([None, rnd.randint(0, 9)])))
    return rows


@pytest.mark.parametrize("span", [1, 7, 64, 100000])
def test_scan_equals_plain_windows(spark, span):
    df = spark.createDataFrame(lane_rows(1), "k int, frame bigint, v int")
    w = Window.partitionBy("k").orderBy("frame")
    full = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "k", "frame", "v",
        F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"),
        F.last("v", True).over(full).alias("c"), F.last("v", True).over(before).alias("d"),
        F.first("v", True).over(after).alias("e"),
        F.coalesce(F.sum("v").over(full), F.lit(0)).alias("f"), F.row_number().over(w).alias("g"),
    )
    v = F.col("v")
    got = B.scan(
        df, B.Lane(("k",), span=span), a=B.Prev(v), b=B.Next(v), c=B.LastSeen(v),
        d=B.LastSeen(v, False), e=B.NextSeen(v, False), f=B.RunningSum(v), g=B.RowNumber(),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("span", [1, 5, 64, 100000])
def test_trailing_equals_plain_windows(spark, span):
    df = spark.createDataFrame(lane_rows(2), "k int, frame bigint, v int")
    w = Window.partitionBy("k").orderBy("frame").rowsBetween(-9, 0)
    want = df.select(
        "k", "frame",
        F.coalesce(F.sum("v").over(w), F.lit(0)).cast("double").alias("s"), F.count("v").over(w).alias("c"),
        F.round(F.avg("v").over(w), 9).alias("m"), F.collect_list(F.struct("v")).over(w).alias("l"),
    )
    v = F.col("v")
    got = B.trailing(df, B.Lane(("k",), span=span), 10, s=("sum", v), c=("count", v), m=("avg", v), l=("list", v))
    got = got.select("k", "frame", "s", "c", F.round("m", 9).alias("m"), "l")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("span,limit", [(1, None), (5, None), (16, 4), (4096, 16)])
def test_greedy_spacing(spark, span, limit):
    rows = [(k, f, v) for k, f, v in lane_rows(3, 150, 300)]
    want = []
    for key in (1, 2, 3):
        ready, n = None, 0
        for k, f, _ in rows:
            if k == key and (ready is None or f >= ready) and (limit is None or n < limit):
                want.append((k, f))
                ready, n = f + 8, n + 1
    df = spark.createDataFrame(rows, "k int, frame bigint, v int")
    got = B.greedy_spacing(df, B.Lane(("k",), span=span), 8, limit)
    assert sorted((r.k, r.frame) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("span", [1, 9, 4096])
def test_ema(spark, span):
    rows = lane_rows(4)
    want = {}
    for key in (1, 2, 3):
        y = None
        for k, f, v in rows:
            if k == key:
                if v is not None:
                    y = float(v) if y is None else 0.9 * y + 0.1 * v
                want[k, f] = y
    df = spark.createDataFrame(rows, "k int, frame bigint, v int")
    for r in B.ema(df, B.Lane(("k",), span=span), 0.1, y=F.col("v")).collect():
        expect = want[r.k, r.frame]
        assert (r.y is None and expect is None) or abs(r.y - expect) < 1e-9
