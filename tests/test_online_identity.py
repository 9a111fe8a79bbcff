"""Online identities from incremental state against the batch operators and a plain loop."""

import math
import os
import random

from pyspark.sql import functions as F

from courtspark.operators import identity
from courtspark.session import fresh_dir
from courtspark.streaming.identity import OnlineIdentity

BOXES = "match_id BIGINT, raw_id BIGINT, frame BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"


def boxes(rng, matches=2, ids=5, frames=260):
    out = []
    for m in range(matches):
        for r in range(ids):
            for f in sorted(rng.sample(range(frames), rng.choice([1, 7, 60, 200]))):
                x = rng.uniform(0, 1000)
                out.append((m, r, f, x, rng.uniform(0, 300), x + 50, rng.uniform(300, 700)))
    return out


def test_tracklet_parts_of_batches_equal_one_pass(spark):
    rows = boxes(random.Random(3))
    whole = spark.createDataFrame(rows, BOXES)
    parts = None
    for low, high in ((0, 9), (9, 10), (10, 140), (140, 141), (141, 260), (260, 300)):  # the last one is empty
        parts = identity.tracklet_parts(whole.filter(F.col("frame").between(low, high - 1)), 1280.0, 720.0, parts)
        path = fresh_dir(spark, "parts")
        parts.write.parquet(path)
        parts = spark.read.parquet(path)
    key = lambda r: (r["match_id"], r["raw_id"])
    got = {key(r): r for r in identity.finished_tracklets(parts).collect()}
    want = {key(r): r for r in identity.build_tracklets(whole, 1280.0, 720.0).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    for k, w in want.items():
        g = got[k]
        assert [g[c] for c in ("frame_min", "frame_max", "length", "samples")] == [w[c] for c in ("frame_min", "frame_max", "length", "samples")]
        assert math.isclose(g["mean_fx"], w["mean_fx"], abs_tol=1e-12) and math.isclose(g["mean_fy"], w["mean_fy"], abs_tol=1e-12)


def test_vector_sums_of_batches_equal_one_pass(spark):
    rng = random.Random(5)
    rows = [(i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(0, None), (1, [])]
    crops = spark.createDataFrame(rows, "k BIGINT, embedding ARRAY<DOUBLE>")
    halves = spark.createDataFrame(rows[:17], crops.schema), spark.createDataFrame(rows[17:], crops.schema)
    merged = identity.unit_means(identity.vector_sums(halves[1], ["k"], identity.vector_sums(halves[0], ["k"])), ["k"])
    want = {r["k"]: r["embedding"] for r in identity.mean_embedding(crops, ["k"]).collect()}
    got = {r["k"]: r["embedding"] for r in merged.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-12) for k in want for a, b in zip(got[k], want[k], strict=True))


def feed(start):
    """Four players in their corners; ids change at frame 40; the match starts in frame ``start``."""
    out = []
    for f in range(90):
        for s in range(4):
            x, y = 100.0 + 900 * (s % 2) + f % 3, 100.0 + 400 * (s // 2)
            look = [math.cos((s + 1) * i) for i in range(1, 17)]
            out.append((7, f, s + 10 * (f >= 40), x, y, x + 40, y + 90, look, f == start))
    return out


def run(spark, rows, cuts, twice=()):
    names = "match_id BIGINT, frame BIGINT, raw_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, embedding ARRAY<DOUBLE>, started BOOLEAN"
    job, out = OnlineIdentity(spark, 1280.0, 720.0), []
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, 1000])):
        batch = spark.createDataFrame([r for r in rows if low <= r[1] < high], names)
        if n in twice:
            job.process(batch, n)
        out += [(r["frame"], r["raw_id"], r["slot"]) for r in job.process(batch, n).collect()]
    return job, sorted(out)


def plain_positions(rows, slot_of, until):
    """The smoothed position of each slot, row by row."""
    pos = {}
    for _, f, raw, x1, _, x2, y2, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        if f < until and raw in slot_of:
            feet, s = ((x1 + x2) / 2560, y2 / 720), slot_of[raw]
            pos[s] = feet if s not in pos else tuple(0.9 * p + 0.1 * q for p, q in zip(pos[s], feet))
    return pos


def test_frozen_identities_and_newcomers(spark):
    rows = feed(start=25)
    job, out = run(spark, rows, [20, 30, 60], twice=(1,))  # the batch that freezes is tried again
    assert len(out) == 360 and {(raw % 10, slot) for _, raw, slot in out} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    got = {r["slot"]: (r["pos_x"], r["pos_y"]) for r in job._read("positions", 3, "slot INT, pos_x DOUBLE, pos_y DOUBLE").collect()}
    want = plain_positions(rows, {raw: raw % 10 + 1 for raw in (0, 1, 2, 3, 10, 11, 12, 13)}, 90)
    assert got.keys() == want.keys() and all(math.isclose(a, b, abs_tol=1e-9) for s in want for a, b in zip(got[s], want[s]))
    for batch in (2, 3):  # after the start nothing of a match's rows or tracklets is kept in what a later batch reads
        assert job._read("parts", batch, "match_id BIGINT").count() == 0 and job._read("sums", batch, "match_id BIGINT").count() == 0
        assert not os.path.exists(f"{job._path('rows', batch)}/warm=true") and job._read("positions", batch, "slot INT").count() == 4


def test_a_start_without_clusters_takes_positions(spark):
    _, out = run(spark, feed(start=2), [4])
    assert {(raw % 10, slot) for _, raw, slot in out} == {(0, 1), (1, 2), (2, 3), (3, 4)}
