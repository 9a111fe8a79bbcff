"""Small hand-made matches: rallies, serves, shots, lifecycle, stats and teams."""

import random

import pytest
from pyspark.sql import functions as F

from courtspark.functions import geometry as G
from courtspark.operators import lifecycle, rallies, stats


def frame_rows(spark, seen, match=1, stride=1):
    return spark.createDataFrame([(match, i * stride, bool(s)) for i, s in enumerate(seen)], "match_id bigint, frame bigint, seen boolean")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rally_starts_at_third_seen_frame_and_ends_after_twelve_misses(spark):
    f = frame_rows(spark, [1, 1, 1] + [0] * 15)
    assert pairs(rallies.rallies(f), "start_frame", "end_frame") == [(2, 14)]
    assert rallies.rallies(frame_rows(spark, [1] + [0] * 20)).count() == 0


def plain_rallies(frames):
    """(start, end) of closed rallies of (frame, seen) rows, looking back over all rows each time."""
    out, start = [], None
    for n, (frame, _) in enumerate(frames):
        if start is None and sum(s for _, s in frames[max(0, n - 9) : n + 1]) >= 3:
            start = n
        elif start is not None and n - max([start, *(k for k in range(start, n + 1) if frames[k][1])]) >= 12:
            out.append((frames[start][0], frame))
            start = None
    return out


@pytest.mark.parametrize("span", [4, 65536])
def test_rallies_equal_the_state_machine(spark, span):
    rnd = random.Random(5)
    rows, want = [], []
    for match in range(4):
        at, own = 0, []
        for _ in range(250):
            at += rnd.choice([1, 1, 1, 2])
            own.append((at, rnd.random() < (0.5 if (at // 60) % 2 else 0.08)))
        rows += [(match, *r) for r in own]
        want += [(match, *r) for r in plain_rallies(own)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, seen boolean")
    assert want and pairs(rallies.rallies(df, span=span), "match_id", "start_frame", "end_frame") == sorted(want)


@pytest.mark.parametrize("gap,hit", [(20, True), (19, False)])
def test_serve_needs_twenty_still_frames(spark, gap, hit):
    f = frame_rows(spark, [1] * 2 + [0] * gap + [1])
    assert (rallies.serve_starts(f).count() == 1) is hit


def test_shot_cooldown_and_winner(spark):
    shots = spark.createDataFrame([(1, i, 1, 1, "drive") for i in range(20)], "match_id bigint, frame bigint, ord int, slot int, shot_type string")
    assert [r[0] for r in pairs(rallies.accepted_shots(shots, span=4), "frame")] == [0, 8, 16]
    found = spark.createDataFrame([(1, 2, 14)], "match_id bigint, start_frame bigint, end_frame bigint")
    one = spark.createDataFrame([(1, 3, 1, 2, "lob"), (1, 2, 1, 1, "lob")], shots.schema)
    inside = rallies.shots_in_rallies(one, found)
    players = spark.createDataFrame([(1, 14, 2, 0)], "match_id bigint, frame bigint, slot int, team int")
    end = rallies.rally_ends(found, inside, players).first()
    assert (end.shots_in_rally, end.last_hitter, end.winner_team) == (1, 2, 0)


def test_lifecycle_rules(spark):
    rows = [(1, 100, "start"), (1, 200, "start"), (2, 50, "start"), (2, 60, "end"), (2, 70, "start"), (3, 5, "auto"), (3, 40, "start"), (4, 5, "end"), (5, 1, "start"), (5, 9, "reset")]
    got = {(r.match_id, r.epoch): r for r in lifecycle.lifecycle_states(spark.createDataFrame(rows, "match_id bigint, frame bigint, action string")).collect()}
    assert (got[1, 0].state, got[1, 0].live_started_at) == ("live", 200)
    assert (got[2, 0].state, got[2, 0].live_started_at, got[2, 0].ended_at) == ("ended", 50, 60)
    assert (got[3, 0].started_by, got[3, 0].discarded_warmup_frames) == ("button", 35)
    assert got[4, 0].state == "warmup" and got[5, 1].state == "warmup" and got[5, 0].state == "live"


def test_live_spans_end_where_the_next_begins(spark):
    rows = [(1, 100, "start"), (1, 200, "start"), (2, 50, "auto"), (2, 60, "start"), (2, 90, "end"), (2, 95, "start"), (3, 5, "end"), (4, 1, "start"), (4, 9, "reset"), (4, 20, "start"), (5, 7, "auto"), (5, 7, "start")]
    spans = lifecycle.live_spans(spark.createDataFrame(rows, "match_id bigint, frame bigint, action string"))
    assert sorted(((r.match_id, r.live_from, r.live_to) for r in spans.collect()), key=str) == [(1, 100, 200), (1, 200, None), (2, 50, 60), (2, 60, 90), (4, 1, 9), (4, 20, None), (5, 7, None)]


def player_rows(spark, positions):
    rows = [(1, i, 1, float(i), 0.0, 0.0, 10.0, 20.0, x, y) for i, (x, y) in enumerate(positions)]
    return spark.createDataFrame(rows, "match_id bigint, frame bigint, slot int, t_sec double, x1 double, y1 double, x2 double, y2 double, court_x double, court_y double")


def test_distance_ignores_jumps(spark):
    assert stats.batch_stats(player_rows(spark, [(0.0, 0.0), (3.0, 3.0)])).first().distance_m == 4.2
    assert stats.batch_stats(player_rows(spark, [(0.0, 0.0), (0.0, 10.0)])).first().distance_m == 0.0
    assert stats.batch_stats(player_rows(spark, [(0.0, 0.0), (None, None), (3.0, 0.0)])).first().distance_m == 3.0


def test_team_lock_equals_recurrence(spark):
    rnd = random.Random(2)
    ys = [rnd.uniform(0, 20) for _ in range(260)]
    mean = ys[0]
    for y in ys[1:240]:
        mean += 0.02 * (y - mean)
    got = stats.team_locks(player_rows(spark, [(1.0, y) for y in ys])).first()
    assert (got.lock_frame, got.team) == (239, int(mean >= 10)) and got.mean_y == pytest.approx(mean)


@pytest.mark.parametrize("n", [59, 60, 61, 95, 131])
def test_position_buffer_equals_list(spark, n):
    kept = []
    for i in range(n):
        kept.append(i)
        if len(kept) > 60:
            del kept[:10]
    df = player_rows(spark, [(1.0, 1.0)] * n).withColumn("outside_court", F.lit(False))
    assert [r[0] for r in pairs(stats.position_buffer(df, 60, 10, span=16), "frame")] == kept


def test_zones(spark):
    df = spark.createDataFrame([(5.0, 10.0), (15.0, 10.0), (-0.3, -0.3), (-1.0, -1.0), (5.0, 8.0), (None, None)], "x double, y double")
    got = df.select(G.in_play("x", "y").alias("p"), G.court_half("x", "y").alias("h"), G.near_net("y").alias("n"), G.in_service_box("y", F.lit(0)).alias("s")).collect()
    assert [r.p for r in got] == [True, False, True, False, True, False]
    assert [r.h for r in got] == [1, 1, 0, 0, 0, None]
    assert [r.s for r in got] == [True, True, False, False, True, False]
