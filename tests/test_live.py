"""The live path over feeds whose files come out of order, late or twice."""

import os
import random
import threading

import pytest
from test_match_rules import plain_rallies

from courtspark import schemas
from courtspark.session import fresh_dir
from courtspark.streaming import live

FRAMES, START, AGAIN = 400, 20, 150


def feed(match, seed, actions):
    """Records of a match with four players; player 1 hits often, so the cooldown matters."""
    rnd, out, x = random.Random(seed), [], [5.0] * 4
    for f in range(FRAMES):
        seen = rnd.random() < (0.6 if (f // 40) % 2 else 0.03)
        players = []
        for slot in range(1, 5):
            if rnd.random() < 0.9:
                x[slot - 1] += rnd.uniform(-1, 1)
                known = rnd.random() < 0.9
                players.append((slot, 10 + slot, 1.0 * f, 2.0, 3.0, 4.0, x[slot - 1] if known else None, 3.0 + 4 * slot if known else None, rnd.random() < 0.1))
        shots = [(slot, rnd.choice(["drive", "lob"])) for slot in (1, 1, 2, 3) if rnd.random() < 0.3]
        out.append((match, f, f / 30, 1.0 if seen else None, 1.0 if seen else None, players, shots, actions.get(f)))
    return out


def told(spark, batches, **more):
    """(events but for totals, last totals of each slot) of the batches, one after the other."""
    job = live.LiveMatches(spark, min_frames=60, **more)
    for n, rows in enumerate(batches):
        job.step(spark.createDataFrame(rows, schemas.FRAME_RECORD), n, flush=n == len(batches) - 1)
    rows = [r.asDict() for r in job.events().drop("batch").collect()]
    # a batch tells the state after its last command, so only the last one of a match is the same for all batches
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    last = {(r["match_id"], r["slot"]): tuple(r.items()) for r in sorted(of("slot"), key=lambda r: r["frame"])}
    state = {r["match_id"]: tuple(r.items()) for r in sorted(of("lifecycle"), key=lambda r: r["frame"])}
    rest = sorted((tuple(r.items()) for r in rows if r["kind"] not in ("slot", "lifecycle")), key=repr)
    return rest, last, state


@pytest.fixture(scope="module")
def records():
    return feed(1, 1, {START: ["start"]}) + feed(2, 2, {START: ["start"], AGAIN: ["start"], 390: ["end"]}) + feed(3, 3, {})


@pytest.fixture(scope="module")
def whole(spark, records):
    return told(spark, [records])


def test_order_of_arrival_and_repeated_records_do_not_matter(spark, records, whole):
    rnd = random.Random(4)
    early = [r for r in records if r[1] < 134 or 150 <= r[1] < 201]
    parts = [early, [r for r in records if r not in early and r[1] < 268], [r for r in records if r[1] >= 268]]
    for p in parts:
        rnd.shuffle(p)
    again = told(spark, [parts[0], parts[1] + parts[0][:9], parts[2] + parts[1][:9]], delay=70)
    late = [r for r in again[0] if dict(r)["kind"] == "late"]
    assert {dict(r)["frame"] for r in late} <= {r[1] for r in parts[0][:9] + parts[1][:9]}  # repeated after they were taken
    assert ([r for r in again[0] if r not in late], *again[1:]) == whole


def test_events_equal_plain_versions(records, whole):
    events = [dict(r) for r in whole[0]]
    lives = {(1, START): (START, FRAMES), (2, START): (START, AGAIN), (2, AGAIN): (AGAIN, 390)}
    for (match, since), (low, high) in lives.items():
        own = [r for r in records if r[0] == match and low <= r[1] < high]
        ends = [(e["start_frame"], e["frame"]) for e in events if e["kind"] == "rally_end" and (e["match_id"], e["live_from"]) == (match, since)]
        assert sorted(ends) == plain_rallies([(r[1], r[3] is not None) for r in own]) and (ends or high - low < 200)
        free, accepted = {}, []
        for r in own:
            for slot, kind in r[6]:
                if r[1] >= free.get(slot, 0):
                    free[slot] = r[1] + 8
                    accepted.append((r[1], slot, kind))
        assert sorted((e["frame"], e["slot"], e["shot_type"]) for e in events if e["kind"] == "shot" and (e["match_id"], e["live_from"]) == (match, since)) == sorted(accepted)
        for e in (e for e in events if e["kind"] == "rally_end" and (e["match_id"], e["live_from"]) == (match, since)):
            hits = [(f, s) for f, s, _ in accepted if e["start_frame"] < f <= e["frame"]]
            assert e["shots"] == len(hits) and (e["slot"] in {s for f, s in hits if f == hits[-1][0]} if hits else e["slot"] is None)
    assert not any(e["match_id"] == 3 and e["kind"] in ("shot", "rally_end") for e in events)
    for (match, slot), row in whole[1].items():
        row, low, high = dict(row), {1: START, 2: AGAIN, 3: FRAMES}[match], {2: 390}.get(match, FRAMES)
        seen = [p for r in records if r[0] == match and low <= r[1] < high for p in r[5] if p[0] == slot and not p[8]]
        at = [p[6:8] for p in seen if p[6] is not None]
        assert row["frames_seen"] == len(seen) and (row["court_x"] == at[-1][0] if at else row["court_x"] is None)
        assert row["distance_m"] == pytest.approx(sum(abs(a[0] - b[0]) for a, b in zip(at, at[1:], strict=False)), abs=0.06)
        assert row["shots"] == sum(s == slot for r in records if r[0] == match and low <= r[1] < high for s, _ in r[6])
    assert {dict(r)["state"] for r in whole[2].values()} == {"live", "ended"}


def test_a_stream_restarts_where_it_stopped(spark, records, whole):
    rows = [r for r in records if r[0] == 1 and r[1] < 120]
    folder, source, checkpoint = fresh_dir(spark, "live"), fresh_dir(spark, "feed"), fresh_dir(spark, "checkpoint")
    for k in range(2):
        part = [r for r in rows if r[1] // 60 == k]
        spark.createDataFrame(part, schemas.FRAME_RECORD).coalesce(1).write.mode("append").json(source)
        job = live.LiveMatches(spark, delay=10, min_frames=60, folder=folder)  # a new process
        job.run(live.frame_stream(spark, source), checkpoint).awaitTermination()
    job.step(spark.createDataFrame(part, schemas.FRAME_RECORD), job.done, flush=True)  # the last batch tried again
    got = {(e.kind, e.frame, e.slot, e.start_frame) for e in job.events().filter("kind NOT IN ('slot', 'lifecycle')").collect()}
    events = [e for e in map(dict, whole[0]) if e["match_id"] == 1 and e["frame"] < 120]
    assert got == {(e["kind"], e["frame"], e["slot"], e["start_frame"]) for e in events} and got


def test_serves_start_a_match_by_themselves(spark):
    rows = [(1, f, f / 30, 1.0 if f in (3, 40, 41, 42) else None, None, [], [], None) for f in range(60)]
    parts = [rows[:30], rows[30:]]
    rest, _, state = told(spark, parts, detect_serve=True, delay=0)
    assert dict(state[1])["live_started_at"] == 40 and dict(state[1])["started_by"] == "auto"
    assert [dict(r)["frame"] for r in rest if dict(r)["kind"] == "rally_start"] == [42]


def test_rows_without_keys(spark):
    assert told(spark, [[(None, 1, 0.0, None, None, [], [], None), (1, None, 0.0, None, None, None, None, None)]]) == ([], {}, {})


def test_steps_that_need_nothing_of_each_other_run_side_by_side(spark):
    meet = threading.Barrier(2, timeout=60)
    assert live.together(spark, lambda: meet.wait() >= 0 and spark.range(3).count(), lambda: meet.wait() >= 0 and spark.range(4).count()) == [3, 4]
    with pytest.raises(ZeroDivisionError):
        live.together(spark, lambda: 1, lambda: 1 / 0)


def test_players_are_read_where_they_are_needed(spark, records):
    """Teams of shots and rallies come from the record of their frame: no table of all players is written or grouped for them."""
    job = live.LiveMatches(spark, min_frames=60)
    events = job.process(spark.createDataFrame(records[:120], schemas.FRAME_RECORD), 0, flush=True)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "people" not in os.listdir(f"{job.folder}/work/0") and "first(team" not in plan and "explode(players" not in plan
    rows = events.filter("kind = 'shot'").collect()
    teams = {(r[1], p[0]): int(p[7] >= 10) for r in records[:120] for p in r[5] if p[7] is not None}
    assert any(r.team is not None for r in rows) and all(r.team in (None, {p: t for (_, p), t in teams.items()}[r.slot]) for r in rows)
    there = {(r[1], p[0]) for r in records[:120] for p in r[5]}
    assert all(r.team is None for r in rows if (r.frame, r.slot) not in there) and any((r.frame, r.slot) not in there for r in rows)


def test_locked_slots_are_not_averaged_again(spark, records):
    job, plans = live.LiveMatches(spark, min_frames=20, delay=0), []
    job.step(spark.createDataFrame(records[:60], schemas.FRAME_RECORD), 0)
    before, save = job._read("locks", 0), job._save
    job._save = lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df, *a)
    save(job._read("clock", 0), "clock", 1)
    locks, new = job._locks(spark.createDataFrame(records[60:90], schemas.FRAME_RECORD), {"locks": before}, 1)
    assert plans[0].split("Window")[-1].count("LeftAnti") == 1  # below the window
    assert {r.n for r in before.collect()} == {20} and sorted(locks.collect()) == sorted(before.collect()) and not new.count()


def test_a_table_without_rows_is_known_to_be_empty(spark):
    plan = live.no_rows(spark, live.EVENTS)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and live.no_rows(spark, live.EVENTS).schema == spark.createDataFrame([], live.EVENTS).schema
