"""Streaming queries: the feed is replayed from files in several micro-batches; batch SQL is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtspark.plans import domain as D
from courtspark.plans.match import COUNTED, LIVE_CTES, LOCK, REPORT_CTES, STATES, TEAM_FRAMES
from courtspark.session import fresh_dir
from courtspark.streaming import live
from courtspark.streaming.identity import OnlineIdentity

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def feed(spark, sf_dir):
    return live.frame_stream(spark, D.feed_files(spark, sf_dir), files_per_trigger=12)


def live_events(spark, sf_dir):
    job = live.LiveMatches(spark, min_frames=TEAM_FRAMES)
    job.run(feed(spark, sf_dir), fresh_dir(spark, "live-checkpoint")).awaitTermination()
    job.finish()
    return job.events()


@query(D.with_sql(*REPORT_CTES, recursive=True) + " SELECT match_id, start_frame, end_frame, shots_in_rally, last_hitter, winner_team FROM ends")
def stream_rallies(spark, sf_dir):
    """L4 within the live path."""
    e = live_events(spark, sf_dir).filter("kind = 'rally_end'")
    return e.select("match_id", "start_frame", F.col("frame").alias("end_frame"), F.col("shots").alias("shots_in_rally"), F.col("slot").alias("last_hitter"), F.col("team").alias("winner_team"))


# the feed carries one time per frame
FRAME_TIME = "\ncp AS (SELECT lp.* REPLACE (fr.t_sec AS t_sec) FROM lp JOIN fr USING (match_id, frame) WHERE NOT outside_court)"


@query(D.with_sql(*[FRAME_TIME if c == COUNTED else c for c in LIVE_CTES], recursive=True) + " SELECT match_id, slot, team, frames_seen, time_on_court, distance_m, shots, x1, court_x FROM sl")
def stream_stats(spark, sf_dir):
    """L5 within the live path: the last snapshot of each slot."""
    e = live_events(spark, sf_dir).filter("kind = 'slot'")
    cols = ["team", "frames_seen", "time_on_court", "distance_m", "shots", "x1", "court_x"]
    last = e.groupBy("match_id", "slot").agg(F.max_by(F.struct(*cols), "frame").alias("_r"))
    return last.select("match_id", "slot", "_r.*")


@query(D.with_sql(D.PF, LOCK) + " SELECT match_id, slot, lock_frame, CASE WHEN mean_y < 10 THEN 0 ELSE 1 END AS team FROM lk")
def stream_team_lock(spark, sf_dir):
    """L6 within the live path."""
    e = live_events(spark, sf_dir).filter("kind = 'team_lock'")
    return e.select("match_id", "slot", F.col("frame").alias("lock_frame"), "team")


@query(D.with_sql(D.PF, D.LIFECYCLE, STATES, recursive=True) + " SELECT match_id, state, started_by, live_started_at, ended_at FROM ep WHERE epoch = (SELECT max(epoch) FROM ep x WHERE x.match_id = ep.match_id)")
def stream_lifecycle(spark, sf_dir):
    """L1 within the live path: the state after the last command."""
    e = live_events(spark, sf_dir).filter("kind = 'lifecycle'")
    last = e.groupBy("match_id").agg(F.max_by(F.struct("state", "started_by", "live_started_at", "ended_at"), "frame").alias("_r"))
    return last.select("match_id", "_r.*")


@query(D.with_sql(D.PF) + " SELECT match_id, max(frame) AS frame, CAST(4 AS INT) AS players FROM pf GROUP BY match_id")
def stream_latest(spark, sf_dir):
    """The newest frame of each match over all triggers."""
    out = fresh_dir(spark, "latest")
    live.run_latest(feed(spark, sf_dir), out, fresh_dir(spark, "latest-checkpoint")).awaitTermination()
    rows = spark.read.parquet(out)
    return live.latest_frames(rows).select("match_id", "frame", F.size("players").alias("players"))


@query(D.with_sql(D.PF, D.FRAMES) + " SELECT match_id, frame, ball_x, 4 AS n FROM fr")
def stream_results(spark, sf_dir):
    """The feed written again as JSON lines, exactly once."""
    out = fresh_dir(spark, "results")
    rows = feed(spark, sf_dir).select("match_id", "frame", "ball_x", F.size("players").alias("n"))
    live.write_results(rows, out, fresh_dir(spark, "results-checkpoint")).awaitTermination()
    return spark.read.schema("match_id BIGINT, frame BIGINT, ball_x DOUBLE, n INT").json(out)


@query(D.with_sql(D.PF) + " SELECT match_id, frame, raw_id, x1, y1, x2, y2, CAST(raw_id // 1000 AS INT) AS slot FROM pf")
def stream_identity(spark, sf_dir):
    """Players of the feed with a vector each; the start command freezes the identities.

    Tracker ids change every forty frames; the SQL states the player each one was made from, whom clusters and newcomers must meet.
    """
    p = feed(spark, sf_dir).select("match_id", "frame", F.array_contains("actions", "start").alias("started"), F.explode("players").alias("p"))
    look = F.expr("transform(sequence(1, 16), i -> cos(p.slot * i * 1D) + p.court_x * 0.001D)")
    rows = p.select("match_id", "frame", "p.raw_id", "p.x1", "p.y1", "p.x2", "p.y2", look.alias("embedding"), "started")
    job = OnlineIdentity(spark, 1280.0, 720.0)
    job.run(rows, fresh_dir(spark, "identity-checkpoint")).awaitTermination()
    return spark.read.parquet(f"{job.folder}/out").drop("embedding", "batch")
