"""Structured Streaming jobs over frame records."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtspark import schemas
from courtspark.blocks import Lane, Prev, RowNumber, scan
from courtspark.operators import lifecycle, rallies, stats
from courtspark.session import fresh_dir


def frame_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16, schema: str = schemas.FRAME_RECORD) -> DataFrame:
    """Frame records as they arrive; ``files_per_trigger`` is the back-pressure bound of a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


#: Tables kept between micro-batches. Each is small for a match, however long it lasts.
STATE = {
    "clock": "match_id BIGINT, newest BIGINT, taken BIGINT, was BIGINT, touched BIGINT",
    "records": schemas.FRAME_RECORD + ", taken BIGINT",
    "commands": "match_id BIGINT, frame BIGINT, action STRING, since BIGINT",
    "serves": "match_id BIGINT, frames BIGINT, last_seen BIGINT",
    "locks": "match_id BIGINT, slot INT, n BIGINT, mean_y DOUBLE, lock_frame BIGINT, team INT, since BIGINT",
    "tail": "match_id BIGINT, live_from BIGINT, frame BIGINT, seen BOOLEAN",
    "open": "match_id BIGINT, live_from BIGINT, start_frame BIGINT, shots BIGINT, slot INT",
    "strokes": "match_id BIGINT, live_from BIGINT, slot INT, frame BIGINT",
    "slots": (
        "match_id BIGINT, live_from BIGINT, slot INT, frame BIGINT, t_sec DOUBLE, frames_seen BIGINT, time_on_court DOUBLE, distance_m DOUBLE, shots BIGINT, "
        "team INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, court_x DOUBLE, court_y DOUBLE"
    ),
}
EVENTS = (
    "match_id BIGINT, kind STRING, frame BIGINT, live_from BIGINT, start_frame BIGINT, slot INT, shot_type STRING, shots BIGINT, team INT, frames_seen BIGINT, "
    "time_on_court DOUBLE, distance_m DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, court_x DOUBLE, court_y DOUBLE, state STRING, started_by STRING, "
    "live_started_at BIGINT, ended_at BIGINT"
)
#: Stands for the end of what is still going on.
NEVER = 1 << 62


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty."""
    return spark.range(1).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in T.StructType.fromDDL(schema)]).limit(0)


def together(spark: SparkSession, *steps: Callable) -> list:
    """What ``steps`` return, run side by side: none needs what another one makes, and a small job leaves most cores idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


class LiveMatches:
    """The live path of all matches, by micro-batch, in the order of the frames.

    Records may arrive in any order. A match's watermark follows its newest frame at ``delay`` frames' distance; records
    wait until it has passed them and are then taken in frame order, so what comes out doesn't depend on the order of
    arrival. Of records of the same frame the first to arrive counts. A record that comes after its frame was passed
    can't be taken any more; it is told as an event of kind ``late``. ``finish`` takes what is still waiting.

    The records taken go through the batch operators, together with a few rows that stand for what came before: the
    last frames and the open rally, each slot's last stroke, last position and totals, the means of unlocked slots.
    These are tables under ``folder``. Batch n reads version n - 1 and writes version n, so a batch that is tried again
    gives the same; three versions are kept. Matches not heard of for ``idle_batches`` batches leave the tables.

    Events go to ``<folder>/out/batch=N``: shots that count, starts and ends of rallies, team locks, lifecycle states
    after new commands, and the totals of the four slots of each match of the batch. ``live_from`` tells since which
    start they count.
    """

    def __init__(
        self, spark: SparkSession, delay: int = 300, min_frames: int = 240, detect_serve: bool = False, window: int = 10, minimum: int = 3, miss: int = 12, cooldown: int = 8,
        stillness: int = 20, history: int = 22, max_slots: int = 4, net_y: float = 10.0, alpha: float = 0.02, idle_batches: int | None = None, folder: str | None = None,
    ):
        self.spark, self.delay, self.folder, self.idle_batches = spark, delay, folder or fresh_dir(spark, "live"), idle_batches
        self.min_frames, self.net_y, self.alpha, self.max_slots = min_frames, net_y, alpha, max_slots
        self.window, self.minimum, self.miss, self.cooldown = window, minimum, miss, cooldown
        self.detect_serve, self.stillness, self.history = detect_serve, stillness, history
        self.done = -1

    def _read(self, name: str, batch: int) -> DataFrame:
        if batch < 0:
            return no_rows(self.spark, STATE[name])
        return self.spark.read.schema(STATE[name]).parquet(f"{self.folder}/state/{batch % 3}/{name}")

    def _save(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        columns = T.StructType.fromDDL(STATE[name])
        df.select(*[F.col(c.name).cast(c.dataType) for c in columns]).write.mode("overwrite").parquet(f"{self.folder}/state/{batch % 3}/{name}")
        return self._read(name, batch)

    def _part(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """A table of this batch alone that several steps read."""
        path = f"{self.folder}/work/{batch % 3}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def process(self, records: DataFrame, batch: int, flush: bool = False) -> DataFrame:
        """Events of a micro-batch of frame records; ``flush`` takes all records that wait."""
        old = {name: self._read(name, batch - 1) for name in STATE if name != "serves" or self.detect_serve}
        records, clock = self._taken(records, old, batch, flush)
        ready = records.filter("frame <= taken").drop("taken")
        here = clock.filter(F.col("touched") == batch).select("match_id", F.col("was").alias("_was"))
        frames = ready.select("match_id", "frame", F.col("ball_x").isNotNull().alias("seen"))

        def lives() -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
            commands, news = self._commands(ready, frames, old, here, batch)
            states = lifecycle.lifecycle_states(commands)
            last = states.groupBy("match_id").agg(F.max_by(F.struct("state", "started_by", "live_started_at", "ended_at"), "epoch").alias("_s")).select("match_id", "_s.*")
            state, spans = together(
                self.spark, lambda: self._part(here.join(last, "match_id", "left").na.fill("warmup", ["state"]), "state", batch), lambda: self._part(lifecycle.live_spans(commands), "spans", batch)
            )
            live = ready.join(spans.select("match_id", "live_from", "live_to"), "match_id").filter("frame >= live_from AND (live_to IS NULL OR frame < live_to)")
            return news, state, spans, self._part(live, "live", batch)

        (news, state, spans, live), (locks, locked) = together(self.spark, lives, lambda: self._locks(ready, old, batch))
        current = spans.groupBy("match_id").agg(F.max("live_from").alias("live_from"))

        def kept(df: DataFrame, name: str) -> DataFrame:
            """Old rows of matches without news, new ones of those with, as far as they belong to the match's last start."""
            new = df.join(current, ["match_id", "live_from"], "left_semi")
            return self._save(old[name].join(here, "match_id", "left_anti").unionByName(new.select(old[name].columns)), name, batch)

        locks = locks.filter("lock_frame IS NOT NULL")
        people = live.select("match_id", "live_from", "frame", "t_sec", F.explode("players").alias("_p")).select("match_id", "live_from", "frame", "t_sec", "_p.*")
        people = stats.attach_teams(people, locks)
        shots = live.select("match_id", "live_from", "frame", F.col("players.slot").alias("_there"), F.posexplode("shots").alias("ord", "_s"))
        shots = shots.select("match_id", "live_from", "frame", "ord", "_s.slot", "_s.shot_type", F.array_contains("_there", F.col("_s.slot")).alias("_seen"))

        (ends, starts, accepted), slots = together(
            self.spark, lambda: self._rallies(live, locks, shots, spans, old, here, kept, batch), lambda: self._slots(people, shots, old, here, current, kept)
        )
        events = [
            locked.select("match_id", F.lit("team_lock").alias("kind"), F.col("lock_frame").alias("frame"), "slot", "team"),
            news.groupBy("match_id").agg(F.max("frame").alias("frame")).join(state, "match_id")
            .select("match_id", F.lit("lifecycle").alias("kind"), "frame", "state", "started_by", "live_started_at", "ended_at"),
            starts.select("match_id", F.lit("rally_start").alias("kind"), F.col("start_frame").alias("frame"), "live_from", "start_frame"),
            ends.select("match_id", F.lit("rally_end").alias("kind"), F.col("end_frame").alias("frame"), "live_from", "start_frame", "slot", "shots", "team"),
            self._teams(accepted, locks).select("match_id", F.lit("shot").alias("kind"), "frame", "live_from", "slot", "shot_type", "team"),
            self._totals(slots, state, clock, batch),
            records.filter("taken IS NULL").select("match_id", F.lit("late").alias("kind"), "frame"),
        ]
        empty = no_rows(self.spark, EVENTS)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events, empty).select(empty.columns)

    def _taken(self, records: DataFrame, old: dict, batch: int, flush: bool) -> tuple[DataFrame, DataFrame]:
        """Records up to the watermark (``taken``; null: the record came too late) and waiting ones, and the matches' clocks."""
        names = ["match_id", "frame", "t_sec", "ball_x", "ball_y", "players", "shots", "actions"]
        known = records.filter("match_id IS NOT NULL AND frame IS NOT NULL").select(*names)
        before = old["clock"].select("match_id", F.col("newest").alias("_newest"), F.col("taken").alias("_was"), F.col("touched").alias("_touched"))
        new = known.groupBy("match_id").agg(F.max("frame").alias("_new"))
        clock = before.join(new, "match_id", "full").withColumn("newest", F.greatest("_newest", "_new")).withColumn("was", F.coalesce("_was", F.lit(-1)))
        mark = F.col("newest") if flush else F.col("newest") - self.delay
        heard = F.lit(True) if flush else F.col("_new").isNotNull()
        clock = clock.withColumn("taken", F.greatest("was", mark)).withColumn("touched", F.when(heard, F.lit(batch)).otherwise(F.col("_touched")))
        if self.idle_batches is not None:
            clock = clock.filter(F.col("touched") >= batch - self.idle_batches)
        clock = self._save(clock, "clock", batch)

        waiting = old["records"].filter("frame > taken").select(F.lit(0).alias("_turn"), *names).unionByName(known.select(F.lit(1).alias("_turn"), *names))
        waiting = waiting.join(clock.select("match_id", "taken", "was"), "match_id")
        rest = names[2:]
        # dealt out first: hardly a frame has two records, so there is nothing to combine before
        once = waiting.repartition("match_id", "frame").groupBy("match_id", "frame").agg(F.min(F.struct("_turn", *rest)).alias("_r"), F.first("taken").alias("taken"), F.first("was").alias("_was"))
        # records that came too late stay as frames before the mark they missed: nothing but their frame is needed
        told = F.when(F.col("frame") > F.col("_was"), F.col("taken"))
        once = self._save(once.select("match_id", "frame", *[F.col(f"_r.{c}").alias(c) for c in rest], told.alias("taken")), "records", batch)
        return once, clock

    def _commands(self, ready: DataFrame, frames: DataFrame, old: dict, here: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """All commands of the matches of the batch, and those that are new."""
        news = ready.select("match_id", "frame", F.explode("actions").alias("action"))
        if self.detect_serve:
            lane = Lane(("match_id",), "frame")
            numbered = scan(frames, lane, _pos=RowNumber()).join(old["serves"], "match_id", "left").na.fill(0, ["frames", "last_seen"]).withColumn("pos", F.col("_pos") + F.col("frames"))
            back = scan(numbered.filter("seen"), lane, _prev=Prev(F.col("pos")))
            still = F.col("pos") - F.coalesce("_prev", "last_seen") - 1
            hits = back.filter((F.col("pos") >= self.history) & (still >= self.stillness)).select("match_id", "frame", F.lit("auto").alias("action"))
            counted = numbered.groupBy("match_id").agg(F.max("pos").alias("frames"), F.coalesce(F.max(F.when(F.col("seen"), F.col("pos"))), F.max("last_seen")).alias("last_seen"))
            self._save(old["serves"].join(counted, "match_id", "left_anti").unionByName(counted), "serves", batch)
            news = news.unionByName(hits)
        clock = self._read("clock", batch).select("match_id")
        news = news.distinct().withColumn("since", F.lit(batch).cast("bigint"))
        kept = self._save(old["commands"].join(clock, "match_id", "left_semi").unionByName(news), "commands", batch)
        return kept.join(here, "match_id", "left_semi"), kept.filter(F.col("since") == batch)

    def _locks(self, ready: DataFrame, old: dict, batch: int) -> tuple[DataFrame, DataFrame]:
        """Means of the slots' positions carried on until they lock; all locks, and those of this batch."""
        p = ready.select("match_id", "frame", F.explode("players").alias("_p")).select("match_id", "frame", "_p.slot", "_p.court_x", "_p.court_y")
        order = Window.partitionBy("match_id", "slot").orderBy("frame")
        p = p.join(old["locks"].filter(F.col("n") >= self.min_frames).select("match_id", "slot"), ["match_id", "slot"], "left_anti")  # a locked slot stays as it is
        first = p.filter("court_x IS NOT NULL AND court_y IS NOT NULL").withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= self.min_frames)
        before = old["locks"].select("match_id", "slot", F.col("n").alias("_n"), F.col("mean_y").alias("_mean"))
        first = first.join(before, ["match_id", "slot"], "left").na.fill(0, ["_n"]).withColumn("_at", F.col("_n") + F.col("_i")).filter(F.col("_at") <= self.min_frames)
        keep = 1 - self.alpha
        left = F.pow(F.lit(keep), (F.lit(self.min_frames) - F.col("_at")).cast("double"))
        g = first.groupBy("match_id", "slot").agg(
            F.max("_at").alias("n"), F.first("_n").alias("_n"), F.first("_mean").alias("_mean"), F.max("frame").alias("_frame"),
            F.sum(F.col("court_y") * F.when(F.col("_at") == 1, left).otherwise(left * self.alpha)).alias("_sum"),
        )
        part = F.col("_sum") / F.pow(F.lit(keep), (F.lit(self.min_frames) - F.col("n")).cast("double"))
        mean = part + F.coalesce(F.col("_mean") * F.pow(F.lit(keep), (F.col("n") - F.col("_n")).cast("double")), F.lit(0.0))
        full = F.col("n") == self.min_frames
        new = g.withColumn("mean_y", mean).select(
            "match_id", "slot", "n", "mean_y", F.when(full, F.col("_frame")).alias("lock_frame"), F.when(full, F.when(F.col("mean_y") < self.net_y, 0).otherwise(1)).alias("team")
        )
        new = new.withColumn("since", F.lit(batch).cast("bigint"))
        stay = old["locks"].join(new, ["match_id", "slot"], "left_anti").join(self._read("clock", batch).select("match_id"), "match_id", "left_semi")
        locks = self._save(stay.unionByName(new), "locks", batch)
        return locks, locks.filter(F.col("lock_frame").isNotNull() & (F.col("since") == batch))

    def _teams(self, rows: DataFrame, locks: DataFrame) -> DataFrame:
        """Rows with the team of their slot in their frame, if the slot has a player there (``_seen``)."""
        return stats.attach_teams(rows, locks).withColumn("team", F.when(F.col("_seen"), F.col("team")))

    def _rallies(self, live, locks, shots, spans, old, here, kept, batch) -> tuple[DataFrame, DataFrame, DataFrame]:
        """L4: (rallies that ended, rallies that began, shots that count)."""
        keys = ("match_id", "live_from")
        mine = lambda name: old[name].join(here, "match_id", "left_semi")

        def stretches() -> tuple[DataFrame, DataFrame]:
            new_frames = live.select(*keys, "frame", F.col("ball_x").isNotNull().alias("seen"))
            frames = self._part(mine("tail").unionByName(new_frames), "frames", batch)
            found = rallies.islands(frames, self.window, self.minimum, self.miss, keys=keys).join(here, "match_id").filter("end_frame IS NULL OR end_frame > _was")
            carried = mine("open").select(*keys, F.col("start_frame").alias("_start"), F.col("shots").alias("_shots"), F.col("slot").alias("_slot"))
            found = found.join(carried, list(keys), "left")
            going_on = (F.col("seen_frame") <= F.col("_was")) & F.col("_start").isNotNull()
            for name in ("_start", "_shots", "_slot"):
                found = found.withColumn(name, F.when(going_on, F.col(name)))
            found = found.withColumn("start_frame", F.coalesce("_start", "start_frame")).filter("start_frame IS NOT NULL")
            found = found.join(spans.select(*keys, "live_to"), list(keys), "left").withColumn("_until", F.coalesce("end_frame", F.col("live_to") - 1, F.lit(NEVER)))
            return frames, self._part(found, "rallies", batch)

        def counting() -> DataFrame:
            none = F.lit(None)
            before = mine("strokes").select(*keys, "frame", F.lit(-1).alias("ord"), "slot", none.cast("string").alias("shot_type"), none.cast("boolean").alias("_seen"))
            accepted = rallies.accepted_shots(before.unionByName(shots), self.cooldown, keys=(*keys, "slot"))
            accepted = self._part(accepted, "accepted", batch)
            kept(accepted.groupBy(*keys, "slot").agg(F.max("frame").alias("frame")), "strokes")
            return accepted.filter("ord >= 0")

        def with_shots() -> DataFrame:
            inside = rallies.shots_in_rallies(accepted, found.select("match_id", "start_frame", F.col("_until").alias("end_frame")))
            hits = inside.groupBy("match_id", "start_frame").agg(F.count("*").alias("_hits"), F.max_by("slot", F.struct("frame", "ord")).alias("_last"))
            whole = found.join(hits, ["match_id", "start_frame"], "left")
            whole = whole.withColumn("shots", F.coalesce("_shots", F.lit(0)) + F.coalesce("_hits", F.lit(0))).withColumn("slot", F.coalesce("_last", "_slot"))
            whole = self._part(whole, "rallies-with-shots", batch)
            kept(whole.filter("end_frame IS NULL"), "open")
            return whole

        (frames, found), accepted = together(self.spark, stretches, counting)
        newest = Window.partitionBy(*keys).orderBy(F.desc("frame"))
        tail = frames.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") < self.window + self.miss)
        found, _ = together(self.spark, with_shots, lambda: kept(tail, "tail"))
        ends = found.filter("end_frame IS NOT NULL").withColumn("frame", F.col("end_frame"))
        there = live.select("match_id", "frame", F.col("players.slot").alias("_there")).join(ends.select("match_id", "frame"), ["match_id", "frame"], "left_semi")
        ends = ends.join(there, ["match_id", "frame"], "left").withColumn("_seen", F.array_contains("_there", F.col("slot")))
        return self._teams(ends, locks), found.filter("_start IS NULL"), accepted

    def _slots(self, people, shots, old, here, current, kept) -> DataFrame:
        """Totals carried on; a row with each slot's last time and position stands for what came before."""
        keys = ["match_id", "live_from", "slot"]
        before = old["slots"].join(here, "match_id", "left_semi").join(current, ["match_id", "live_from"], "left_semi")
        counted = people.filter(F.col("slot").between(1, self.max_slots) & ~F.coalesce("outside_court", F.lit(False)))
        columns = [*keys, "frame", "t_sec", "court_x", "court_y", "x1", "y1", "x2", "y2", "team"]
        marks = before.filter("frame IS NOT NULL").select(*columns, F.lit(True).alias("_old"))
        m = stats.movement(marks.unionByName(counted.select(*columns, F.lit(False).alias("_old"))), extra_keys=("live_from",)).filter("NOT _old")
        known = F.when(F.col("court_x").isNotNull() & F.col("court_y").isNotNull(), F.col("frame"))
        new = m.groupBy(*keys).agg(
            F.max("frame").alias("n_frame"), F.max_by("t_sec", "frame").alias("n_t_sec"), F.count("*").alias("n_frames_seen"), F.sum("elapsed_s").alias("n_time_on_court"),
            F.sum("moved_m").alias("n_distance_m"), F.max_by("team", F.when(F.col("team").isNotNull(), F.col("frame"))).alias("n_team"),
            *[F.max_by(c, "frame").alias(f"n_{c}") for c in ("x1", "y1", "x2", "y2")], *[F.max_by(c, known).alias(f"n_{c}") for c in ("court_x", "court_y")],
        )
        strokes = shots.filter(F.col("slot").between(1, self.max_slots)).groupBy(*keys).agg(F.count("*").alias("n_shots"))
        both = before.join(new, keys, "full").join(strokes, keys, "full")
        total = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))).alias(c)
        sums = ["frames_seen", "time_on_court", "distance_m", "shots"]
        latest = [F.coalesce(f"n_{c}", c).alias(c) for c in ("frame", "t_sec", "team", "x1", "y1", "x2", "y2", "court_x", "court_y")]
        return kept(both.select(*keys, *map(total, sums), *latest), "slots")

    def _totals(self, slots: DataFrame, state: DataFrame, clock: DataFrame, batch: int) -> DataFrame:
        """A row for each slot of each match of the batch, seen or not."""
        every = state.select("match_id", "state", F.explode(F.sequence(F.lit(1), F.lit(self.max_slots))).alias("slot"))
        every = every.join(clock.select("match_id", F.col("taken").alias("_now")), "match_id").filter("_now >= 0")
        out = every.join(slots, ["match_id", "slot"], "left")
        zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
        return out.select(
            "match_id", F.lit("slot").alias("kind"), F.col("_now").alias("frame"), "live_from", "slot", "state", "team", zero("frames_seen", 0), zero("shots", 0),
            F.bround(F.coalesce("time_on_court", F.lit(0.0)), 1).alias("time_on_court"), F.bround(F.coalesce("distance_m", F.lit(0.0)), 1).alias("distance_m"),
            "x1", "y1", "x2", "y2", "court_x", "court_y",
        )

    def step(self, records: DataFrame, batch: int, flush: bool = False) -> None:
        records.persist()  # read for the clocks and for the records; lost parts are read from the source again
        self.process(records, batch, flush).write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch}")
        records.unpersist()
        self.done = batch

    def run(self, stream: DataFrame, checkpoint: str):
        """The live path as a streaming job over what is there now."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def finish(self) -> None:
        """Takes the records that still wait, at the end of a stream."""
        self.step(no_rows(self.spark, schemas.FRAME_RECORD), self.done + 1, flush=True)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/out")


def latest_frames(batch: DataFrame) -> DataFrame:
    """The newest frame of each match in a micro-batch; older ones are skipped, as a live viewer does."""
    rest = [c for c in batch.columns if c != "match_id"]
    return batch.groupBy("match_id").agg(F.max_by(F.struct(*rest), F.col("frame")).alias("_r")).select("match_id", "_r.*")


def run_latest(stream: DataFrame, out: str, checkpoint: str):
    """L7 as a job: each trigger writes its newest frames under its batch number, so a retried batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_frames(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_results(stream: DataFrame, out: str, checkpoint: str):
    """K1: append result lines as JSON files, exactly once."""
    return stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
