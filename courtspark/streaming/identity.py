"""Online re-identification by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.operators import identity
from courtspark.session import fresh_dir

CLOCK = "match_id BIGINT, first_batch BIGINT, clustered_at BIGINT, locked BOOLEAN"
MAPPING = "match_id BIGINT, raw_id BIGINT, slot INT"
ROWS = "match_id BIGINT, frame BIGINT, raw_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, embedding ARRAY<DOUBLE>, started BOOLEAN"
PARTS = "match_id BIGINT, raw_id BIGINT, frame_min BIGINT, frame_max BIGINT, samples BIGINT, last_kept BIGINT, n_fx BIGINT, sum_fx DOUBLE, n_fy BIGINT, sum_fy DOUBLE"
SUMS = "match_id BIGINT, raw_id BIGINT, dim INT, total DOUBLE, n BIGINT"
POSITIONS = "match_id BIGINT, slot INT, frame BIGINT, raw_id BIGINT, pos_x DOUBLE, pos_y DOUBLE"
TRACKLETS = "match_id BIGINT, track_id BIGINT, frame_min BIGINT, frame_max BIGINT, mean_fx DOUBLE, mean_fy DOUBLE, embedding ARRAY<DOUBLE>"
DUE = "match_id BIGINT, now BIGINT, starting BOOLEAN, first_batch BIGINT, clustered_at BIGINT, locked BOOLEAN, mapped BOOLEAN, due BOOLEAN"
KEYS = ["match_id", "raw_id"]


class OnlineIdentity:
    """Clusters each match again during warmup, freezes at its start, then gives newcomers the nearest slot.

    State is in tables under ``folder``, versioned by batch number, so a retried batch reads what its first attempt read.
    Nothing per match reaches the driver. A batch reads its own rows and, of what came before:

    * of matches in warmup: parts of their tracklets (frame range, sampled boxes, sums of vectors), merged with the new rows;
    * of frozen matches: the last smoothed position of each slot;
    * raw id to slot;
    * in the one batch that freezes a match: its warmup rows, which move the slot positions in their order. Rows of frozen
      matches are written apart (``warm=false``) and never read again.

    A match's frames must come in order (``live.LiveMatches`` sorts them); an older one still counts for its tracklet's range
    and vector, is not sampled, and moves its slot like the newest.
    """

    def __init__(self, spark: SparkSession, width: float, height: float, k: int = 4, every: int = 600, dim: int = 16, folder: str | None = None):
        self.spark, self.width, self.height, self.k, self.every, self.dim = spark, width, height, k, every, dim
        self.folder = folder or fresh_dir(spark, "online-identity")

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _read(self, table: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, batch))

    def _save(self, df: DataFrame, table: str, batch: int, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch))
        return self._read(table, batch, schema)

    def _take(self, batch: DataFrame, clock: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a batch, stored apart for matches in warmup and frozen ones."""
        frozen = clock.filter("locked").select("match_id", F.lit(False).alias("warm"))
        rows = batch.select([c.split()[0] for c in ROWS.split(", ")]).join(frozen, "match_id", "left").na.fill(True, ["warm"])
        rows.write.mode("overwrite").partitionBy("warm").parquet(self._path("rows", batch_id))
        return self._read("rows", batch_id, f"{ROWS}, warm BOOLEAN")

    def _warmup_rows(self, freezing: DataFrame, batch_id: int) -> DataFrame | None:
        """All rows so far of the matches that freeze in this batch: only folders since the first of them began are listed."""
        first = freezing.agg(F.min("first_batch")).first()[0]
        if first is None:
            return None
        rows = self.spark.read.schema(f"{ROWS}, batch BIGINT, warm BOOLEAN").parquet(f"{self.folder}/rows")
        return rows.filter(F.col("warm") & F.col("batch").between(first, batch_id)).drop("batch").join(freezing.select("match_id"), "match_id", "left_semi")

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """``batch``: the columns of ROWS (``started``: match start seen in the frame). Returns its rows with slots."""
        clock = self._read("clock", batch_id - 1, CLOCK)
        mapping = self._read("mapping", batch_id - 1, MAPPING)
        rows = self._take(batch, clock, batch_id)

        now = rows.groupBy("match_id").agg(F.max("frame").alias("now"), F.max(F.coalesce("started", F.lit(False))).alias("starting"))
        known = mapping.select("match_id").distinct().withColumn("mapped", F.lit(True))
        m = now.join(clock, "match_id", "full").join(known, "match_id", "left").na.fill(False, ["starting", "locked", "mapped"]).na.fill(batch_id, ["first_batch"])
        due = ~F.col("locked") & (F.col("starting") | ~F.col("mapped") | (F.col("now") - F.col("clustered_at") >= self.every)) & F.col("now").isNotNull()
        m = self._save(m.withColumn("due", due), "due", batch_id, DUE)

        warm, still = rows.filter("warm"), clock.filter("NOT locked").select("match_id")
        parts = identity.tracklet_parts(warm, self.width, self.height, self._read("parts", batch_id - 1, PARTS).join(still, "match_id", "left_semi"))
        parts = self._save(parts, "parts", batch_id, PARTS)
        sums = identity.vector_sums(warm, KEYS, self._read("sums", batch_id - 1, SUMS).join(still, "match_id", "left_semi"))
        sums = self._save(sums, "sums", batch_id, SUMS)

        pending = m.filter("due").select("match_id")
        t = identity.finished_tracklets(parts.join(pending, "match_id", "left_semi"))
        vectors = identity.unit_means(sums.join(pending, "match_id", "left_semi"), KEYS)
        t = identity.with_embeddings(t, vectors, KEYS, self.dim).withColumnRenamed("raw_id", "track_id")
        t = self._save(t.select([c.split()[0] for c in TRACKLETS.split(", ")]), "tracklets", batch_id, TRACKLETS)
        enough = t.groupBy("match_id").agg(F.count("*").alias("n")).filter(F.col("n") >= self.k).select("match_id")
        clusters = identity.cluster_tracklets(t.join(enough, "match_id", "left_semi"), self.k)
        fresh = identity.canonical_ids(clusters, t).select("match_id", F.col("track_id").alias("raw_id"), F.col("canonical_id").alias("slot"))
        # a match that starts without ever having been clustered falls back to positions
        bare = m.filter("starting AND NOT locked AND NOT mapped").select("match_id").join(enough, "match_id", "left_anti")
        all_tracks = identity.finished_tracklets(parts.join(bare, "match_id", "left_semi"), min_length=1).withColumnRenamed("raw_id", "track_id")
        fallback = identity.position_fallback(all_tracks, self.k).select("match_id", F.col("track_id").alias("raw_id"), "slot")
        fresh = fresh.unionByName(fallback).select("match_id", "raw_id", F.col("slot").cast("int"))
        fresh = self._save(fresh, "fresh", batch_id, MAPPING)
        clustered = fresh.select("match_id").distinct()
        current = fresh.unionByName(mapping.join(clustered, "match_id", "left_anti"))

        # once frozen, each box moves its slot's position, also when several raw ids of a frame share the slot
        moving, replay = rows.filter("NOT warm"), self._warmup_rows(m.filter("starting AND NOT locked"), batch_id)
        if replay is not None:
            moving = moving.unionByName(replay)
        before = self._read("positions", batch_id - 1, POSITIONS)

        def positions(slots: DataFrame) -> DataFrame:
            smooth = identity.slot_positions(moving.join(slots, KEYS), self.width, self.height, ties=("raw_id",), before=before)
            last = F.struct("frame", "raw_id")
            best = F.max_by(F.struct("frame", "raw_id", "pos_x", "pos_y"), last).alias("_r")
            return smooth.groupBy("match_id", "slot").agg(best).select("match_id", "slot", "_r.*")

        # unknown raw ids take the slot nearest to where they are first seen
        frozen = m.filter("locked OR starting").select("match_id")
        unknown = rows.join(frozen, "match_id", "left_semi").join(current, KEYS, "left_anti")
        feet_x, feet_y = (F.col("x1") + F.col("x2")) / (2.0 * self.width), F.col("y2") / self.height
        newcomers = unknown.groupBy(*KEYS).agg(F.min_by(feet_x, "frame").alias("fx"), F.min_by(feet_y, "frame").alias("fy"))
        joined = identity.nearest_slot(newcomers, positions(current), self.k, current).select("match_id", "raw_id", F.col("slot").cast("int"))
        current = self._save(current.unionByName(joined), "mapping", batch_id, MAPPING)
        self._save(positions(current), "positions", batch_id, POSITIONS)

        done = clustered.withColumn("_c", F.lit(True))
        clock = m.join(done, "match_id", "left").select(
            "match_id", "first_batch", F.when(F.col("_c"), F.col("now")).otherwise(F.col("clustered_at")).alias("clustered_at"), (F.col("locked") | F.col("starting")).alias("locked")
        )
        self._save(clock, "clock", batch_id, CLOCK)
        return rows.drop("started", "warm").join(current, KEYS, "left")

    def run(self, stream: DataFrame, checkpoint: str):
        """D7 as a streaming job; slots of each batch go to ``<folder>/out/batch=N``."""

        def step(batch: DataFrame, batch_id: int) -> None:
            out = self.process(batch, batch_id)
            out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
