"""Writers (K1-K8). Documents are written in bounded parts: no row or task holds a whole match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtspark.blocks import Lane, RowNumber, scan


def write_results(players: DataFrame, out: str, shots: DataFrame | None = None) -> None:
    """K1: one JSON line per frame, a folder per source. ``shots``: source_id, frame, slot, type."""
    box = F.array("x1", "y1", "x2", "y2")
    xy = F.when(F.col("court_x").isNotNull(), F.array("court_x", "court_y"))
    p = F.struct("slot", box.alias("box"), xy.alias("court_xy"))
    lines = players.groupBy("source_id", "frame").agg(F.sort_array(F.collect_list(p)).alias("players"))
    kind = "array<struct<slot: int, type: string>>"
    if shots is None:
        lines = lines.withColumn("shots", F.array().cast(kind))
    else:
        hits = shots.groupBy("source_id", "frame").agg(F.sort_array(F.collect_list(F.struct("slot", "type"))).cast(kind).alias("shots"))
        lines = lines.join(hits, ["source_id", "frame"], "full")
        lines = lines.withColumn("players", F.coalesce("players", F.array().cast(lines.schema["players"].dataType))).withColumn("shots", F.coalesce("shots", F.array().cast(kind)))
    lines = lines.select("source_id", "frame", "players", "shots", F.size("players").alias("n"))
    lines.write.partitionBy("source_id").json(out)


def write_analysis(det: DataFrame, out: str, frames_per_document: int = 2000, fps: float = 30.0, stride: int = 1) -> None:
    """K2: analysis documents per video, cut into parts of a fixed number of frames. ``det``: video, frame, model, det_idx, bbox, confidence, class_id."""
    d = F.struct("det_idx", "bbox", "confidence", "class_id")
    per_model = det.groupBy("video", "frame", "model").agg(F.sort_array(F.collect_list(d)).alias("_d"), F.count("*").alias("count"), F.bround(F.avg("confidence"), 4).alias("avg_conf"))
    dets = F.transform("_d", lambda x: F.struct(x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), x["class_id"].alias("class_id")))
    entry = F.struct("model", dets.alias("dets"), F.struct("count", "avg_conf").alias("stats"))
    per_frame = per_model.groupBy("video", "frame").agg(F.collect_list(entry).alias("_m"))
    result = F.struct(
        "frame", (F.col("frame") / fps).alias("timestamp_s"),
        F.map_from_entries(F.transform("_m", lambda m: F.struct(m["model"], m["dets"]))).alias("detections"), F.map_from_entries(F.transform("_m", lambda m: F.struct(m["model"], m["stats"]))).alias("stats"),
    )
    part = F.floor(F.col("frame") / frames_per_document)
    docs = per_frame.select("video", part.alias("part"), result.alias("r")).groupBy("video", "part").agg(F.collect_list("r").alias("results"))
    counts = F.aggregate(F.flatten(F.transform("results", lambda r: F.map_entries(r["stats"]))), F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"]["count"])
    docs = docs.withColumn("frames", F.transform("results", lambda r: r["frame"]))
    docs = docs.select(
        "video", F.lit(fps).alias("fps"), F.size("results").alias("frames_analyzed"), F.lit(stride).alias("stride"),
        (F.size("results") * stride / fps).alias("duration_s"), F.struct(counts.alias("detections"), F.array_min("frames").alias("first_frame"), F.array_max("frames").alias("last_frame")).alias("summary"), "results",
    )
    docs.write.option("maxRecordsPerFile", 1).json(out)  # a document is a file


def number_reports(reports: DataFrame, library: DataFrame, seconds: str, order: str) -> DataFrame:
    """K3: sortable unique report ids: ``yyyyMMdd_HHmmss``, then ``_2``, ``_3`` for the same second. ``library``: match_id of saved reports."""
    base = F.date_format(seconds, "yyyyMMdd_HHmmss")
    taken = library.select(F.substring("match_id", 1, 15).alias("_base")).groupBy("_base").agg(F.count("*").alias("_taken"))
    r = scan(reports.withColumn("_base", base), Lane(("_base",), order), _i=RowNumber()).join(taken, "_base", "left")
    n = F.col("_i") + F.coalesce("_taken", F.lit(0))
    return r.withColumn("report_id", F.when(n == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", n.cast("string")))).drop("_base", "_i", "_taken")


def write_reports(documents: DataFrame, out: str) -> None:
    """K3: one folder per report."""
    documents.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("match_id").json(out)


def write_mapping(mapping: DataFrame, out: str, ids_per_document: int = 10_000, config: dict | None = None) -> None:
    """K4: raw id to canonical id documents with the ids grouped per player, in parts of bounded size."""
    sizes = mapping.groupBy("match_id").agg(F.ceil(F.count("*") / ids_per_document).alias("_parts"))
    m = mapping.join(sizes, "match_id").withColumn("part", F.pmod(F.xxhash64("raw_id"), F.col("_parts")))
    groups = m.groupBy("match_id", "part", "canonical_id").agg(F.sort_array(F.collect_list("raw_id")).alias("raw_ids"))
    docs = groups.groupBy("match_id", "part").agg(F.sort_array(F.collect_list(F.struct("canonical_id", "raw_ids"))).alias("canonical_order"))
    settings = F.create_map(*(F.lit(str(x)) for item in (config or {}).items() for x in item)) if config else F.create_map().cast("map<string,string>")
    pairs = F.flatten(F.transform("canonical_order", lambda g: F.transform(g["raw_ids"], lambda r: F.struct(r.cast("string"), g["canonical_id"]))))
    docs.select("match_id", F.map_from_entries(pairs).alias("mapping"), "canonical_order", settings.alias("config")).write.option("maxRecordsPerFile", 1).partitionBy("match_id").json(out)


def write_labels(labels: DataFrame, out: str) -> None:
    """K5: label lines by split; the image name stays a column, so no folder holds a file per image."""
    labels.select("split", F.concat_ws("\t", "image", "line").alias("value")).write.partitionBy("split").text(out)


def write_trajectories(rows: DataFrame, out: str, buckets: int = 64) -> None:
    """K6: trajectory CSVs by split and a fixed number of buckets of rallies; a rally's rows stand together, in frame order."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("rally_id"), F.lit(buckets))).repartition("split", "bucket").sortWithinPartitions("split", "bucket", "rally_id", "Frame")
    dealt.select("rally_id", "Frame", "Visibility", "X", "Y", "split", "bucket").write.partitionBy("split", "bucket").option("header", True).csv(out)


def manifest(rows: DataFrame) -> DataFrame:
    """K6: rallies per split."""
    return rows.select("split", "rally_id").distinct()


def archive(reports: DataFrame, archived: DataFrame, deleted: DataFrame) -> DataFrame:
    """K7: the next version of the library: deleted reports gone, archived ones marked."""
    marks = archived.select("match_id").distinct().withColumn("_a", F.lit(True))
    kept = reports.join(deleted.select("match_id"), "match_id", "left_anti").join(marks, "match_id", "left")
    return kept.withColumn("archived", F.coalesce("_a", F.lit(False))).drop("_a")


def write_library(reports: DataFrame, out: str, version: int) -> None:
    """K7: a version of the library as a folder of its own; a number that is taken is refused, so no version is overwritten."""
    reports.write.mode("errorifexists").parquet(f"{out}/version={version:08d}")


def change_library(spark: SparkSession, out: str, version: int, archived: DataFrame, deleted: DataFrame) -> int:
    """K7: apply :func:`archive` to a version and write the next one; returns its number. What was archived before stays so.

    A writer that another one outran gets Spark's error that the path exists and has to start again from the newer version.
    """
    before = spark.read.parquet(f"{out}/version={version:08d}")
    after = archive(before.withColumnRenamed("archived", "_before"), archived, deleted) if "archived" in before.columns else archive(before.withColumn("_before", F.lit(False)), archived, deleted)
    write_library(after.withColumn("archived", F.col("archived") | F.coalesce("_before", F.lit(False))).drop("_before"), out, version + 1)
    return version + 1


def latest_version(log: DataFrame, key: str, updated: str) -> DataFrame:
    """K8: current rows of an append-only table: the newest per key, without those whose newest entry is a deletion."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(updated)).alias("_r"))
    return newest.select(key, "_r.*").filter("NOT coalesce(deleted, false)").drop("deleted")
