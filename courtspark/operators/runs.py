"""Training-run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.blocks import Lane, Prev, RunningSum, scan
from courtspark.functions import text as X

# Planned configurations, the model each one writes and its label.
PLANNED = [
    ("detection_combined", "player_best.pt", "Player Detection"), ("detection_combined_s", "player_s_best.pt", "Player Detection (s)"),
    ("pose", "court_best.pt", "Court Keypoints"), ("pose_s", "court_s_best.pt", "Court Keypoints (s)"),
    ("bodypose", "bodypose_best.pt", "Body Pose"), ("bodypose_s", "bodypose_s_best.pt", "Body Pose (s)"),
    ("shotclass", "shotclass_best.pt", "Shot Classification"), ("shotclass_s", "shotclass_s_best.pt", "Shot Classification (s)"),
]

# The ball tracker's plan (id, label, base, epochs, batch, image size, model, not a configuration, images).
BALL_PLAN = ("ball", "Ball Tracking (TrackNetV3)", "TrackNetV3 (shuttlecock pretrained)", 30, 8, "288×512", "ball_best.pt", False, 264)


def latest_progress(logs: DataFrame, run: str, position: str, line: str) -> DataFrame:
    """The last line of each log that is a progress line (top-1 by map-side combined ``max_by``)."""
    clean = logs.select(run, position, X.strip_ansi(line).alias("_line"))
    clean = clean.filter(F.col("_line").contains("it/s")).filter(X.progress_fields("_line")[0].isNotNull())
    last = clean.groupBy(run).agg(F.max_by("_line", position).alias("_line"), F.max(position).alias(position))
    return last.select(run, position, *X.progress_fields("_line"))


def read_metrics(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """Text metric columns to numbers; blank and malformed values become null."""
    return rows.select(*[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) if c in numeric else F.col(c) for c in rows.columns])


def epoch_deltas(rows: DataFrame, span: int | None = None) -> DataFrame:
    """Increase of the cumulative clock since the previous row that has one."""
    lane = Lane(("run_id",), "epoch") if span is None else Lane(("run_id",), "epoch", span=span)
    timed = rows.filter(F.col("time").isNotNull()).select("run_id", "epoch", "time")
    d = scan(timed, lane, prev=Prev(F.col("time")))
    return d.filter(F.col("time") > F.col("prev")).select("run_id", "epoch", (F.col("time") - F.col("prev")).alias("delta"))


def upper_median(values: DataFrame, key: str, value: str, out: str, width: float = 60.0) -> DataFrame:
    """``sorted(v)[n // 2]`` per key without collecting a key.

    Equal values are counted first; the counts are cumulated in value order with a block
    scan (blocks are value ranges), and the value whose range covers the middle is the median.
    """
    counts = values.groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col(value) / width).cast("bigint"))
    ranked = scan(counts, Lane((key,), "_bin", (value,), span=64), _upto=RunningSum(F.col("_n")))
    totals = counts.groupBy(key).agg(F.sum("_n").alias("_total"))
    middle = F.floor(F.col("_total") / 2) + 1
    return ranked.join(totals, key).filter((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_n") < middle)).select(key, F.col(value).alias(out))


def latest_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The row of the highest epoch per run."""
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*columns), F.col("epoch")).alias("_r"), F.max("epoch").alias("epochs_done"))
    return last.select("run_id", "epochs_done", *[F.col(f"_r.{c}").alias(f"last_{c}") for c in columns])


def run_list(rows: DataFrame, info: DataFrame) -> DataFrame:
    """One line per known run with progress and status.

    ``info``: run_id, total, patience, proc, data_cfg, age_seconds, has_checkpoint, dataset_total. T1: the run touched last comes first.
    """
    runs = info.join(latest_rows(rows, ["map50", "time"]), "run_id", "left").withColumn("epochs_done", F.coalesce("epochs_done", F.lit(0)))
    runs = runs.withColumn("active", X.run_active("proc", "data_cfg", "age_seconds"))
    return runs.select(
        "run_id", "active", X.run_status("active", "epochs_done", "total", "patience", "has_checkpoint").alias("status"), "epochs_done",
        F.col("total").alias("epochs_total"), F.when(F.col("total") > 0, F.bround(F.col("epochs_done") / F.col("total"), 3)).otherwise(0.0).alias("progress"),
        "last_map50", "dataset_total", "age_seconds",
    ).orderBy("age_seconds", "run_id")


def overview(runs: DataFrame, planned: DataFrame, proc: str | None) -> DataFrame:
    """The one row a dashboard's head shows: what trains now, and how many runs and plans are in each state.

    ``runs``, ``planned``: output of :func:`run_list` and :func:`planned_list`. The active run is the one touched last.
    """
    states = ["training", "done", "crashed", "pending"]
    newest = F.struct(F.col("age_seconds"), F.col("run_id"))
    active = F.struct("run_id", "epochs_done", "epochs_total", "progress", "last_map50")
    count = lambda column, state: F.count(F.when(F.col(column) == state, 1))
    head = runs.agg(F.count("*").alias("runs"), *[count("status", x).alias(f"runs_{x}") for x in states], F.min_by(F.when(F.col("active"), active), F.when(F.col("active"), newest)).alias("active_run"))
    plans = planned.agg(F.count("*").alias("planned"), *[count("status", x).alias(f"planned_{x}") for x in ("running", "queued", "done")])
    running = F.lit(proc is not None).alias("training_running")
    return head.withColumn("_one", F.lit(1)).join(plans.withColumn("_one", F.lit(1)), "_one").select(running, F.lit(proc).alias("process"), *[c for c in head.columns], *plans.columns)


def run_timing(rows: DataFrame, info: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Per-epoch seconds, what is left, and when it will be done.

    ``info``: run_id, total, active, anchor (epoch seconds of the last checkpoint).
    ``progress``: output of :func:`latest_progress` with ``run_id``.
    """
    median = upper_median(epoch_deltas(rows), "run_id", "delta", "per_epoch")
    runs = latest_rows(rows, ["time"]).join(info, "run_id").join(median, "run_id", "left")
    if progress is None:
        runs = runs.selectExpr("*", "CAST(NULL AS INT) AS p_epoch", "CAST(NULL AS DOUBLE) AS p_done", "CAST(NULL AS BIGINT) AS p_left", "CAST(NULL AS DOUBLE) AS p_rate")
    else:
        live = progress.selectExpr("run_id", "epoch AS p_epoch", "batch_progress AS p_done", "epoch_remaining_sec AS p_left", "it_per_s AS p_rate")
        runs = runs.join(live, "run_id", "left")
        for c in ("p_epoch", "p_done", "p_left", "p_rate"):
            runs = runs.withColumn(c, F.when(F.col("active"), F.col(c)))
    left = F.greatest(F.col("total") - F.col("epochs_done"), F.lit(0))
    base = F.coalesce(F.col("per_epoch"), F.lit(0.0)) * left
    total_left = F.when(F.col("p_left").isNotNull() & (F.col("per_epoch") > 0), F.col("p_left") + F.col("per_epoch") * F.greatest(left - 1, F.lit(0))).otherwise(base)
    nonzero = lambda c: F.when(c != 0, c)
    return runs.select(
        "run_id", "epochs_done", F.col("total").alias("epochs_total"), F.bround("per_epoch", 1).alias("per_epoch_sec"),
        F.bround(nonzero(F.col("last_time")), 1).alias("elapsed_sec"),
        F.coalesce("p_epoch", F.when(F.col("active") & (F.col("total") > 0), F.col("epochs_done") + 1)).alias("current_epoch"),
        F.col("p_done").alias("current_epoch_progress"), F.col("p_left").alias("current_epoch_remaining_sec"), F.bround("p_rate", 2).alias("it_per_s"),
        F.bround(nonzero(total_left), 1).alias("total_remaining_sec"),
        F.when(F.col("active"), nonzero(F.col("anchor")) + nonzero(total_left)).alias("eta_at"),
    )


def planned_list(configs: DataFrame, models: DataFrame, proc: str) -> DataFrame:
    """Planned configuration, joined to finished models and the running task; T1: running, queued, done, then by id.

    ``configs``: stem, base, epochs, batch, imgsz, dataset_total; ``models``: file name of each finished model. The ball
    tracker is trained outside the configurations and always listed; the running task is never looked up for it.
    """
    spark = configs.sparkSession
    known = F.broadcast(spark.createDataFrame(PLANNED, "stem string, known_model string, known_label string"))
    c = configs.join(known, "stem", "left")
    c = c.select(
        F.col("stem").alias("id"), F.coalesce("known_label", "stem").alias("label"), F.col("base").cast("string").alias("base"), F.col("epochs").cast("bigint").alias("epochs"),
        F.col("batch").cast("bigint").alias("batch"), F.col("imgsz").cast("string").alias("imgsz"), F.coalesce("known_model", F.concat("stem", F.lit("_best.pt"))).alias("output_model"),
        F.lit(True).alias("is_yolo"), F.col("dataset_total").cast("bigint").alias("dataset_total"),
    )
    c = c.unionByName(spark.createDataFrame([BALL_PLAN], c.schema))
    done = models.select(F.col("file_name").alias("output_model")).distinct().withColumn("model_exists", F.lit(True))
    c = c.join(done, "output_model", "left").withColumn("model_exists", F.coalesce("model_exists", F.lit(False)))
    running = F.col("is_yolo") & F.contains(F.lit(proc), F.concat(F.lit("--task "), F.col("id")))
    status = F.when(F.col("model_exists"), "done").when(running, "running").otherwise("queued")
    rank = F.when(status == "running", 0).when(status == "queued", 1).otherwise(2)
    out = c.select("id", "label", "base", "epochs", "batch", "imgsz", "output_model", "model_exists", status.alias("status"), "is_yolo", "dataset_total", rank.alias("status_rank"))
    return out.orderBy("status_rank", "id")


def log_tail(lines: DataFrame, key: str, position: str, line: str, n: int = 40) -> DataFrame:
    """The last n lines of each log, cleaned, blank ones dropped (the limit runs before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col(position).desc())
    last = lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return last.select(key, position, X.strip_ansi(line).alias("line")).filter(F.trim("line") != "")


def run_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifact rows of each run with their gallery category."""
    return artifacts.select("run_id", "stem", X.image_category("stem").alias("category"))


def dataset_counts(sets: DataFrame, files: DataFrame) -> DataFrame:
    """Training and validation images of each data configuration.

    ``sets``: data_cfg, train, val (folders, either may be null or missing on disk); ``files``: output of ``readers.inventory``.
    """
    counts = files.groupBy("folder").agg(F.count("*").alias("_n"))
    sides = sets.select("data_cfg", F.explode(F.array(F.struct(F.lit("train").alias("side"), F.col("train").alias("folder")), F.struct(F.lit("val").alias("side"), F.col("val").alias("folder")))).alias("s"))
    sides = sides.select("data_cfg", "s.*").join(counts, "folder", "left")
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("_n"))), F.lit(0))
    out = sides.groupBy("data_cfg").agg(of("train").alias("train_count"), of("val").alias("val_count"))
    return out.withColumn("dataset_total", F.col("train_count") + F.col("val_count"))


def run_detail(rows: DataFrame, timing: DataFrame, artifacts: DataFrame, epochs_per_document: int = 1000, datasets: DataFrame | None = None, tails: DataFrame | None = None) -> DataFrame:
    """A run's metric series, timing and artifact counts; a long series comes in documents of bounded size.

    ``datasets``: run_id, train_count, val_count, dataset_total; ``tails``: output of :func:`log_tail` with ``run_id`` and
    ``line_no``, which bounds its lines per run. Runs without either get zeros and no lines.
    """
    part = F.floor(F.col("epoch") / epochs_per_document)
    series = rows.groupBy("run_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("epoch", "time", "map50"))).alias("series"))
    counts = run_artifacts(artifacts).groupBy("run_id", "category").agg(F.count("*").alias("n"))
    counts = counts.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("artifacts"))
    out = series.join(timing, "run_id", "left").join(counts, "run_id", "left")
    if datasets is not None:
        sizes = ["train_count", "val_count", "dataset_total"]
        out = out.join(datasets.select("run_id", *sizes), "run_id", "left").na.fill(0, sizes)
    if tails is not None:
        lines = tails.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("log_tail"))
        out = out.join(lines, "run_id", "left").withColumn("log_tail", F.coalesce("log_tail", F.array().cast("array<string>")))
    return out
