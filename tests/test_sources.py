"""Listings and joins of the sources and runs that need files or fixed small cases."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from courtspark.operators import detections, identity, runs
from courtspark.sources import readers, writers


def test_recordings_come_newest_first(spark, tmp_path):
    for name, size, at in (("b.mp4", 3 * 1024 * 1024 + 200_000, 1_700_000_000), ("a.mp4", 10, 1_700_000_500), ("c.mp4", 1, 1_700_000_000), ("notes.txt", 5, 1_800_000_000)):
        (tmp_path / name).write_bytes(b"x" * size)
        os.utime(tmp_path / name, (at, at))
    rows = readers.recordings(readers.inventory(spark, str(tmp_path), "*.mp4")).collect()
    assert [(r["name"], r["size_mb"], r["length"]) for r in rows] == [("a.mp4", 0.0, 10), ("b.mp4", 3.2, 3 * 1024 * 1024 + 200_000), ("c.mp4", 0.0, 1)]


def test_dataset_files_of_one_folder_in_order(spark, tmp_path):
    for name in ("train/b.png", "train/a.JPG", "train/list.txt", "val/c.png"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"1")
    files = readers.inventory(spark, str(tmp_path))
    assert [r["name"] for r in readers.dataset_files(files, "train").collect()] == ["a.JPG", "b.png"]
    sets = spark.createDataFrame([("x", "train", "val"), ("y", "train", "missing"), ("z", None, None)], "data_cfg STRING, train STRING, val STRING")
    got = {r["data_cfg"]: (r["train_count"], r["val_count"], r["dataset_total"]) for r in runs.dataset_counts(sets, files).collect()}
    assert got == {"x": (2, 1, 3), "y": (2, 0, 2), "z": (0, 0, 0)}


def test_one_report_opens_one_folder(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / f"match_id=r{i}"
        folder.mkdir()
        (folder / "a.json").write_text('{"meta": {"source": "cam"}, "total_shots": %d, "per_team": {"0": {"players": 2}}}' % i)
    one = readers.reports(spark, str(tmp_path), "r1")
    assert [(r["match_id"], r["total_shots"], r["per_team"]["0"]["players"]) for r in one.collect()] == [("r1", 1, 2)]
    assert "PartitionFilters: [isnotnull(match_id" in one._jdf.queryExecution().toString()
    assert readers.reports(spark, str(tmp_path), "r9").count() == 0


def test_planned_list_order_and_ball(spark):
    configs = spark.createDataFrame([("zeta", "b", 5, 8, 640, 7), ("pose", "b", 5, 8, 640, 7), ("alpha", "b", 5, 8, 640, None)], "stem STRING, base STRING, epochs INT, batch INT, imgsz INT, dataset_total INT")
    models = spark.createDataFrame([("court_best.pt",)], "file_name STRING")
    rows = runs.planned_list(configs, models, "train.py --task zeta").collect()
    assert [(r["id"], r["status"], r["is_yolo"], r["imgsz"]) for r in rows] == [("zeta", "running", True, "640"), ("alpha", "queued", True, "640"), ("ball", "queued", False, "288×512"), ("pose", "done", True, "640")]
    head = runs.overview(spark.createDataFrame([], "run_id STRING, active BOOLEAN, status STRING, epochs_done BIGINT, epochs_total BIGINT, progress DOUBLE, last_map50 DOUBLE, age_seconds DOUBLE"), runs.planned_list(configs, models, ""), None).first()
    assert (head["training_running"], head["runs"], head["active_run"], head["planned_queued"], head["planned_done"]) == (False, 0, None, 3, 1)


def test_snapshot_without_balls_or_counters(spark):
    counters = spark.createDataFrame([(1, "detector", 5, 9, 2, 0.51239, 20.0)], "match_id BIGINT, model STRING, total_detections BIGINT, last_frame BIGINT, frame_detections BIGINT, rolling_conf DOUBLE, rolling_ms DOUBLE")
    balls = spark.createDataFrame([(2, f, f / 100, 0.5) for f in range(30)] + [(2, 30, None, None)], "match_id BIGINT, frame BIGINT, x DOUBLE, y DOUBLE")
    tracks = spark.createDataFrame([], "match_id BIGINT, frame BIGINT, slot INT, cx DOUBLE, cy DOUBLE, confirmed BOOLEAN")
    rows = {r["match_id"]: r for r in detections.model_snapshot(counters, balls, tracks, "detector").collect()}
    assert rows[1]["fps"] == 50.0 and rows[1]["models"][0]["avg_confidence"] == 0.512 and rows[1]["ball_trail"] == []
    assert rows[2]["fps"] == 0.0 and rows[2]["models"] == [] and [p["x"] for p in rows[2]["ball_trail"]] == [f / 100 for f in range(10, 30)] and rows[2]["player_tracks"] == []


def test_run_detail_without_dataset_or_log(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 0.5)], "run_id STRING, epoch BIGINT, time DOUBLE, map50 DOUBLE")
    timing = rows.select("run_id", F.lit(2.0).alias("per_epoch_sec"))
    none = spark.createDataFrame([], "run_id STRING, stem STRING")
    sets = spark.createDataFrame([], "run_id STRING, train_count BIGINT, val_count BIGINT, dataset_total BIGINT")
    tails = spark.createDataFrame([], "run_id STRING, line_no BIGINT, line STRING")
    r = runs.run_detail(rows, timing, none, datasets=sets, tails=tails).first()
    assert (r["train_count"], r["dataset_total"], r["log_tail"], len(r["series"])) == (0, 0, [], 1)


def test_library_versions_are_never_overwritten(spark, tmp_path):
    out = str(tmp_path / "library")
    lib = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "match_id STRING, total_shots INT")
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "match_id STRING")
    writers.write_library(lib, out, 0)
    assert writers.change_library(spark, out, 0, some("a", "c", "c", "x"), some()) == 1
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):  # a second writer from the old version
        writers.change_library(spark, out, 0, some(), some("a"))
    assert writers.change_library(spark, out, 1, some("b"), some("c")) == 2
    read = lambda v: sorted((r["match_id"], r["archived"]) for r in spark.read.parquet(f"{out}/version={v:08d}").collect())
    assert read(1) == [("a", True), ("b", False), ("c", True)] and read(2) == [("a", True), ("b", True)]


def test_registered_embedder(spark):
    identity.register_embedder(spark, "look_of_test", lambda: lambda crops: np.array([[sum(c), len(c)] for c in crops]))
    crops = spark.createDataFrame([(1, [3, 0, 0, 0]), (2, None), (3, []), (4, [0, 0])], "id BIGINT, crop ARRAY<INT>")
    rows = {r["id"]: r["v"] for r in spark.sql("SELECT id, look_of_test(crop) AS v FROM {c}", c=crops).collect()}
    assert rows == {1: [0.6, 0.8], 2: None, 3: [0.0, 0.0], 4: [0.0, 1.0]}
