"""Round trips write files that don't grow in number with the rows."""

import glob
import json

from pyspark.sql import functions as F

from courtspark.plans import io
from courtspark.sources import readers


def _tables(spark, folder, n):
    spark.range(n).selectExpr("id AS s_suppkey").repartition(2).write.parquet(f"{folder}/supplier.parquet")


def test_calibrations_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "fresh_dir", lambda spark, label: str(tmp_path / label))
    _tables(spark, tmp_path, 400)
    rows = {r["source_id"]: (r["first_x"], r["frame_width"]) for r in io.calibrations_roundtrip(spark, str(tmp_path)).collect()}
    assert rows == {f"cam{i}": (float(i), 1280) for i in range(400) if i % 7 != 3}
    assert 0 < len(glob.glob(f"{tmp_path}/calibrations/*.json")) <= 8


def test_calibration_documents_are_still_read(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"c{i}.json").write_text(json.dumps({"source_id": f"c{i}", "image_corners": [[i, 1], [2, 3], [4, 5], [6, 7]], "frame_width": 9, "frame_height": 8}, indent=1))
    rows = readers.calibrations(spark, str(tmp_path), per_source=True).collect()
    assert sorted((r["source_id"], r["corners"][0]["x"], r["frame_width"]) for r in rows) == [("c0", 0.0, 9), ("c1", 1.0, 9)]


def test_coco_documents_are_compressed_and_joined_by_what_is_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "fresh_dir", lambda spark, label: str(tmp_path / label))
    images = spark.range(2500).selectExpr("id AS image_id", "'vid1' AS video", "concat('frame_', lpad(id, 6, '0'), '.PNG') AS file_name", "1920 AS width", "1080 AS height")
    anns = images.selectExpr("image_id", "CAST(image_id % 8 AS INT) AS category_id", "array(1D, 2D, 3D, image_id * 1D) AS bbox", "array_repeat(image_id * 1D, 51) AS keypoints")
    monkeypatch.setattr(io.D, "images", lambda *a: images)
    monkeypatch.setattr(io.D, "annotations", lambda *a: anns.unionByName(anns.where("image_id % 3 = 0")))
    df = io.coco_roundtrip(spark, "")
    got = sorted((r["image_id"], r["video"], r["frame_no"], r["category_id"], r["bx"], r["bh"], r["n_kp"]) for r in df.collect())
    want = [(i, "vid1", i, i % 8, 1.0, float(i), 51) for i in range(2500) for _ in range(2 if i % 3 == 0 else 1)]
    assert got == want
    files = glob.glob(f"{tmp_path}/coco/*.json.gz")
    assert len(files) == 3 and not glob.glob(f"{tmp_path}/coco/*.json")
    assert {r[0] for r in readers.coco(spark, str(tmp_path / "coco"))[0].select(F.length("video") > 0).distinct().collect()} == {True}
    assert not any("keypoints" in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)
    assert "size" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
