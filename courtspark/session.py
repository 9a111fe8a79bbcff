"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "courtspark", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, because there driver and executors share one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="courtspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder (nothing is created yet)."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialise(df, label: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, wherever the driver was started from."""
    context = spark.sparkContext
    if getattr(context, "_courtspark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="courtspark-package-"), "courtspark"), "zip", root, "courtspark")
    context.addPyFile(archive)
    # the driver-side worker of stateful streaming does not see added files, so it is told the folder
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, context.environment.get("PYTHONPATH")]))
    context._courtspark_shipped = True
