"""Shipping the package to executors whose Python path doesn't have it, and the folder for checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_engine(spark: SparkSession) -> None:
    """Once a Spark context: functions that run in Python workers import their module from the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrylight_engine", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "quarrylight_engine.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)
    sc._quarrylight_engine = True


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on one machine, a folder of our own."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not hasattr(sc, "_quarrylight_dir"):
            sc._quarrylight_dir = tempfile.mkdtemp(prefix="spark-quarrylight-")
        found = sc._quarrylight_dir
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
