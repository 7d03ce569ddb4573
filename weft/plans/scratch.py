"""Shared scratch space and worker paths of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (tests, a laptop) is a folder made for
    this session; on a cluster the setting is always there.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    path = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with no lineage.

    The files outlive the executors that wrote them, so losing an executor
    costs no more than the tasks that it was running.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of table_path() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in have:
        env["PYTHONPATH"] = ":".join([root, *have])
    return spark
