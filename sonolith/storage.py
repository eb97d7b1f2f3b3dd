"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def shared_dir(spark: SparkSession) -> str:
    """This application's scratch folder, removed when the driver ends.

    It lies in spark.checkpoint.dir (the setting, or what setCheckpointDir() set), else in the warehouse if that is a
    store all machines reach. Only a local master may use a folder of its own machine.
    """
    known = spark.conf.get("sonolith.scratch", None)
    if known:
        return known
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = told.get() if told.isDefined() else None
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="sonolith-")
        elif warehouse and not warehouse.startswith(("file:", "/")):
            found = warehouse
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{found.rstrip('/')}/sonolith-{spark.sparkContext.applicationId}"
    fs, path = _hadoop(spark, root)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    spark.conf.set("sonolith.scratch", root)
    return root


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sonolith_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialise() wrote and that nothing lazy still reads."""
    fs, path = _hadoop(df.sparkSession, df._sonolith_path)
    fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; call it when all results are written."""
    known = spark.conf.get("sonolith.scratch", None)
    if known:
        fs, path = _hadoop(spark, known)
        fs.delete(path, True)
        spark.conf.unset("sonolith.scratch")
