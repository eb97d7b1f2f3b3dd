"""Incremental ingest of fingerprint rows: complete rows, each id once, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("title", "artist", "album")


def complete(rows: DataFrame) -> DataFrame:
    """Rows with title, artist and album, one for each oid."""
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)).dropDuplicates(["oid"])


def append_new(rows: DataFrame, target: str) -> None:
    """Append what the target (Parquet) does not hold yet."""
    spark = rows.sparkSession
    fresh = complete(rows)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.parquet(target).select("oid"), "oid", "left_anti")
    fresh.write.mode("append").parquet(target)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Stream JSON files that are complete and not fingerprinted into target; stops when all are read."""
    rows = spark.readStream.schema(schema).json(source)
    rows = rows.where((F.col("complete") == 1) & (F.col("fingerprinted") == 0) & F.col("fpath").rlike(r"\.(mp3|flac)$"))
    writer = rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, target))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
