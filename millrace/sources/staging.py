"""Intermediate tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; a temporary folder where one machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows computed once, written as Parquet and read back; steps that follow start from there.

    Ids are digests as hex text, of which zstd leaves half and snappy all.
    """
    spark = rows.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
