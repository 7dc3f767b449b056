"""Tables kept for a while in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one a temporary folder, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fernweave-"))
    return spark.sparkContext.getCheckpointDir()


def files_of(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read again: what is used several times is computed once, and its rows can be counted from the files.

    A table that kept gave is given back as it is. The files go by dropped, at the latest when the driver's JVM ends.
    """
    if getattr(df, "_kept_at", None):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = files_of(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that kept gave and nothing reads any more."""
    for df in tables:
        files, place = files_of(df.sparkSession, df._kept_at)
        files.delete(place, True)
