"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker, at most, unless the session asks for less. Texts vary so much in
#: length that a number of rows bounds nothing.
BATCH_BYTES = 8 << 20


def reachable(spark: SparkSession) -> None:
    """Makes the session fit for this package's Python workers: it can be imported, and batches are small.

    Workers import it from where the driver has it; clusters without that folder need --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (env.get("PYTHONPATH"), root)))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", f"{64 << 20}b"):  # the default
        spark.conf.set(key, f"{BATCH_BYTES}b")


def text_of(df: DataFrame, column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, one of our own, on a local master alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="fernweave-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    That cuts the lineage, so a lost executor costs only the stage at hand, and what is used twice is computed once.
    discard deletes the files; what is left of them goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written gave and that nothing reads any more."""
    for df in tables:
        files, place = _place(df.sparkSession, df._written_to)
        files.delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: an operator's own output columns replace those of the input."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
