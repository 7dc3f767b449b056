"""Datasets of examples by split, documents of cases, and cached catalogs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, kept
from .versions import VersionStore

#: The splits, each a folder of its own.
SPLITS = ("train", "validation", "test")


def write_dataset(examples: DataFrame, root: str, metadata: Mapping[str, Any], split_col: str = "split") -> None:
    """The examples of each split under root, and metadata as JSON text. Fails where a split is there already. What makes the examples runs once."""
    examples = kept(examples)
    for split in SPLITS:
        examples.filter(F.col(split_col) == split).drop(split_col).write.mode("errorifexists").parquet(f"{root}/{split}.parquet")
    dropped(examples)
    spark = examples.sparkSession
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/metadata")


def load_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return spark.read.parquet(f"{root}/{split}.parquet")


def load_metadata(spark: SparkSession, root: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{root}/metadata").first()[0])


def records_to_frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None) -> DataFrame:
    """Records as a table; no records and no schema give a table without columns."""
    return spark.createDataFrame(list(rows), schema if schema is not None or rows else T.StructType([]))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON document, which must hold a list of that name."""
    document = spark.read.json(path, multiLine=True)
    if "cases" not in document.columns or not isinstance(document.schema["cases"].dataType, T.ArrayType):
        raise ValueError("the document has no list of cases")
    return document.select(F.inline("cases"))


def select(df: DataFrame, fields: Sequence[str] = (), order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0, where: object = None) -> DataFrame:
    """A page of a view. Conditions are refused, as remote views know none."""
    if where is not None:
        raise ValueError("conditions are not supported")
    out = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by]) if order_by else df
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*fields) if fields else out


def cached_catalog(spark: SparkSession, path: str, source: str, embedding_model: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The catalog of a cache that was written for the same source and embedding model, else a new one, which is then cached.

    An empty catalog is an error and is not cached. A new one is written beside the old one and becomes the cache when it
    is whole, so a failed write or build leaves what was there.
    """
    store = VersionStore(spark, path)
    held, of = store.current(), {"source": source, "embedding_model": embedding_model}
    if not refresh and held.number and held.facts == of:
        return store.segment(held.segments[-1])
    name = store.write(build())
    made = store.segment(name)
    if made.isEmpty():
        store.discard(name)
        raise ValueError("the catalog is empty")
    store.swap(held, [name], of)
    return made
