"""Immutable snapshots: one directory a version, Parquet a table, metadata beside it."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import require_columns


def snapshot_name(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H%M%S")


def _children(spark: SparkSession, root: str) -> list[str]:
    """Names under root, by Hadoop's file systems, so that root may be in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def write_snapshot(tables: dict[str, DataFrame], root: str, created_at: datetime | None = None, source: str = "") -> str:
    """The new snapshot's path. Raises if it exists: a snapshot is never changed."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{root}/{snapshot_name(created_at)}"
    if snapshot_name(created_at) in _children(spark, root):
        raise FileExistsError(path)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
    counts = {name: spark.read.parquet(f"{path}/{name}.parquet").count() for name in tables}
    spark.range(1).select(F.lit(json.dumps({"source": source, "rows": counts}, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{path}/metadata")
    return path


def latest_snapshot(spark: SparkSession, root: str, holds: str = "purchases.parquet") -> str:
    """The path of the snapshot of the largest name that holds the table."""
    for name in reversed(_children(spark, root)):
        if holds in _children(spark, f"{root}/{name}"):
            return f"{root}/{name}"
    raise FileNotFoundError(f"no snapshot with {holds} in {root}")


def read_snapshot(spark: SparkSession, path: str, required: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables named in required, each with its columns checked."""
    return {name: require_columns(spark.read.parquet(f"{path}/{name}.parquet"), need) for name, need in required.items()}


def upsert(base: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of live, and those of base whose key live lacks."""
    return live.unionByName(base.join(live.select(*keys).distinct(), keys, "left_anti"))


def last_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key the last row in the order given, which must be total."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def read_codes(spark: SparkSession, path: str, headers: tuple[str, ...] = ("model", "sku", "model_code")) -> DataFrame:
    """model, position (file and line): the first column of CSV files without a schema, at its first appearance, without
    blanks and headers. ValueError if no code is left. A list of codes is short: a file is one row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    lines = files.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line"))
    code = F.trim(F.regexp_replace(F.split("line", ",")[0], '^"|"$', ""))
    found = lines.select(F.struct("file", "at").alias("position"), code.alias("model")).filter((F.col("model") != "") & ~F.lower("model").isin(*headers))
    found = found.groupBy("model").agg(F.min("position").alias("position"))
    if found.isEmpty():
        raise ValueError(f"no model codes in {path}")
    return found


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report of bounded size, in one file with the columns in this order."""
    df.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


VIEWS = ("main", "pers", "side")


def payload_jobs(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(jobs, errors) of JSON payloads {"models": [{model_id, model, images: {main, pers, side}}]}: a row for each model and view.

    An error has what is known of its place, and a code: MALFORMED_JSON for text that is no JSON (null too), UNSUPPORTED_PAYLOAD for JSON without
    a list of models, INVALID_MODEL_ENTRY for an entry without a model or images, INVALID_URL for an address that is no text, blank, or not HTTP.
    Views of other names are passed over. One bad payload or entry costs no other.
    """
    get = F.try_variant_get
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
    text = lambda v: F.when(kind(v).isin("OBJECT", "ARRAY"), F.to_json(v)).otherwise(get(v, "$", "string"))
    parsed = payloads.select(F.try_parse_json(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("v"))
    listed = F.coalesce(kind(get("v", "$.models", "variant")) == "ARRAY", F.lit(False))
    whole = F.when(F.col("v").isNull(), "MALFORMED_JSON").when(~listed, "UNSUPPORTED_PAYLOAD")
    none = F.array(F.lit(None).cast("variant"))
    entries = parsed.select(whole.alias("error"), F.explode(F.when(whole.isNull(), get("v", "$.models", "array<variant>")).otherwise(none)).alias("m"))
    images = get("m", "$.images", "variant")
    model = get("m", "$.model", "variant")
    entry = (kind(F.col("m")) == "OBJECT") & model.isNotNull() & (kind(model) != "VOID") & (kind(images) == "OBJECT")
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(entry, F.lit(False)), "INVALID_MODEL_ENTRY")
    # views that the entry has, with a null address too
    names = F.from_json(F.to_json(images), "map<string,string>")
    own = F.filter(F.array(*map(F.lit, VIEWS)), lambda t: F.array_contains(F.map_keys(names), t))
    rows = entries.select(bad.alias("error"), text(get("m", "$.model_id", "variant")).alias("model_id"), F.trim(text(model)).alias("model"), images.alias("images"), F.explode(F.when(bad.isNull(), own).otherwise(F.array(F.lit(None).cast("string")))).alias("image_type"))
    views = F.lit(None).cast("variant")
    for t in VIEWS:
        views = F.when(F.col("image_type") == t, get("images", f"$.{t}", "variant")).otherwise(views)
    url = F.when(kind(views) == "STRING", F.trim(get(views, "$", "string")))
    judged = rows.select(
        "model_id", "model", "image_type", url.alias("url"),
        F.coalesce("error", F.when(F.col("model") == "", "INVALID_MODEL"), F.when(~F.coalesce(url.rlike("^https?://"), F.lit(False)), "INVALID_URL")).alias("error"),
    )
    return judged.filter("error is null").drop("error"), judged.filter("error is not null")


def unwrap_payload(responses: DataFrame, item: str, column: str = "body") -> DataFrame:
    """Rows of a remote view's JSON answers: a list, a list under data, rows, result or records, or fields and values.

    item is the schema of a row. Answers of another form give no rows.
    """
    rows = f"array<{item}>"
    wrapped = F.from_json(column, f"struct<data:{rows},rows:{rows},result:{rows},records:{rows}>")
    table = F.from_json(column, "struct<fields:array<string>,values:array<array<string>>>")
    fields = T.DataType.fromDDL(item).fields

    def named(values: Column) -> Column:
        by_name = F.map_from_arrays(table["fields"], values)
        return F.struct(*[F.try_element_at(by_name, F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in fields])

    zipped = F.transform(table["values"], named)
    found = F.coalesce(wrapped["data"], wrapped["rows"], wrapped["result"], wrapped["records"], F.when(table["fields"].isNotNull(), zipped), F.when(F.trim(column).startswith("["), F.from_json(column, rows)))
    return responses.select(F.explode(found).alias("row")).select("row.*")
