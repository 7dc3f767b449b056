"""Integrity of stored vectors, staleness of images, versions of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.versions import Version, VersionStore


def catalog_issues(images: DataFrame, expected_model: str, dimension: int) -> DataFrame:
    """model, image_type, issue: flags of vectors, repeated keys, and vectors that several models share.

    images: model, image_type, embedding, embedding_model. Equal vectors meet by their hash.
    """
    flags = images.select("model", "image_type", F.explode(V.vector_flags(F.col("embedding"), F.coalesce("embedding_model", F.lit("")), expected_model, dimension)).alias("issue"))
    twice = images.groupBy("model", "image_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("model", "image_type", F.lit("duplicate_key").alias("issue"))
    keyed = images.filter(F.size("embedding") > 0).groupBy(F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256).alias("k"))
    shared = keyed.agg(F.min(F.struct("model", "image_type")).alias("first"), F.count_distinct("model").alias("models"))
    shared = shared.filter("models > 1").select("first.model", "first.image_type", F.lit("duplicate_vector").alias("issue"))
    return flags.unionByName(twice).unionByName(shared)


def catalog_counts(images: DataFrame) -> DataFrame:
    named = F.when(F.trim("model") != "", F.col("model"))
    return images.agg(F.count(F.lit(1)).alias("images"), F.count_distinct(named).alias("models"))


def stale_images(stored: DataFrame, current: DataFrame) -> DataFrame:
    """model, image_type, stored_hash, current_hash, stale: no stored hash, another one, or no current image."""
    joined = stored.select("model", "image_type", F.col("image_hash").alias("stored_hash")).join(current.select("model", "image_type", F.col("image_hash").alias("current_hash")), ["model", "image_type"], "left")
    blank = F.coalesce(F.col("stored_hash"), F.lit("")) == ""
    return joined.withColumn("stale", blank | F.col("current_hash").isNull() | (F.col("stored_hash") != F.col("current_hash")))


def self_retrieval(scores: DataFrame) -> DataFrame:
    """Stored images that don't find themselves first. scores: query_model, query_type, model, image_type, similarity."""
    own = (F.col("query_model") == F.col("model")) & (F.col("query_type") == F.col("image_type"))
    per = scores.groupBy("query_model", "query_type").agg(F.max(F.when(own, F.col("similarity"))).alias("own"), F.max(F.when(~own, F.col("similarity"))).alias("other"))
    return per.filter(F.col("own").isNull() | (F.col("other") > F.col("own")))


def download_error(error: Column) -> Column:
    """The code of a failed download, from what failed: not found, no image, anything else."""
    return F.when(error == "not_found", "IMAGE_NOT_FOUND").when(error == "invalid", "INVALID_IMAGE").when(error.isNotNull(), "DOWNLOAD_FAILED")


def audit(stored: DataFrame, current: DataFrame) -> DataFrame:
    """model, image_type, row_id, model_id, stored_hash, current_hash, stale, error: each stored image against its source of now.

    stored: model, image_type, row_id, model_id, image_hash. current: model, image_type, image_hash, error. An image is stale
    without a stored hash, with another one, or when its source can't be read, or isn't there (error not_found).
    """
    now = current.select("model", "image_type", F.col("image_hash").alias("current_hash"), F.col("error").alias("_error"), F.lit(True).alias("_there"))
    joined = stored.withColumnRenamed("image_hash", "stored_hash").join(now, ["model", "image_type"], "left")
    error = F.when(F.col("_there").isNull(), "not_found").otherwise(F.col("_error"))
    blank = F.coalesce(F.col("stored_hash"), F.lit("")) == ""
    stale = error.isNotNull() | blank | F.col("current_hash").isNull() | (F.col("stored_hash") != F.col("current_hash"))
    return joined.select("model", "image_type", "row_id", "model_id", "stored_hash", "current_hash", stale.alias("stale"), download_error(error).alias("error"))


def refreshed_rows(audited: DataFrame, encoded: DataFrame, encoder: str, dimension: int) -> DataFrame:
    """The rows to write for stale images: row_id, model_id, image_type, embedding_model, embedding_dimension, embedding (JSON), image_hash.

    encoded: model, image_type, embedding of the images of now. A row that can't be refreshed raises, which fails the job that writes: its source failed,
    there is no vector of the dimension, or it has neither a row_id nor a model_id. So one failure stops all.
    """
    rows = audited.filter("stale").join(encoded.select("model", "image_type", "embedding"), ["model", "image_type"], "left")
    bad = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.size("embedding") == dimension, F.when(F.col("row_id").isNull() & F.col("model_id").isNull(), "missing model_id"))
        .otherwise("INVALID_VECTOR")
    )
    name = F.concat_ws("/", "model", "image_type")
    text = F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("cannot refresh "), name, F.lit(": "), bad)).cast("string")).otherwise(text)
    return rows.select("row_id", "model_id", "image_type", F.lit(encoder).alias("embedding_model"), F.lit(dimension).alias("embedding_dimension"), checked.alias("embedding"), F.col("current_hash").alias("image_hash"))


def refresh_store(store: VersionStore, audited: DataFrame, encoded: DataFrame, encoder: str, dimension: int) -> Version:
    """The store's next version: its rows with the stale ones replaced. A failure raises and leaves the version as it is.

    Rows of the store: model, image_type, row_id, model_id, embedding_model, embedding_dimension, embedding, image_hash.
    """
    before = store.current()
    rows = store.segment(before.segments[-1])
    names = audited.filter("stale").select("model", "image_type", "row_id", "model_id")
    made = refreshed_rows(audited, encoded, encoder, dimension)
    # the key of a written row is its row_id, or model_id and view
    fresh = made.join(names.withColumnsRenamed({"row_id": "_r", "model_id": "_m", "image_type": "_t"}), F.col("row_id").eqNullSafe(F.col("_r")) & F.col("model_id").eqNullSafe(F.col("_m")) & (F.col("image_type") == F.col("_t")))
    fresh = fresh.drop("_r", "_m", "_t").select(*rows.columns)
    name = store.write(rows.join(names.select("model", "image_type"), ["model", "image_type"], "left_anti").select(*rows.columns).unionByName(fresh))
    return store.swap(before, [name])


class VersionedTable:
    """A table that is rebuilt beside the current version and swapped in if a check accepts it; else the old one stays."""

    def __init__(self, df: DataFrame | None = None) -> None:
        self.current, self.error = df, None

    def refresh(self, build, accept) -> bool:
        try:
            made = build()
            if not accept(made):
                raise ValueError("the new version was not accepted")
        except Exception as error:  # the old version must outlive any failure
            self.error = str(error)
            return False
        self.current, self.error = made, None
        return True
