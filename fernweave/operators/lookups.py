"""Small operators around hits and candidates: selections, lookups, margins, runs, crop boxes, requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.snapshots import last_rows

#: The order of views, the part of an image from which a crop isolates nothing, and the least production score.
VIEW_ORDER = ("main", "pers", "side", "other")
WHOLE_SHARE, PRODUCTION_MIN = 0.92, 0.2
LEAST_SIDE = 8


def selected_rows(rows: DataFrame, models: Sequence[str] = (), limit: int = 0, order: Sequence[str] = ("model", "image_type")) -> DataFrame:
    """Rows of the models, if any are named, and of these the first limit in order, unless it is 0."""
    out = rows.filter(F.col("model").isin(list(models))) if models else rows
    return out.orderBy(*order).limit(limit) if limit > 0 else out


def hits_of(hits: DataFrame, model: str, image_type: str | None = None) -> DataFrame:
    """The hits of a model, or of one of its images."""
    out = hits.filter(F.col("model") == model)
    return out if image_type is None else out.filter(F.col("image_type") == image_type)


def production_top(hits: DataFrame, least: float = PRODUCTION_MIN) -> DataFrame:
    """The first hit of each query, where its similarity reaches the least one."""
    return hits.filter((F.col("rank") == 1) & (F.col("similarity") >= least))


def with_codes(rows: DataFrame, codes: DataFrame, id_col: str = "model_id") -> DataFrame:
    """rows with the code of their id; rows without one, or with a blank one, go. codes: id_col, code."""
    return rows.join(codes.filter(F.trim("code") != ""), id_col)


def ordered_views(images: DataFrame) -> DataFrame:
    """model, views: its distinct views, main before pers before side before others."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, VIEW_ORDER[:-1])), F.col("image_type")), F.lit(0))
    key = F.struct(F.when(place == 0, len(VIEW_ORDER)).otherwise(place).alias("at"), F.col("image_type").alias("view"))
    return images.groupBy("model").agg(F.transform(F.sort_array(F.collect_set(key)), lambda x: x["view"]).alias("views"))


def margins(hits: DataFrame, expected: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """query_id, expected_rank (null: not found), margin (of the first score over the second) and recall_k of each query.

    hits: query_id, rank, model, score. expected: query_id, model.
    """
    best = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_2"))
    own = hits.join(expected, ["query_id", "model"]).groupBy("query_id").agg(F.min("rank").alias("expected_rank"))
    out = expected.select("query_id").distinct().join(best, "query_id", "left").join(own, "query_id", "left")
    found = [F.when(F.col("expected_rank") <= k, 1.0).otherwise(0.0).alias(f"recall_{k}") for k in ks]
    return out.select("query_id", "expected_rank", (F.col("_1") - F.col("_2")).alias("margin"), *found)


def runs(rows: DataFrame, group: str, position: str, flag: Column, least: int = 1) -> DataFrame:
    """group, start, stop (excluded), length of the runs of successive positions whose flag is true, of at least so many."""
    some = rows.filter(flag).select(group, position)
    island = F.col(position) - F.row_number().over(W.partitionBy(group).orderBy(position))
    out = some.withColumn("_i", island).groupBy(group, "_i").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop"))
    return out.select(group, "start", "stop", (F.col("stop") - F.col("start")).alias("length")).filter(F.col("length") >= least)


def clamped_box(box: Column, width: Column, height: Column) -> Column:
    """left, top, right, bottom inside the image, of a pixel at least."""
    left = F.least(F.greatest(box["left"], F.lit(0)), width - 1)
    top = F.least(F.greatest(box["top"], F.lit(0)), height - 1)
    right = F.least(F.greatest(box["right"], left + 1), width)
    bottom = F.least(F.greatest(box["bottom"], top + 1), height)
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """clamped_box; null where a side has less than LEAST_SIDE pixels."""
    own = clamped_box(box, width, height)
    return F.when((own["right"] - own["left"] >= LEAST_SIDE) & (own["bottom"] - own["top"] >= LEAST_SIDE), own)


def isolates(box: Column, width: Column, height: Column) -> Column:
    """Whether the box is less than WHOLE_SHARE of the image."""
    return (box["right"] - box["left"]) * (box["bottom"] - box["top"]) < WHOLE_SHARE * width * height


def attach_candidates(decided: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches with their candidate's score and view; a winner that isn't among the candidates gets a row without them.

    decided: request_id, status, model. candidates: request_id, model, score, image_type.
    """
    out = decided.join(candidates, ["request_id", "model"], "left")
    return out.withColumn("synthesized", (F.col("status") == "match") & F.col("score").isNull())


def verifier_requests(candidates: DataFrame, images: DataFrame, n: int = 10) -> DataFrame:
    """request_id, slots: of each of the first n candidates by rank its model and views in order (main where none is known), as a nested request.

    candidates: request_id, rank, model.
    """
    some = candidates.filter(F.col("rank") <= n).join(ordered_views(images), "model", "left")
    slot = F.struct("rank", "model", F.coalesce("views", F.array(F.lit("main"))).alias("views"))
    return some.groupBy("request_id").agg(F.sort_array(F.collect_list(slot)).alias("slots"))


def hit_lines(hits: DataFrame) -> DataFrame:
    """query_id, rank, line: a hit as a row of a report."""
    return hits.select("query_id", "rank", F.format_string("%3d  %-16s %-5s %.4f", "rank", "model", "image_type", "similarity").alias("line"))


def image_table(hits: DataFrame) -> DataFrame:
    """query_id, rank (0: the head), line: hits of images as a table of text."""
    head = hits.select("query_id").distinct().select("query_id", F.lit(0).alias("rank"), F.lit("rank | model | image_type | similarity").alias("line"))
    line = F.format_string("%d | %s | %s | %.6f", "rank", "model", "image_type", "similarity")
    return head.unionByName(hits.select("query_id", F.col("rank").cast("int"), line.alias("line")))


def model_table(hits: DataFrame) -> DataFrame:
    """query_id, rank (0: the head), line: hits of models as a table of text. hits: query_id, rank, model, model_score, best_image_type."""
    head = hits.select("query_id").distinct().select("query_id", F.lit(0).alias("rank"), F.lit("rank | model | model_score | best_image_type | best_image_similarity").alias("line"))
    line = F.format_string("%d | %s | %.6f | %s | %.6f", "rank", "model", "model_score", "best_image_type", "model_score")
    return head.unionByName(hits.select("query_id", F.col("rank").cast("int"), line.alias("line")))


def hits_json(images: DataFrame, models: DataFrame) -> DataFrame:
    """query_id, json: {"images": [...], "models": [...]} of each query, in order of rank; a list may be empty."""
    image = F.struct("rank", "model", "image_type", "similarity")
    model = F.struct("rank", "model", "model_score", "best_image_type", F.col("model_score").alias("best_image_similarity"))
    a = images.groupBy("query_id").agg(F.sort_array(F.collect_list(image)).alias("images"))
    b = models.groupBy("query_id").agg(F.sort_array(F.collect_list(model)).alias("models"))
    out = a.join(b, "query_id", "full")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("query_id", F.to_json(F.struct(empty("images"), empty("models"))).alias("json"))


def model_status(asked: DataFrame, catalog: DataFrame, missing: Column, order: str = "model_id") -> DataFrame:
    """model, vector_generated, missing: of each asked model whether it has a vector, and what it lacks, not_in_catalog for unknown ones.

    missing: of a catalog row the names of what it lacks. Of several rows of a model the last by order counts; models asked twice have a row each.
    """
    last = last_rows(catalog.withColumn("_lacks", missing), ["model"], [order]).select("model", "visual", "_lacks", F.lit(True).alias("_there"))
    found = asked.select("model").join(last, "model", "left")
    return found.select("model", F.col("visual").isNotNull().alias("vector_generated"), F.when(F.col("_there"), F.col("_lacks")).otherwise(F.array(F.lit("not_in_catalog"))).alias("missing"))


def in_sequence(*parts: DataFrame) -> DataFrame:
    """All rows of the tables, with part (from 0): the order that vocabularies are read in."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, df in enumerate(parts[1:], 1):
        out = out.unionByName(df.withColumn("part", F.lit(i)), allowMissingColumns=True)
    return out


def customer_number(value: Column) -> Column:
    """A customer id of digits alone as a number; anything else raises."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d+$"), text.cast("long")).otherwise(F.raise_error(F.concat(F.lit("BAD_CUSTOMER_ID "), F.coalesce(text, F.lit("")))).cast("long"))


def self_test(spec: Column, kinds: Sequence[str] = VIEW_ORDER[:-1]) -> Column:
    """MODEL/TYPE as a struct of model and image_type; null where a part is blank or the type unknown."""
    model, kind = F.trim(F.substring_index(spec, "/", 1)), F.lower(F.trim(F.substring_index(spec, "/", -1)))
    return F.when(F.contains(spec, F.lit("/")) & (model != "") & kind.isin(*kinds), F.struct(model.alias("model"), kind.alias("image_type")))


def json_safe(df: DataFrame) -> DataFrame:
    """df with NaN and infinite numbers as nulls and moments as ISO texts."""
    def safe(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name) if kind.startswith("timestamp") else F.date_format(c, "yyyy-MM-dd").alias(name) if kind == "date" else c

    return df.select(*[safe(n, k) for n, k in df.dtypes])
