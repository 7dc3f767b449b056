"""Retrieval: images by view, models by their best view, text candidates, memory cases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..session import importable
from ..sources.shared import kept
from ..sources.snapshots import last_rows
from .ranking import _matrix, best_of_rows, by_blocks, rank_models, tiles, top_of_columns


def unpivot_views(catalog: DataFrame) -> DataFrame:
    """A row for each model and view that has a vector. catalog: model, model_id, main, pers, side."""
    views = F.array(*[F.struct(F.lit(t).alias("image_type"), F.col(t).alias("embedding")) for t in S.IMAGE_TYPES])
    rows = catalog.filter(F.trim("model") != "").select(F.trim("model").alias("model"), "model_id", F.inline(views))
    return rows.withColumn("embedding", V.valid_vector(F.col("embedding"))).filter("embedding is not null")


def clean_images(rows: DataFrame, base_url: str, dimension: int) -> DataFrame:
    """Catalog image records: lower-case views, default dimension and address, without blank models and bad vectors."""
    kept = rows.withColumns({"model": F.trim("model"), "image_type": F.lower(F.trim("image_type")), "embedding": V.valid_vector(F.col("embedding"))})
    kept = kept.filter((F.col("model") != "") & F.col("image_type").isin(*S.IMAGE_TYPES) & F.col("embedding").isNotNull())
    url = F.coalesce(F.nullif("source_url", F.lit("")), S.image_url(base_url, F.col("model"), F.col("image_type")))
    return kept.withColumns({"embedding_dimension": F.coalesce("embedding_dimension", F.lit(dimension)), "source_url": url})


def top(rows: DataFrame, group: Sequence[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """rows with their rank in the group; k limits it, so that each task keeps k rows a group before the shuffle."""
    out = rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def _vector(name: str) -> Column:
    return F.col(name).cast("array<double>").alias("vector")


def rank_images(queries: DataFrame, images: DataFrame, k: int = 100) -> DataFrame:
    """query_id, rank, model, image_type, position, similarity: each query's best k images, ties by their position.

    queries: query_id, vector. images: model, image_type, position (distinct), embedding. Blocks of queries meet blocks
    of images inside executors, and each pair of blocks sends k rows a query.
    """

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return IMAGES.empty_table()
        rows, cols, _, dots = best_of_rows(_matrix(x["vector"]), _matrix(y["vector"]), k)
        at = pa.array(cols)
        return pa.table([x["query_id"].take(pa.array(rows)), *[y[c].take(at) for c in ("model", "image_type", "position")], pa.array(dots)], schema=IMAGES)

    among = images.select("model", "image_type", F.col("position").cast("long").alias("position"), _vector("embedding"))
    scores = by_blocks(queries.select("query_id", _vector("vector")), among, "query_id", "position", score, "query_id string, model string, image_type string, position long, similarity double")
    return top(scores, ["query_id"], [F.desc("similarity"), F.col("position")], k)


IMAGES = pa.schema([("query_id", pa.string()), ("model", pa.string()), ("image_type", pa.string()), ("position", pa.int64()), ("similarity", pa.float64())])


def rank_models_by_best(queries: DataFrame, images: DataFrame, k: int = 100) -> DataFrame:
    """query_id, rank, model, model_score, best_image_type: models by the largest similarity of a view, never the mean.

    Of equal views the first counts; ties by model, then view. Each pair of blocks sends the best view of its k best models
    a query. That is enough, wherever a model's views lie: in the block of its best view no more models can stand
    before it than among all.
    """

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return IMAGES.empty_table()
        codes, at = np.unique(np.array(y["model"].to_pylist(), object).astype(str), return_inverse=True)
        order = np.argsort(at, kind="stable")  # within a model by position
        cuts = np.searchsorted(at[order], np.arange(len(codes)))
        vectors, among, sizes = _matrix(x["vector"]), _matrix(y["vector"])[order], np.diff(np.append(cuts, len(order)))
        hits = []
        for part in tiles(len(vectors), 3 * len(among)):
            dots = vectors[part] @ among.T
            best = np.maximum.reduceat(dots, cuts, axis=1)
            firsts = np.minimum.reduceat(np.where(dots == np.repeat(best, sizes, axis=1), np.arange(len(order)), len(order)), cuts, axis=1)
            # models stand in order of their codes
            rows, models = np.nonzero(top_of_columns(best.T, k).T)
            hits.append((part.start + rows, order[firsts[rows, models]], best[rows, models]))
        rows, place, value = (np.concatenate(c) for c in zip(*hits))
        at = pa.array(place)
        return pa.table([x["query_id"].take(pa.array(rows)), *[y[c].take(at) for c in ("model", "image_type", "position")], pa.array(value)], schema=IMAGES)

    among = images.select("model", "image_type", F.col("position").cast("long").alias("position"), _vector("embedding"))
    scores = by_blocks(queries.select("query_id", _vector("vector")), among, "query_id", "position", score, "query_id string, model string, image_type string, position long, similarity double")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "position", "image_type"))
    per = scores.groupBy("query_id", "model").agg(best.alias("best"))
    per = per.select("query_id", "model", (-F.col("best.s")).alias("model_score"), F.col("best.image_type").alias("best_image_type"))
    return top(per, ["query_id"], [F.desc("model_score"), F.col("model"), F.col("best_image_type")], k)


#: Numbers of the vectors of a block of images, 64 MB of doubles, and rows that a pair of blocks gives, about.
NUMBERS, ROWS = 8 << 20, 1 << 20


def falling(scores: np.ndarray) -> np.ndarray:
    """Places of the scores from the largest on; of equal ones the first. NaN counts as largest, as in SQL."""
    keys = np.where(np.isnan(scores), -np.inf, -scores)
    order = np.argsort(keys)
    row = keys[order]
    return np.argsort(keys, kind="stable") if (row[1:] == row[:-1]).any() else order


def first_alike(vectors: np.ndarray) -> np.ndarray | None:
    """Of each row the place of the first equal one; None if all differ. Products of equal rows may differ in their last bits, by where they stand."""
    rows = np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    return first[inverse] if len(first) < len(rows) else None


def view_ranks(queries: DataFrame, targets: DataFrame, images: DataFrame) -> DataFrame:
    """query_id, model, image_type, position, similarity, rank, norm: of each target model's images how near they are, and how many images are nearer.

    queries: query_id, vector. targets: query_id, model: a few a query. images as in rank_images. Ahead of an image is who is more
    similar, or as much at an earlier position. Models without images, and targets of queries that aren't there, have no rows.

    A block of queries brings the names of its targets, never their vectors: it meets the images of one block, among which its targets
    are found, and those of one block, which are counted. Most often these are one block, and the counts are the ranks; else they
    are summed. Blocks of queries are as many as keep what a task gives near ROWS.
    """
    importable(queries.sparkSession)
    among = kept(images.select("model", "image_type", F.col("position").cast("long").alias("position"), F.col("embedding").alias("vector"), V.norm(F.col("embedding")).alias("norm")))
    wanted = targets.groupBy("query_id").agg(F.collect_set("model").alias("models"))
    asked = kept(queries.select("query_id", "vector").join(wanted, "query_id"))
    dimension = among.select(F.size("vector")).first()
    m = max(1, -(-among.count() * dimension[0] // NUMBERS)) if dimension else 1
    made = asked.select(F.explode("models").alias("model")).join(among.groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model").agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-made // ROWS), min(queries.sparkSession.sparkContext.defaultParallelism, made // (ROWS >> 6)))

    def count(key: tuple[pa.Scalar, ...], x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return AHEAD.empty_table()
        y = y.sort_by("position")
        block, (_, found_in, counted_in) = y["_b"].to_numpy(), (k.as_py() for k in key)
        counted, own = block == counted_in, np.flatnonzero(block == found_in)
        codes = y["model"].combine_chunks().take(pa.array(own)).dictionary_encode()
        indices = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
        order = np.argsort(indices, kind="stable")
        places = dict(zip(codes.dictionary.to_pylist(), np.split(own[order], np.cumsum(np.bincount(indices))[:-1])))
        vectors, others, out = _matrix(x["vector"]), _matrix(y["vector"]), []
        alike = first_alike(others)
        for part in tiles(len(vectors), len(others)):
            dots, rows, at, ahead = vectors[part] @ others.T, [], [], []
            if alike is not None:
                dots = dots[:, alike]
            for i, row in enumerate(dots):
                mine = [places[model] for model in x["models"][part.start + i].as_py() if model in places]
                if mine:
                    order, before = falling(row), np.empty(len(row), np.int64)
                    before[order] = np.cumsum(counted[order]) - counted[order]
                    at.append(np.concatenate(mine))
                    rows.append(np.full(len(at[-1]), i))
                    ahead.append(before[at[-1]])
            if rows:
                rows, at, ahead = np.concatenate(rows), np.concatenate(at), np.concatenate(ahead)
                there = pa.array(at)
                out.append(pa.table([x["query_id"].take(pa.array(part.start + rows)), *[y[c].take(there) for c in ("model", "image_type", "position")], pa.array(dots[rows, at]), y["norm"].take(there), pa.array(ahead)], schema=AHEAD))
        return pa.concat_tables(out) if out else AHEAD.empty_table()

    blocks = F.sequence(F.lit(0), F.lit(m - 1))
    pairs = F.flatten(F.transform(blocks, lambda t: F.transform(blocks, lambda r: F.struct(t.alias("_t"), r.alias("_r")))))
    met = F.filter(pairs, lambda p: (p["_t"] == F.col("_b")) | (p["_r"] == F.col("_b")))
    a = asked.withColumn("_l", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).select("*", F.inline(pairs))
    b = among.withColumn("_b", F.pmod(F.xxhash64("position"), F.lit(m)).cast("int")).select("*", F.inline(met)).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = ["_l", "_t", "_r"]
    schema = "query_id string, model string, image_type string, position long, similarity double, norm double, ahead long"
    counts = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(count, schema)
    if m > 1:
        counts = counts.groupBy("query_id", "position").agg(*[F.first(c).alias(c) for c in ("model", "image_type", "similarity", "norm")], F.sum("ahead").alias("ahead"))
    return counts.select("query_id", "model", "image_type", "position", "similarity", (1 + F.col("ahead")).alias("rank"), "norm")


AHEAD = pa.schema([("query_id", pa.string()), ("model", pa.string()), ("image_type", pa.string()), ("position", pa.int64()), ("similarity", pa.float64()), ("norm", pa.float64()), ("ahead", pa.int64())])


def rank_candidates(candidates: DataFrame, query: Column, k: int = 100) -> DataFrame:
    """id, score, rank by cosine, ties by id. Raises on blank and repeated ids, other dimensions and zero vectors."""
    ident = F.when(F.trim("id") != "", F.col("id")).otherwise(F.raise_error(F.lit("BLANK_CANDIDATE_ID")).cast("string"))
    twice = F.count(F.lit(1)).over(W.partitionBy("id")) > 1
    once = candidates.withColumn("_twice", twice).withColumn("id", F.when(F.col("_twice"), F.raise_error(F.lit("DUPLICATE_CANDIDATE_ID")).cast("string")).otherwise(F.col("id")))
    scored = once.select(ident.alias("id"), V.cosine(query, F.col("embedding")).alias("score"))
    scored = scored.orderBy(F.desc("score"), "id").limit(k)
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


#: What one request may hold.
TEXTS, CANDIDATES, TOP = 64, 5_000, 100


def check_request(texts: int = 1, candidates: int = 1, top: int = 1) -> None:
    """ValueError for a request beyond its bounds."""
    for name, n, most in (("texts", texts, TEXTS), ("candidates", candidates, CANDIDATES), ("top", top, TOP)):
        if not 1 <= n <= most:
            raise ValueError(f"{name} must be between 1 and {most}, not {n}")


def rank_for_queries(queries: DataFrame, candidates: DataFrame, k: int = 100) -> DataFrame:
    """query_id, id, score, rank: the best candidates of each query by cosine, ties by id. Both sides may be large.

    queries: query_id, vector. candidates: id, embedding. Blank and repeated ids, and zero vectors, raise as in rank_candidates.
    """
    unit = lambda c: F.coalesce(V.l2_normalize(F.col(c)), F.raise_error(F.lit("ZERO_VECTOR")).cast("array<double>")).alias("vector")
    twice = F.count(F.lit(1)).over(W.partitionBy("id")) > 1
    wrong = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "BLANK_CANDIDATE_ID").when(F.col("_twice"), "DUPLICATE_CANDIDATE_ID")
    ident = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("id"))
    once = candidates.withColumn("_twice", twice).select(ident.alias("model"), unit("embedding"))
    found = rank_models(queries.select(F.col("query_id").alias("customer_id"), unit("vector")), once, k)
    return found.select(F.col("customer_id").alias("query_id"), F.col("model").alias("id"), "score", F.col("rank_for_customer").alias("rank"))


def load_catalog(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """The rows of a catalog, of several ones of a model and view the last by order; blank models go."""
    return last_rows(rows.filter(F.coalesce(F.trim("model"), F.lit("")) != "").withColumn("model", F.trim("model")), ["model", "image_type"], [order])


def repeated_ids(candidates: DataFrame) -> DataFrame:
    """Ids that more than one candidate has: such a request is wrong."""
    return candidates.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def memory_search(
    cases: DataFrame,
    queries: DataFrame,
    mode: str = "recognition",
    role: str = "customer_success",
    k: int = 5,
    exclude: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """query_id, case_key, score, rank: cases by cosine times review weight, ties by case_key.

    cases: case_key, role_id, review_status, recognition_text, case_text, case_summary, recognition_vector, case_vector
    and the columns of exclude (column: values that are left out). A blank role is the default one; a case needs a text
    for the mode, or a summary. A zero case vector scores -1 before the weight; a zero query finds nothing.
    """
    text = {"recognition": "recognition_text", "case": "case_text"}[mode]
    vector = {"recognition": "recognition_vector", "case": "case_vector"}[mode]
    kept = cases.filter(F.coalesce(F.nullif(F.trim("role_id"), F.lit("")), F.lit("customer_success")) == role)
    kept = kept.filter(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.nullif(F.trim("case_summary"), F.lit(""))).isNotNull())
    for column, values in (exclude or {}).items():
        if values := [v for v in values if v.strip()]:
            kept = kept.filter(~F.coalesce(F.col(column), F.lit("")).isin(values))
    weight = S.review_weight(F.coalesce("review_status", F.lit("")))
    size = V.norm(F.col(vector))
    # one more place, which is 1 in queries: a zero case vector scores -1
    whole = F.when(size == 0, F.concat(F.transform(vector, lambda x: F.lit(0.0)), F.array(-weight))).otherwise(F.concat(F.transform(vector, lambda x: x.cast("double") / size * weight), F.array(F.lit(0.0))))
    asked = queries.select(F.col("query_id").alias("customer_id"), V.l2_normalize(F.col("vector")).alias("_q")).filter("_q is not null")
    asked = asked.select("customer_id", F.concat("_q", F.array(F.lit(1.0))).alias("vector"))
    found = rank_models(asked, kept.select(F.col("case_key").alias("model"), whole.alias("vector")), max(1, k))
    return found.select(F.col("customer_id").alias("query_id"), F.col("model").alias("case_key"), "score", F.col("rank_for_customer").alias("rank"))


def failure_class(self_test_ok: Column, expected_best: Column, compare_best: Column, expected: Column, compare: Column, production: Column) -> Column:
    """B: the stored vector doesn't find itself. A: the search lost the better view. ok or C: right or other model first."""
    better = expected_best > F.coalesce(compare_best, F.lit(float("-inf")))
    return (
        F.when(self_test_ok == F.lit(False), "B")
        .when(F.coalesce(better & (production == compare), F.lit(False)), "A")
        .when(F.coalesce(production == expected, F.lit(False)), "ok")
        .otherwise("C")
    )
