"""Metrics of rankings and retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import rank_models_by_best


def recall(rank: Column, k: int) -> Column:
    """Missing ranks are misses."""
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def ranking_metrics(ranks: DataFrame, ks: Sequence[int] = (5, 10, 20), column: str = "rank") -> DataFrame:
    """One row: recall at each k, ndcg_10, mrr, hit_rate (recall at 10), examples; zeros for no examples."""
    r = F.col(column)
    gain = F.when(r <= 10, 1 / F.log2(r + 1)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ranks.agg(
        *[zero(recall(r, k)).alias(f"recall_{k}") for k in ks],
        zero(F.avg(gain)).alias("ndcg_10"),
        zero(F.avg(1 / r)).alias("mrr"),
        zero(recall(r, 10)).alias("hit_rate"),
        F.count(F.lit(1)).alias("examples"),
    )


def target_ranks(scores: DataFrame) -> DataFrame:
    """query_id, rank of the target among all candidates: 1 + those that score more, or as much at an earlier position.

    scores: query_id, position, score, is_target. No sort: the target's score meets the others' by query.
    """
    target = scores.filter("is_target").select("query_id", F.col("score").alias("_s"), F.col("position").alias("_p"))
    ahead = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("position") < F.col("_p")))
    return scores.join(target, "query_id").groupBy("query_id").agg((1 + F.count_if(ahead)).alias("rank"))


def retrieval_metrics(found: DataFrame, expected: DataFrame) -> DataFrame:
    """mode (null: all), queries, hit_1, hit_3, recall_5. found: query_id, case_key, rank. expected: query_id, mode, keys.

    A query that expects nothing has recall 1.
    """
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "case_key"))).alias("hits"))
    joined = expected.join(lists, "query_id", "left")
    keys = F.transform(F.coalesce("hits", F.array().cast("array<struct<rank:int,case_key:string>>")), lambda h: h["case_key"])

    def within(n: int) -> Column:
        return F.array_intersect(F.slice(keys, 1, n), F.col("keys"))

    per = joined.select(
        "mode",
        F.when(F.size(within(1)) > 0, 1.0).otherwise(0.0).alias("h1"),
        F.when(F.size(within(3)) > 0, 1.0).otherwise(0.0).alias("h3"),
        F.when(F.size("keys") == 0, 1.0).otherwise(F.size(within(5)) / F.greatest(F.size("keys"), F.lit(1))).alias("r5"),
    )
    return per.cube("mode").agg(F.count(F.lit(1)).alias("queries"), F.avg("h1").alias("hit_1"), F.avg("h3").alias("hit_3"), F.avg("r5").alias("recall_5"))


def paired_ranks(cases: DataFrame, images: DataFrame, top: int = 10) -> DataFrame:
    """case_id, kind, expected, and of both queries top1, rank (null beyond top) and margin (of the best two models).

    cases: case_id, kind, expected, original, isolated (vectors; a null one finds nothing). images: model, image_type, position, embedding. Both
    queries of all cases go through the images in one pass.
    """
    asked = cases.select("case_id", F.explode(F.array(F.struct(F.lit("original").alias("way"), F.col("original").alias("vector")), F.struct(F.lit("isolated").alias("way"), F.col("isolated").alias("vector")))).alias("q"))
    asked = asked.select(F.concat_ws("|", "case_id", "q.way").alias("query_id"), "case_id", "q.way", "q.vector").filter("vector is not null")
    found = rank_models_by_best(asked.select("query_id", "vector"), images, top)
    found = found.withColumns({"case_id": F.regexp_extract("query_id", r"(?s)^(.*)\|", 1), "way": F.substring_index("query_id", "|", -1)})
    met = cases.select("case_id", "kind", "expected").join(found, "case_id", "left")

    def of(way: str) -> list[Column]:
        own = F.col("way") == way
        score = lambda r: F.max(F.when(own & (F.col("rank") == r), F.col("model_score")))
        return [
            F.max(F.when(own & (F.col("rank") == 1), F.col("model"))).alias(f"{way}_top1"),
            F.min(F.when(own & (F.col("model") == F.col("expected")), F.col("rank"))).alias(f"{way}_rank"),
            (score(1) - score(2)).alias(f"{way}_margin"),
        ]

    return met.groupBy("case_id", "kind", "expected").agg(*of("original"), *of("isolated"))


def benchmark_verdict(paired: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One row: cases, recalls of both ways at each k, and whether a reranker is not_required or warranted.

    It isn't required if every screenshot and packshot is found first when isolated, and isolated recall at 1 is no less than the original's.
    """
    share = lambda way, k: F.coalesce(F.avg(F.when(F.col(f"{way}_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0))
    ways = ("original", "isolated")
    missed = F.count_if(F.col("kind").isin("screenshot", "packshot") & ~F.coalesce(F.col("isolated_rank") == 1, F.lit(False)))
    one = paired.agg(F.count(F.lit(1)).alias("cases"), *[share(w, k).alias(f"{w}_recall_{k}") for w in ways for k in ks], missed.alias("_missed"))
    good = (F.col("_missed") == 0) & (F.col(f"isolated_recall_{ks[0]}") >= F.col(f"original_recall_{ks[0]}"))
    return one.withColumn("verdict", F.when(good, "not_required").otherwise("warranted")).drop("_missed")


def decision_metrics(results: DataFrame) -> DataFrame:
    """One row: precision among matches, coverage. results: expected, predicted (null: undecided)."""
    made = F.col("predicted").isNotNull()
    right = made & (F.col("predicted") == F.col("expected"))
    return results.agg(F.try_divide(F.count_if(right), F.count_if(made)).alias("precision"), F.try_divide(F.count_if(made), F.count(F.lit(1))).alias("coverage"))


def confusion(results: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """expected by predicted."""
    return results.groupBy("expected").pivot("predicted", list(kinds)).count().fillna(0)


def smallest_good(results: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: the smallest dimension whose recall_10 is within the tolerance of the best. results: dimension, recall_10."""
    best = results.agg(F.max("recall_10").alias("_best"))
    return results.join(F.broadcast(best), F.col("recall_10") >= F.col("_best") - tolerance).agg(F.min("dimension").alias("dimension"))
