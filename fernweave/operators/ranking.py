"""Scores of customers against models, and rankings both ways."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import importable
from ..sources.shared import kept
from .calibration import Calibrator

#: Rows of a block of customers and of models, at most: a task holds one of each.
CUSTOMERS, MODELS, LEAST = 20_000, 10_000, 250
#: Numbers of a tile of the product of two blocks, 16 MB of doubles: all that a task holds of it at a time.
TILE = 2 << 20
#: Groups in which a ranking's pairs are cut to k before they meet, where they come from more blocks than that.
LANES = 64
PAIR = "ranking int, customer_id string, model string, score double, similarity double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=float).reshape(len(column), -1)


def _blocks(rows: DataFrame, most: int) -> int:
    """As many blocks as keep each below most rows, more where tasks would idle."""
    n = rows.count()
    return max(1, -(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST))


def blocks_of(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    return _blocks(left, CUSTOMERS), max(1, -(-right.count() // MODELS))


def tiles(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows so that each slice's product with the columns has TILE numbers at most."""
    step = max(1, TILE // max(1, columns))
    for at in range(0, rows, step):
        yield slice(at, min(rows, at + step))


def by_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str, blocks: tuple[int, int] | None = None) -> DataFrame:
    """make of each block of left rows and each block of right ones, inside executors; rows reach it in order of their ids.

    Both sides are kept first, so what made them runs once and their rows are counted from the files. Blocks are hash
    ranges of the ids. Each row is sent once for every block of the other side, and nothing is held by the driver
    but the two counts. blocks: how many there are of each side, if that is known.
    """
    importable(left.sparkSession)
    left, right = kept(left), kept(right)
    n, m = blocks or blocks_of(left, right)
    a = left.withColumn("_l", F.pmod(F.xxhash64(left_id), F.lit(n))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    b = right.withColumn("_r", F.pmod(F.xxhash64(right_id), F.lit(m))).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))

    def block(x: pa.Table, y: pa.Table) -> pa.Table:
        return make(x.sort_by(left_id), y.sort_by(right_id))

    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r")).applyInArrow(block, schema)


def top_of_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k largest scores of each column; of equal ones the first rows. NaN counts as least."""
    if len(scores) <= k:
        return np.ones(scores.shape, bool)
    scores = np.where(np.isnan(scores), -np.inf, scores)
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    above, equal = scores > least, scores == least
    return above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))


def best_of_rows(x: np.ndarray, y: np.ndarray, k: int, value: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """rows, columns, values and products of the k best columns of each row of x y', by value of the product."""
    out = []
    for part in tiles(len(x), len(y)):
        dots = x[part] @ y.T
        worth = dots if value is None else value(dots)
        rows, columns = np.nonzero(top_of_columns(worth.T, k).T)
        out.append((part.start + rows, columns, worth[rows, columns], dots[rows, columns]))
    return tuple(np.concatenate(c) for c in zip(*out))


#: Pairs whose products are summed at a time.
PAIRS = 1 << 15


def products(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The product of each pair, summed in the same way wherever the pair stands, so that equal vectors have equal ones: those of x y' may differ in their last bits."""
    parts = [np.einsum("ij,ij->i", x[rows[at : at + PAIRS]], y[columns[at : at + PAIRS]]) for at in range(0, len(rows), PAIRS)]
    return np.concatenate([np.zeros(0), *parts])


class Best:
    """The k best rows of each column over slices of the product x y', by value of the product; of equal ones the first rows. NaN counts as least.

    Once a column has k rows, only what may be above the least of them is looked at: it is found by one comparison with the
    slice, gets its product by itself, and is gathered until it is as much as what is held.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, curve: Calibrator | None = None) -> None:
        self.x, self.y, self.columns, self.k = x, y, len(y), k
        self.up_to, self.values = (lambda v: v, lambda v: v) if curve is None else (curve.up_to, curve.values)
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.least: np.ndarray | None = None  # of each column: what isn't above it can't be among the best
        long = np.linalg.norm(x, axis=1)
        #: What a product of the slice may differ from the pair's own.
        self.off = 1e-15 * (x.shape[1] + 8) * long[np.isfinite(long)].max(initial=0.0) * np.nan_to_num(np.linalg.norm(y, axis=1), posinf=0.0)

    def add(self, start: int, dots: np.ndarray, among: np.ndarray) -> None:
        """Takes a slice whose rows begin at start; among: which of them take part."""
        if self.least is None:
            own = np.flatnonzero(among)
            worth, more = self.values(dots[own]), self.values(dots[own] + self.off)
            best = top_of_columns(worth, self.k)
            least = np.where(best & ~np.isnan(worth), worth, np.inf).min(axis=0, initial=np.inf)
            rows, columns = np.nonzero(best | (more > least) | ((worth < least) & (more >= least)))
            rows = own[rows]
        else:
            rows, columns = np.divmod(np.flatnonzero(~(dots <= self.least) & among[:, None]), self.columns)
        found = products(self.x, self.y, start + rows, columns)
        self.new.append((start + rows, columns, self.values(found), found))
        if sum(len(x[0]) for x in self.new) >= self.k * self.columns:
            self.cut()

    def cut(self) -> None:
        rows, columns, worth, dots = (np.concatenate(c) for c in zip(self.held, *self.new))
        # within a column what is held stands first, and all in order of the rows
        order = np.argsort(columns.astype(np.uint16) if self.columns <= 1 << 16 else columns, kind="stable")
        rows, columns, worth, dots = rows[order], columns[order], worth[order], dots[order]
        count = np.bincount(columns, minlength=self.columns)
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        table = np.full((count.max(initial=0), self.columns), -np.inf, order="F")
        table[turn, columns] = worth
        kept = top_of_columns(table, self.k)[turn, columns]
        self.held, self.new = (rows[kept], columns[kept], worth[kept], dots[kept]), []
        if count.min(initial=self.k) >= self.k:
            least = np.where(np.isnan(self.held[2]), -np.inf, self.held[2]).reshape(self.columns, self.k).min(axis=1)
            self.least = self.up_to(least) - self.off

    def result(self) -> tuple[np.ndarray, ...]:
        """rows, columns, values and products."""
        self.cut()
        return self.held


def best_of_columns(x: np.ndarray, y: np.ndarray, k: int, rankings: Sequence[tuple[np.ndarray, Calibrator | None]]) -> list[tuple[np.ndarray, ...]]:
    """For each ranking, which is a mask of the rows and a curve or none: rows, columns, values and products of the k best rows of each column of x y'."""
    best = [Best(x, y, k, curve) for _, curve in rankings]
    for part in tiles(len(x), len(y)):
        dots = x[part] @ y.T
        for b, (among, _) in zip(best, rankings):
            b.add(part.start, dots, among[part])
    return [b.result() for b in best]


def _pairs(x: pa.Table, y: pa.Table, found: Sequence[tuple[np.ndarray, ...]]) -> pa.Table:
    rankings = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found])
    rows, cols, worth, dots = (np.concatenate(c) for c in zip(*found))
    return pa.table({"ranking": rankings, "customer_id": x["customer_id"].take(pa.array(rows)), "model": y["model"].take(pa.array(cols)), "score": worth, "similarity": dots})


NO_PAIRS = pa.schema([("ranking", pa.int32()), ("customer_id", pa.string()), ("model", pa.string()), ("score", pa.float64()), ("similarity", pa.float64())])


def _ranked(pairs: DataFrame, group: Sequence[str], other: str, name: str, k: int, blocks: int) -> DataFrame:
    """The k best pairs of each group. Of many blocks first those of each lane of it, then of what the lanes leave."""
    order = [F.desc("score"), F.col(other)]
    if blocks > LANES:
        lane = F.pmod(F.xxhash64(other), F.lit(LANES))
        pairs = pairs.withColumn("_lane", lane).withColumn("_turn", F.row_number().over(W.partitionBy(*group, "_lane").orderBy(*order))).filter(F.col("_turn") <= k).drop("_lane", "_turn")
    return pairs.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def rankings(customers: DataFrame, models: DataFrame, k: int, curves: Sequence[Calibrator | None]) -> DataFrame:
    """ranking, model, customer_rank, customer_id, score, similarity: the best k customers of each model in several rankings, ties by customer_id.

    customers: customer_id, vector, among: an array that tells of each ranking whether the customer takes part. score: the
    value of the ranking's curve, by which it ranks, or without one the similarity. The similarities are computed once for all
    rankings, and each block of customers sends k pairs a model and ranking at most, and not a row for each pair.
    """

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return NO_PAIRS.empty_table()
        among = _matrix(x["among"]).astype(bool).T
        return _pairs(x, y, best_of_columns(_matrix(x["vector"]), _matrix(y["vector"]), k, list(zip(among, curves))))

    vector = F.col("vector").cast("array<double>").alias("vector")
    left, right = kept(customers.select("customer_id", vector, "among")), kept(models.select("model", vector))
    blocks = blocks_of(left, right)
    pairs = by_blocks(left, right, "customer_id", "model", score, PAIR, blocks)
    return _ranked(pairs, ["ranking", "model"], "customer_id", "customer_rank", k, blocks[0])


def rank_customers(customers: DataFrame, models: DataFrame, k: int = 100) -> DataFrame:
    """model, customer_rank, customer_id, score: the best k customers of each model, ties by customer_id."""
    every = customers.select("customer_id", "vector", F.array(F.lit(True)).alias("among"))
    return rankings(every, models, k, [None]).select("model", "customer_rank", "customer_id", "score")


def rank_models(customers: DataFrame, models: DataFrame, k: int = 6) -> DataFrame:
    """customer_id, rank_for_customer, model, score: the best k models of each customer, ties by model."""

    def score(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return NO_PAIRS.empty_table()
        return _pairs(x, y, [best_of_rows(_matrix(x["vector"]), _matrix(y["vector"]), k)])

    vector = F.col("vector").cast("array<double>").alias("vector")
    left, right = kept(customers.select("customer_id", vector)), kept(models.select("model", vector))
    blocks = blocks_of(left, right)
    pairs = by_blocks(left, right, "customer_id", "model", score, PAIR, blocks)
    return _ranked(pairs, ["customer_id"], "model", "rank_for_customer", k, blocks[1]).select("customer_id", "rank_for_customer", "model", "score")


def target_ranks(customers: DataFrame, models: DataFrame) -> DataFrame:
    """customer_id, rank of the customer's target among all models: 1 + those that score more, or as much at an earlier position.

    customers: customer_id, vector, target, target_position, target_vector. models: model, position, vector. A row of
    counts a customer and block of models leaves the tasks, never one a pair.
    """

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"customer_id": x["customer_id"], "ahead": pa.array(np.zeros(x.num_rows, np.int64))})
        vectors, among = _matrix(x["vector"]), _matrix(y["vector"])
        own = np.einsum("ij,ij->i", vectors, _matrix(x["target_vector"]))[:, None]
        place, position, codes = x["target_position"].to_numpy()[:, None], y["position"].to_numpy()[None, :], np.array(y["model"].to_pylist())[None, :]
        target, ahead = np.array(x["target"].to_pylist())[:, None], np.zeros(len(vectors), np.int64)
        for part in tiles(len(vectors), len(among)):
            scores = vectors[part] @ among.T
            first = (scores > own[part]) | ((scores == own[part]) & (position < place[part]))
            ahead[part] = (first & (codes != target[part])).sum(axis=1)
        return pa.table({"customer_id": x["customer_id"], "ahead": ahead})

    asked = customers.select("customer_id", F.col("vector").cast("array<double>"), "target", F.col("target_position").cast("long"), F.col("target_vector").cast("array<double>"))
    among = models.select("model", F.col("position").cast("long"), F.col("vector").cast("array<double>"))
    return by_blocks(asked, among, "customer_id", "model", count, "customer_id string, ahead long").groupBy("customer_id").agg((1 + F.sum("ahead")).alias("rank"))


def eligible(customers: DataFrame, as_of: str) -> DataFrame:
    """Customers, without the anonymous one, whose last purchase is RECENT_DAYS old or of unknown date; with days."""
    days = S.days_since(F.col("last_purchase_date"), F.lit(as_of).cast("date"))
    return customers.withColumn("days", days).filter(~S.is_recent(F.col("days")) & (F.col("customer_id") != S.ANONYMOUS_CUSTOMER))


def rank_eligible(customers: DataFrame, models: DataFrame, as_of: str, k: int = 100, curve: Calibrator | None = None) -> DataFrame:
    """model, customer_rank, customer_id, score, similarity: the best k eligible customers of each model, ties by customer_id.

    customers: customer_id, vector, last_purchase_date. score is the curve's value of the similarity, by which they are
    ranked, or without a curve the similarity. Recent buyers go before the ranking, so that k are left.
    """
    some = eligible(customers, as_of).select("customer_id", "vector", F.array(F.lit(True)).alias("among"))
    return rankings(some, models, k, [curve]).select("model", "customer_rank", "customer_id", "score", "similarity")


def rank_both(customers: DataFrame, models: DataFrame, as_of: str, k: int, curve: Calibrator) -> DataFrame:
    """ranking (similarity, like_score), model, customer_rank, customer_id, score: rank_customers, and rank_eligible by the curve, from the same similarities.

    customers: as in rank_eligible.
    """
    some = eligible(customers, as_of).select("customer_id", F.lit(True).alias("_some"))
    every = customers.select("customer_id", "vector").join(some, "customer_id", "left")
    among = F.array(F.lit(True), F.coalesce("_some", F.lit(False))).alias("among")
    name = F.when(F.col("ranking") == 0, "similarity").otherwise("like_score").alias("ranking")
    return rankings(every.select("customer_id", "vector", among), models, k, [None, curve]).select(name, "model", "customer_rank", "customer_id", "score")


def diagnostics(customers: DataFrame, ranked: DataFrame, as_of: str) -> DataFrame:
    """Of each ranked model: total_scored, excluded_recent, eligible, returned, and of the returned how many by days since the last purchase."""
    days = S.days_since(F.col("last_purchase_date"), F.lit(as_of).cast("date"))
    aged = customers.select("customer_id", days.alias("days"))
    recent, anonymous = S.is_recent(F.col("days")), F.col("customer_id") == S.ANONYMOUS_CUSTOMER
    totals = aged.agg(F.count(F.lit(1)).alias("total_scored"), F.count_if(recent).alias("excluded_recent"), F.count_if(~recent & ~anonymous).alias("eligible"))
    bucket = S.recency_bucket(F.col("days"))
    counts = [F.count_if(bucket == label).alias(name) for name, label in BUCKETS.items()]
    per = ranked.join(aged, "customer_id").groupBy("model").agg(F.count(F.lit(1)).alias("returned"), *counts)
    return per.join(F.broadcast(totals)).select("model", "total_scored", "excluded_recent", "eligible", "returned", *BUCKETS)


#: Columns of the distribution and the buckets' labels.
BUCKETS = {"from_60": "60-180d", "from_181": "181-365d", "from_1y": "1-3y", "from_3y": "3y+", "undated": "unknown"}


def score_comparison(both: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    """model, ranking (similarity, like_score), results, how many customers by age, and the scores' average, median, least, 10 % and 90 % points.

    both: of rank_both.
    """
    aged = customers.select("customer_id", S.recency_bucket(S.days_since(F.col("last_purchase_date"), F.lit(as_of).cast("date"))).alias("bucket"))
    s = F.col("score")
    return both.join(aged, "customer_id").groupBy("model", "ranking").agg(
        F.count(F.lit(1)).alias("results"),
        *[F.count_if(F.col("bucket") == label).alias(name) for name, label in BUCKETS.items() if name != "undated"],
        F.avg(s).alias("average"), F.median(s).alias("median"), F.min(s).alias("least"), F.percentile(s, F.lit(0.1)).alias("p10"), F.percentile(s, F.lit(0.9)).alias("p90"),
    )


MOST_ASKED = 200


def recommend(customers: DataFrame, catalog: DataFrame, model: str, curve: Calibrator, as_of: str, limit: int | None = 100) -> DataFrame:
    """customer_rank, customer_id, like_score (four places), similarity: the customers for one model of the catalog (model, visual).

    limit: none is 100, above MOST_ASKED is MOST_ASKED, below 1 is an error.
    """
    limit = 100 if limit is None else limit
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    limit = min(limit, MOST_ASKED)
    known = catalog.filter(F.col("model") == model).select("model", F.col("visual").alias("vector")).limit(2).collect()
    if not known:
        raise KeyError(f"unknown model {model}")
    if known[0].vector is None:
        raise ValueError(f"model {model} has no vector")
    one = catalog.filter((F.col("model") == model) & F.col("visual").isNotNull()).select("model", F.col("visual").alias("vector"))
    ranked = rank_eligible(customers, one, as_of, limit, curve)
    return ranked.select("customer_rank", "customer_id", F.round("score", 4).alias("like_score"), "similarity")


def enrich(ranked: DataFrame, current: DataFrame) -> DataFrame:
    """A ranking with the columns of its report."""
    known = current.select("customer_id", "customer_name", "history_length", "last_purchase_date", "preferred_size", "last_purchased_size")
    return ranked.join(known, "customer_id", "left").select("model", "customer_rank", "customer_id", "customer_name", "score", "history_length", "last_purchase_date", "preferred_size", "last_purchased_size")


def ids_within(n: int) -> Column:
    ranked = F.collect_list(F.when(F.col("customer_rank") <= n, F.struct("customer_rank", "customer_id")))
    return F.transform(F.sort_array(ranked), lambda x: x["customer_id"])


def model_summary(ranked: DataFrame) -> DataFrame:
    """Of each model: its best 10, 25 and 50 customers, and the largest, median and least score of the best 50."""
    top = F.when(F.col("customer_rank") <= 50, F.col("score"))
    return ranked.groupBy("model").agg(
        ids_within(10).alias("top_10"), ids_within(25).alias("top_25"), ids_within(50).alias("top_50"),
        F.max(top).alias("score_max"), F.median(top).alias("score_median"), F.min(top).alias("score_min"),
    )


def overlap(ranked: DataFrame, n: int = 25) -> DataFrame:
    """One row: customers among the best n of any model, models a customer on average and at most, and who has most (the smallest id)."""
    per = ranked.filter(F.col("customer_rank") <= n).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("n"), F.col("customer_id").alias("id")))
    return per.agg(
        F.count(F.lit(1)).alias("unique_customers"),
        (F.sum("n") / F.count(F.lit(1))).alias("average_models"),
        F.max("n").alias("most_models"),
        most["id"].alias("most_repeated"),
    )


def score_summary(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: count, the four quarters of 0..1, average, median, least, 10 % and 90 % points (interpolated)."""
    s = F.col(column)
    return scores.agg(
        F.count(s).alias("n"),
        F.count_if(s < 0.25).alias("below_25"), F.count_if((s >= 0.25) & (s < 0.5)).alias("below_50"),
        F.count_if((s >= 0.5) & (s < 0.75)).alias("below_75"), F.count_if(s >= 0.75).alias("from_75"),
        F.avg(s).alias("average"), F.median(s).alias("median"), F.min(s).alias("least"),
        F.percentile(s, F.lit(0.1)).alias("p10"), F.percentile(s, F.lit(0.9)).alias("p90"),
    )


def violations(ranked: DataFrame, histories: DataFrame | None = None, new_models: list[str] | None = None, models: DataFrame | None = None) -> DataFrame:
    """model, problem: ranks that don't run from 1, rising scores, repeated or anonymous customers, models without a ranking,
    new models in histories. None is right."""
    order = W.partitionBy("model").orderBy("customer_rank")
    checked = ranked.withColumns({"_next": F.lead("score").over(order), "_rank": F.row_number().over(order), "_twice": F.count(F.lit(1)).over(W.partitionBy("model", "customer_id"))})
    problems = F.array_compact(
        F.array(
            F.when(F.col("customer_rank") != F.col("_rank"), "rank"),
            F.when(F.col("_next") > F.col("score"), "order"),
            F.when(F.col("_twice") > 1, "repeated"),
            F.when(F.col("customer_id") == S.ANONYMOUS_CUSTOMER, "anonymous"),
        )
    )
    out = checked.select("model", F.explode(problems).alias("problem")).distinct()
    if models is not None:
        out = out.unionByName(models.select("model").distinct().join(ranked, "model", "left_anti").select("model", F.lit("absent").alias("problem")))
    if histories is not None and new_models:
        leaked = histories.filter(F.arrays_overlap("history", F.array(*map(F.lit, new_models))))
        out = out.unionByName(leaked.select(F.lit(None).cast("string").alias("model"), F.lit("history").alias("problem")).distinct())
    return out
