"""Functions on vectors: arrays of floats, computed in double."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 1e-3


def parse_vector(value: Column) -> Column:
    """A vector from JSON text, nested lists one after the other; null for what isn't a list of finite numbers, and for an empty list."""
    flat = valid_vector(F.from_json(F.trim(value), "array<float>"))
    return F.coalesce(flat, valid_vector(F.flatten(F.from_json(F.trim(value), "array<array<float>>"))))


def valid_vector(value: Column) -> Column:
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(value) > 0) & ~bad, value)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: inside lambdas, and when filters are pushed through projections, plain
    references are replaced by the whole expression."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    """Null for vectors of different sizes."""
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Raises VECTOR_DIMENSION_MISMATCH and ZERO_VECTOR."""
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("VECTOR_DIMENSION_MISMATCH")).cast("double"))
        .when((norm(a) == 0) | (norm(b) == 0), F.raise_error(F.lit("ZERO_VECTOR")).cast("double"))
        .otherwise(dot(a, b) / (norm(a) * norm(b)))
    )


def l2_normalize(v: Column) -> Column:
    """Null for a vector of norm 0."""

    def divided(v: Column) -> Column:
        return let(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)))

    return let(_double(v), divided)


def combine_views(*views: Column) -> Column:
    """The normalised mean of those views that have the commonest size (of equally common ones the first).

    Null if no view is there or the mean is zero.
    """

    def common_size(there: Column) -> Column:
        def ranked(sizes: Column) -> Column:
            return F.array_max(F.transform(sizes, lambda n, i: F.struct(F.size(F.filter(sizes, lambda m: m == n)).alias("votes"), (-i).alias("first"), n.alias("n"))))["n"]

        return let(F.transform(there, lambda v: F.size(v)), ranked)

    def total(same: Column) -> Column:
        return F.aggregate(F.slice(same, 2, len(views)), F.get(same, 0), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))

    # the mean's norm is the sum's over the number of views, which cancels out
    there = F.filter(F.array(*map(_double, views)), lambda v: v.isNotNull() & (F.size(v) > 0))
    return let(there, lambda t: let(common_size(t), lambda n: let(F.filter(t, lambda v: F.size(v) == n), lambda same: l2_normalize(total(same)))))


def best_of(v: Column, prompts: Column) -> Column:
    """The largest dot product with any of the prompts (array of vectors)."""
    return F.array_max(F.transform(prompts, lambda p: dot(v, p)))


def relevance(footwear: Column, junk: Column) -> Column:
    """From the two best scores; ties go to footwear."""
    return F.when(footwear >= junk, "footwear").otherwise("irrelevant")


def scene_kind(footwear: Column, garbage: Column, order: Column) -> Column:
    return F.when((order >= footwear) & (order >= garbage), "order").when(footwear >= garbage, "shoe").otherwise("garbage")


def non_shoe_kind(garbage: Column, order: Column, delivery: Column) -> Column:
    return F.when((order >= delivery) & (order >= garbage), "order").when(delivery >= garbage, "delivery_notice").otherwise("garbage")


def vector_flags(v: Column, model: Column, expected_model: str, dimension: int) -> Column:
    """What is wrong with a stored vector: embedding_model, dimension, empty, non_finite, norm."""
    finite = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.size(v) > 0
    checks = [
        F.when((model != "") & (model != expected_model), "embedding_model"),
        F.when(F.size(v) != dimension, "dimension"),
        F.when(F.size(v) == 0, "empty"),
        F.when(some & ~finite, "non_finite"),
        F.when(some & F.coalesce(~finite | (F.abs(norm(v) - 1) > NORM_TOLERANCE), F.lit(True)), "norm"),
    ]
    return F.array_compact(F.array(*checks))


def fits(v: Column, dimension: int) -> Column:
    """The vector, or zeros if it has another size or holds what isn't finite."""
    return F.coalesce(F.when(F.size(v) == dimension, valid_vector(v)), F.array_repeat(F.lit(0.0).cast("float"), dimension))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
