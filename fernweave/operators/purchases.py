"""Purchases: cleaning, leakage-free sequences, splits by time, and their report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import WindowSpec

from ..functions import scalars as S

#: Fixed values.
OBSERVATION_START = "2019-01-01"
TIE_BREAKS = ("purchase_id", "invoice_number", "sku", "model")


def prepare_purchases(purchases: DataFrame, observation_start: str = OBSERVATION_START) -> DataFrame:
    """Purchases with normalised ids, without anonymous, early, returned and unpaid ones.

    NaN quantities and amounts count as missing. The order of a customer's purchases is that of `in_order`.
    """
    kept = purchases.withColumns({"customer_id": S.normalize_id(F.col("customer_id")), "model": S.normalize_id(F.col("model"))})
    kept = kept.filter(F.col("customer_id").isNotNull() & F.col("model").isNotNull() & F.col("purchase_date").isNotNull())
    kept = kept.filter((F.col("customer_id") != S.ANONYMOUS_CUSTOMER) & (F.col("purchase_date") >= F.lit(observation_start).cast("timestamp")))
    for name in ("quantity", "paid_amount"):
        if name in kept.columns:
            number = F.col(name).cast("double") if isinstance(kept.schema[name].dataType, NumericType) else S.finite(F.col(name))
            kept = kept.filter((number > 0) & (number < float("inf")))  # NaN isn't less
    return kept


def in_order(df: DataFrame, ties: Sequence[str] = TIE_BREAKS) -> WindowSpec:
    """Each customer's purchases by date, then by the tie breaks that df has."""
    return W.partitionBy("customer_id").orderBy("purchase_date", *[F.asc_nulls_last(c) for c in ties if c in df.columns])


def money(value: Column) -> Column:
    """As a decimal, whose sums don't depend on the order of rows."""
    return value.cast("decimal(28,10)")


def sequences(prepared: DataFrame, ties: Sequence[str] = TIE_BREAKS) -> DataFrame:
    """A row for each purchase but a customer's first, with what came before it.

    One exchange and one sort serve all columns. A purchase that is filtered out later is still part of later
    histories, so filters on targets come after this.
    """
    order = in_order(prepared, ties)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    discounted = S.is_discount(F.col("discount"))
    seasons = F.collect_list(F.when(F.col("season") != "", F.col("season"))).over(before)
    out = prepared.withColumns(
        {
            "place": F.row_number().over(order),
            "history": F.collect_list("model").over(before),
            "history_dates": F.collect_list("purchase_date").over(before),
            "purchases_before": F.count(F.lit(1)).over(before),
            "discounts_before": F.coalesce(F.sum(discounted.cast("long")).over(before), F.lit(0)),
            "discount_sum_before": F.coalesce(F.sum(money(S.discount_value(F.col("discount")))).over(before), F.lit(0).cast("decimal(38,10)")),
            "seasons_before": seasons,
            "last_date": F.lag("purchase_date").over(order),
            "first_date": F.first("purchase_date").over(before),
        }
    ).filter("place > 1")
    n = F.col("purchases_before")
    return out.withColumns(
        {
            "full_prices_before": n - F.col("discounts_before"),
            "discount_ratio_before": F.col("discounts_before") / n,
            "full_price_ratio_before": (n - F.col("discounts_before")) / n,
            "avg_discount_before": F.col("discount_sum_before").cast("double") / n,
            "recency_days": S.days_between(F.col("purchase_date"), F.col("last_date")),
            "tenure_days": S.tenure_days(F.col("purchase_date"), F.col("first_date")),
        }
    )


def season_counts(seasons: Column) -> Column:
    """A map of the seasons in a list to their counts."""
    return F.map_from_entries(F.transform(F.array_distinct(seasons), lambda s: F.struct(s, F.size(F.filter(seasons, lambda x: x == s)))))


def with_targets(examples: DataFrame, catalog: DataFrame) -> DataFrame:
    """examples with reason: missing_model, missing_visual or ok. catalog: model, visual, one row a model."""
    known = catalog.select("model", F.lit(True).alias("_known"), "visual")
    reason = F.when(F.col("_known").isNull(), "missing_model").when(F.col("visual").isNull(), "missing_visual").otherwise("ok")
    return examples.join(known, "model", "left").withColumn("reason", reason).drop("_known")


def split_bounds(dates: DataFrame, column: str = "purchase_date", train_end: str | None = None, validation_end: str | None = None) -> DataFrame:
    """One row: train_end, validation_end, strategy.

    The two ends may be given, together. Otherwise they lie 120 and 60 days before the last date, if the first date
    isn't later; else at 70 % and 85 % of the distinct days.
    """
    if train_end or validation_end:
        if not (train_end and validation_end):
            raise ValueError("TRAIN_END and VALIDATION_END must be supplied together")
        if train_end >= validation_end:
            raise ValueError("TRAIN_END must be before VALIDATION_END")
        return dates.sparkSession.range(1).select(F.lit(train_end).cast("timestamp").alias("train_end"), F.lit(validation_end).cast("timestamp").alias("validation_end"), F.lit("configured").alias("strategy"))
    at = dates.filter(F.col(column).isNotNull()).select(F.col(column).cast("timestamp").alias("at"))
    # as many days as the calendar has between the first and the last
    days = at.groupBy(F.date_trunc("DAY", "at").alias("day")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    one = days.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sort_array(F.collect_list("day")).alias("days"))
    n = F.size("days")
    start, end = F.col("last") - F.expr("INTERVAL 120 DAYS"), F.col("last") - F.expr("INTERVAL 60 DAYS")
    low = F.when(n < 3, 0).otherwise(F.least(F.floor(n * F.lit(0.7)), n - 2)).cast("int")
    high = F.when(n < 3, F.least(F.lit(1), n - 1)).otherwise(F.least(F.greatest(F.floor(n * F.lit(0.85)), low + 1), n - 1)).cast("int")
    calendar = F.col("first") <= start
    return one.filter(n > 0).select(
        F.when(calendar, start).otherwise(F.get("days", low)).alias("train_end"),
        F.when(calendar, end).otherwise(F.get("days", high)).alias("validation_end"),
        F.when(calendar, "default_calendar").otherwise("default_quantiles").alias("strategy"),
    )


def split_of(date: Column, train_end: Column, validation_end: Column) -> Column:
    return F.when(date <= train_end, "train").when(date <= validation_end, "validation").otherwise("test")


def history_counts(prepared: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: customers with no, one, and two or more purchases. None: known customers without a prepared purchase."""
    per = prepared.groupBy("customer_id").count()
    known = customers.select(S.normalize_id(F.col("customer_id")).alias("customer_id")).filter("customer_id is not null").distinct()
    none = known.join(per, "customer_id", "left_anti").agg(F.count(F.lit(1)).alias("none"))
    some = per.agg(F.count_if(F.col("count") == 1).alias("one"), F.count_if(F.col("count") >= 2).alias("two_plus"))
    return none.crossJoin(some)


def availability(df: DataFrame, column: str) -> DataFrame:
    """value, n: the distribution of a column; missing values (null, empty, NaN) are one null value."""
    value = F.col(column).cast("string")
    return df.groupBy(F.when((value != "") & (value != "NaN"), value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def availability_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, present, missing, share (of the present; 0 without rows), in one scan."""
    there = {c: F.count_if((F.col(c).cast("string") != "") & (F.col(c).cast("string") != "NaN")) for c in columns}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[n.alias(c) for c, n in there.items()])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns]))
    share = F.coalesce(F.try_divide(F.col("present"), F.col("_n")), F.lit(0.0))
    return one.select("_n", rows).select("field", "present", (F.col("_n") - F.col("present")).alias("missing"), share.alias("share"))


def quality_report(prepared: DataFrame, customers: DataFrame, catalog: DataFrame, ties: Sequence[str] = TIE_BREAKS) -> DataFrame:
    """metric, value (text): the counts and dates of a dataset build. catalog: model, visual.

    The purchases are sorted once: a purchase is an example unless it is its customer's first, which a row number tells,
    so one sorted exchange and one aggregation give all of it. The split's bounds need the dates beforehand, in a scan of their own.
    """
    known = catalog.groupBy("model").agg(F.max(F.col("visual").isNotNull()).alias("_visual"))
    first = F.row_number().over(in_order(prepared, ties)) == 1
    rows = prepared.select("customer_id", "purchase_date", "model", first.alias("first")).join(known, "model", "left")
    bounds = F.broadcast(split_bounds(prepared))
    part = split_of(F.col("purchase_date"), F.col("train_end"), F.col("validation_end"))
    reason = F.when(F.col("_visual").isNull(), "missing_model").when(~F.col("_visual"), "missing_visual").otherwise("ok")
    rows = rows.join(bounds).select("*", part.alias("split"), reason.alias("reason"))
    example, day = ~F.col("first"), lambda c: F.date_format(c, "yyyy-MM-dd")
    bought = rows.agg(
        F.count(F.lit(1)).cast("string").alias("purchases"),
        F.count_if(F.col("_visual").isNull()).cast("string").alias("purchases_with_missing_model"),
        day(F.min("purchase_date")).alias("first_date"),
        day(F.max("purchase_date")).alias("last_date"),
        *[F.count_if(example & (F.col("reason") == r)).cast("string").alias(f"examples_{r}") for r in ("missing_model", "missing_visual", "ok")],
        *[F.count_if(example & (F.col("reason") == "ok") & (F.col("split") == x)).cast("string").alias(f"rows_{x}") for x in ("train", "validation", "test")],
    )
    models = catalog.agg(F.count(F.lit(1)).cast("string").alias("models"), F.count_if(F.col("visual").isNull()).cast("string").alias("models_without_visual"))
    people = customers.agg(F.count(F.lit(1)).cast("string").alias("customers"))
    one = bought.join(models).join(people)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])))


def format_report(report: DataFrame) -> str:
    """The report as text; it has a few rows."""
    return "\n".join(f"{r.metric}: {r.value}" for r in report.orderBy("metric").collect())
