"""Current customers: state as of a moment, exclusions, mean vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..sources.shared import kept
from .purchases import TIE_BREAKS, money, season_counts

#: Models of a catalog that are sent to all tasks, at most; more are joined by a shuffle of the purchases.
KNOWN = 200_000


def with_known(prepared: DataFrame, catalog: DataFrame) -> DataFrame:
    """Purchases with known: whether the catalog has a vector of the model."""
    models = kept(catalog.filter("visual is not null").select("model"))
    known = models.withColumn("known", F.lit(True))
    rows = prepared.join(F.broadcast(known) if models.count() <= KNOWN else known, "model", "left")
    return rows.withColumn("known", F.coalesce("known", F.lit(False)))


def current_customers(prepared: DataFrame, customers: DataFrame, catalog: DataFrame, as_of: str, new_models: Sequence[str] = (), ties: Sequence[str] = TIE_BREAKS) -> DataFrame:
    """One row a customer with purchases, with `excluded` (null: encoded).

    The last date, size, name and recency come from all purchases; the history leaves out new models. A customer is
    excluded without a history (no_purchases) or with none in the catalog (no_catalog_history).

    One exchange and one aggregation by customer, as lists don't shrink before it; they are sorted inside.
    """
    old = ~F.col("model").isin(list(new_models)) if new_models else F.lit(True)
    rows = with_known(prepared, catalog).withColumn("old", old).repartition("customer_id")
    key = F.struct("purchase_date", *[c for c in ties if c in prepared.columns])
    discounted = S.is_discount(F.col("discount"))
    item = F.struct(key.alias("key"), "model", "season", "known")
    named = F.when(F.trim("last_name") != "", F.struct(key.alias("key"), F.trim("last_name").alias("name")))
    per = rows.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("old"), item))).alias("items"),
        F.count_if(F.col("old")).alias("history_length"),
        F.count_if(F.col("old") & discounted).alias("discounts"),
        F.sum(F.when(F.col("old"), money(S.discount_value(F.col("discount"))))).alias("discount_sum"),
        F.max(F.struct(key.alias("key"), F.col("size").alias("size")))["size"].alias("last_size"),
        F.max(named)["name"].alias("customer_name"),
        F.max("purchase_date").alias("last_date"),
        F.min("purchase_date").alias("first_date"),
    )
    moment = F.lit(as_of).cast("timestamp")
    n = F.col("history_length")
    codes = F.transform("items", lambda x: x["model"])
    in_catalog = F.transform(F.filter("items", lambda x: x["known"]), lambda x: x["model"])
    seasons = F.filter(F.transform("items", lambda x: x["season"]), lambda s: s.isNotNull() & (s != ""))
    out = per.select(
        "customer_id",
        "customer_name",
        codes.alias("history"),
        in_catalog.alias("catalog_history"),
        n,
        (n - F.col("discounts")).alias("full_prices"),
        "discounts",
        F.try_divide(F.col("discount_sum").cast("double"), n).alias("avg_discount"),
        season_counts(seasons).alias("season_counts"),
        F.greatest(S.days_between(moment, F.col("last_date")), F.lit(0.0)).alias("recency_days"),
        S.tenure_days(moment, F.col("first_date")).alias("tenure_days"),
        F.to_date("last_date").alias("last_purchase_date"),
        F.col("last_size").alias("last_purchased_size"),
        S.last_items(codes, 8).alias("recent_models"),
        F.when(n == 0, "no_purchases").when(F.size(in_catalog) == 0, "no_catalog_history").alias("excluded"),
    )
    profile = customers.select(S.normalize_id(F.col("customer_id")).alias("customer_id"), *[c for c in ("age_group", "preferred_size", "history_confidence") if c in customers.columns])
    # of several profiles the greatest, by its columns in order, so that any run takes the same one
    others = [c for c in profile.columns if c != "customer_id"]
    profile = profile.filter("customer_id is not null")
    profile = profile.groupBy("customer_id").agg(F.max(F.struct(*others)).alias("_p")).select("customer_id", "_p.*") if others else profile.distinct()
    return out.join(profile, "customer_id", "left")


def exclusions(current: DataFrame, customers: DataFrame) -> DataFrame:
    """reason, n: encoded, no_purchases, no_catalog_history, anonymous; customers without any purchase among them."""
    known = customers.select(S.normalize_id(F.col("customer_id")).alias("customer_id")).filter("customer_id is not null").distinct()
    every = known.join(current.select("customer_id", F.lit(True).alias("bought"), "excluded"), "customer_id", "full")
    reason = F.when(F.col("bought"), F.coalesce("excluded", F.lit("encoded"))).when(F.col("customer_id") == S.ANONYMOUS_CUSTOMER, "anonymous").otherwise("no_purchases")
    return every.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def recent_histories(prepared: DataFrame, catalog: DataFrame, ties: Sequence[str] = TIE_BREAKS, max_history: int = 20) -> DataFrame:
    """customer_id, last_purchase_date, catalog_history: of customers that current_customers doesn't exclude, the last max_history of the history.

    Only purchases of catalog models are gathered; of the others the date counts.
    """
    key = F.struct("purchase_date", *[c for c in ties if c in prepared.columns])
    item = F.when(F.col("known"), F.struct(key.alias("key"), "model"))
    rows = with_known(prepared, catalog).select("customer_id", "purchase_date", item.alias("item")).repartition("customer_id")
    per = rows.groupBy("customer_id").agg(F.max("purchase_date").alias("last_date"), F.collect_list("item").alias("items")).filter(F.size("items") > 0)
    last = S.last_items(F.sort_array("items"), max_history)
    return per.select("customer_id", F.to_date("last_date").alias("last_purchase_date"), F.transform(last, lambda x: x["model"]).alias("catalog_history"))


def mean_vectors(histories: DataFrame, catalog: DataFrame, max_history: int = 20, keep: Sequence[str] = ()) -> DataFrame:
    """customer_id, the columns of keep, vector: the normalised mean of the visuals of the last max_history catalog purchases."""
    recent = histories.select("customer_id", *keep, F.explode(S.last_items(F.col("catalog_history"), max_history)).alias("model"))
    seen = recent.join(catalog.filter("visual is not null").select("model", "visual"), "model")
    mean = Summarizer.mean(array_to_vector(F.col("visual").cast("array<double>")))
    pooled = seen.groupBy("customer_id", *keep).agg(mean.alias("mean")).select("customer_id", *keep, V.l2_normalize(vector_to_array("mean")).alias("vector"))
    return pooled.filter("vector is not null")
