"""Queries over the engine's tables, each with its SQL where SQL can express it.

Scores and ratios are compared in millionths, since engines may add doubles in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extraction as E
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import artifact, calibration, customers, decisions, encoders, examples, integrity, lookups, matching, memory_index, metrics, purchases, ranking, retrieval, scorer, towers
from ..sources import datasets, procs, snapshots
from ..sources.shared import kept, shared_folder
from ..sources.versions import VersionStore
from ..streaming import customers as streams
from . import tables as T
from .tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def micro(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5).cast("long")


def day(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def joined(x: Column) -> Column:
    return F.array_join(x, ",")


M = "floor({} * 1e6 + 0.5)::bigint"


@query(with_tables("prepared") + " select purchase_id, strftime(purchase_date, '%Y-%m-%d') as day, customer_id, model, sku, size, quantity, discount, season from prepared")
def prepared_purchases(spark: SparkSession, d: str) -> DataFrame:
    return T.prepared(spark, d).select("purchase_id", day(F.col("purchase_date")).alias("day"), "customer_id", "model", "sku", "size", "quantity", "discount", "season")


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return purchases.sequences(T.prepared(spark, d), T.TIES)


@query(
    with_tables("sequences")
    + f""" select customer_id, place::bigint as place, model, strftime(purchase_date, '%Y-%m-%d') as day, purchases_before, discounts_before,
  discounts_before / purchases_before as discount_ratio, discount_sum_before / purchases_before as avg_discount,
  {M.format("(epoch_us(purchase_date) - epoch_us(last_date)) / 86400000000.0")} as recency_micro,
  {M.format("(epoch_us(purchase_date) - epoch_us(first_date)) / 86400000000.0")} as tenure_micro from sequences"""
)
def sequential_behavior(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select(
        "customer_id", F.col("place").cast("long").alias("place"), "model", day(F.col("purchase_date")).alias("day"), "purchases_before", "discounts_before",
        F.col("discount_ratio_before").alias("discount_ratio"), F.col("avg_discount_before").alias("avg_discount"), micro(F.col("recency_days")).alias("recency_micro"), micro(F.col("tenure_days")).alias("tenure_micro"),
    )


@query(with_tables("sequences") + " select customer_id, place::bigint as place, model, array_to_string(history, ',') as history from sequences")
def sequential_history(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("customer_id", F.col("place").cast("long").alias("place"), "model", joined(F.col("history")).alias("history"))


@query(with_tables("sequences") + " select customer_id, place::bigint as place, s as season, count(*) as n from (select customer_id, place, unnest(seasons_before) as s from sequences) group by all")
def season_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = purchases.season_counts(F.col("seasons_before"))
    return _sequences(spark, d).select("customer_id", F.col("place").cast("long").alias("place"), F.explode(counts).alias("season", "n")).withColumn("n", F.col("n").cast("long"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return purchases.with_targets(_sequences(spark, d), T.catalog(spark, d))


@query(with_tables("examples") + " select reason, count(*) as n from examples group by 1")
def example_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


BOUNDS = "bounds as (select max(purchase_date) - interval 120 day as t1, max(purchase_date) - interval 60 day as t2 from prepared)"
SPLIT = "case when purchase_date <= t1 then 'train' when purchase_date <= t2 then 'validation' else 'test' end"


@query(with_tables("prepared") + f", {BOUNDS} select strftime(t1, '%Y-%m-%d') as train_end, strftime(t2, '%Y-%m-%d') as validation_end, 'default_calendar' as strategy from bounds")
def default_split_bounds(spark: SparkSession, d: str) -> DataFrame:
    return purchases.split_bounds(T.prepared(spark, d)).select(day(F.col("train_end")).alias("train_end"), day(F.col("validation_end")).alias("validation_end"), "strategy")


def _split(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.broadcast(purchases.split_bounds(T.prepared(spark, d)))
    examples = _examples(spark, d).crossJoin(bounds)  # one row
    return examples.withColumn("split", purchases.split_of(F.col("purchase_date"), F.col("train_end"), F.col("validation_end")))


@query(with_tables("examples") + f", {BOUNDS} select {SPLIT} as split, count(*) as n, count(distinct customer_id) as customers from examples, bounds where reason = 'ok' group by 1")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).filter("reason = 'ok'").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"))


@query(
    with_tables("prepared", "customers")
    + """, per as (select customer_id, count(*) as n from prepared group by 1)
select (select count(*) from customers where customer_id not in (select customer_id from per)) as none,
       count(*) filter (n = 1) as one, count(*) filter (n >= 2) as two_plus from per"""
)
def history_counts(spark: SparkSession, d: str) -> DataFrame:
    return purchases.history_counts(T.prepared(spark, d), T.customers(spark, d))


@query(with_tables("sequences") + " select purchases_before as history_length, count(*) as n from sequences group by 1")
def history_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).groupBy(F.col("purchases_before").alias("history_length")).agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("prepared") + " select season as value, count(*) as n from prepared group by 1")
def season_availability(spark: SparkSession, d: str) -> DataFrame:
    return purchases.availability(T.prepared(spark, d), "season")


@query(
    with_tables("examples", "customers")
    + f""", {BOUNDS}
select 'purchases' as metric, count(*)::varchar as value from prepared
union all select 'first_date', strftime(min(purchase_date), '%Y-%m-%d') from prepared
union all select 'last_date', strftime(max(purchase_date), '%Y-%m-%d') from prepared
union all select 'customers', count(*)::varchar from customers
union all select 'models', count(*)::varchar from catalog
union all select 'models_without_visual', count(*)::varchar from catalog where visual is null
union all select 'purchases_with_missing_model', count(*)::varchar from prepared where model not in (select model from catalog)
union all select 'examples_' || r, count(reason)::varchar from (values ('missing_model'), ('missing_visual'), ('ok')) v(r) left join examples on reason = r group by r
union all select 'rows_' || s, count(part)::varchar from (values ('train'), ('validation'), ('test')) v(s) left join (select {SPLIT} as part from examples, bounds where reason = 'ok') on part = s group by s"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return purchases.quality_report(T.prepared(spark, d), T.customers(spark, d), T.catalog(spark, d), T.TIES)


@query(
    with_tables("catalog")
    + f""", rows as (select count(*) as n, count(main_category) as a, count(color) as b, count(visual) as c from catalog)
select 'main_category' as field, a as present, n - a as missing, {M.format("a / n")} as share_micro from rows
union all select 'color', b, n - b, {M.format("b / n")} from rows union all select 'visual', c, n - c, {M.format("c / n")} from rows"""
)
def availability_stats(spark: SparkSession, d: str) -> DataFrame:
    out = purchases.availability_stats(T.catalog(spark, d), ("main_category", "color", "visual"))
    return out.select("field", "present", "missing", micro(F.col("share")).alias("share_micro"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return customers.current_customers(T.prepared(spark, d), T.customers(spark, d), T.catalog(spark, d), T.AS_OF, (), T.TIES)


CURRENT = """, current as (
  select p.customer_id, arg_max(last_name, o) as customer_name, count(*) as history_length, sum(case when discount > 0 then 1 else 0 end)::bigint as discounts,
         sum(discount::decimal(12, 2))::double / count(*) as avg_discount, arg_max(size, o) as last_purchased_size,
         max(purchase_date) as last_date, min(purchase_date) as first_date,
         list(p.model order by o) as history, list(p.model order by o) filter (c.visual is not null) as catalog_history
  from (select *, row_number() over (partition by customer_id order by purchase_date, purchase_id, invoice_number, sku, price, quantity) as o from prepared) p
  left join catalog c on p.model = c.model group by 1)"""


@query(
    with_tables("prepared", "catalog", "customers")
    + CURRENT
    + f""" select current.customer_id, customer_name, history_length, discounts, avg_discount, last_purchased_size, strftime(last_date, '%Y-%m-%d') as last_day,
  {M.format("(epoch_us(timestamp '2001-09-01') - epoch_us(first_date)) / 86400000000.0")} as tenure_micro,
  array_to_string(history[-8:], ',') as recent_models, array_to_string(catalog_history, ',') as catalog_history, age_group, preferred_size
from current left join customers on current.customer_id = customers.customer_id where catalog_history is not null"""
)
def current_customers(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).filter("excluded is null").select(
        "customer_id", "customer_name", "history_length", "discounts", "avg_discount", "last_purchased_size", day(F.col("last_purchase_date")).alias("last_day"),
        micro(F.col("tenure_days")).alias("tenure_micro"), joined(F.col("recent_models")).alias("recent_models"), joined(F.col("catalog_history")).alias("catalog_history"), "age_group", "preferred_size",
    )


@query(
    with_tables("prepared", "catalog", "customers")
    + CURRENT
    + """ select case when current.customer_id is null then 'no_purchases' when catalog_history is null then 'no_catalog_history' else 'encoded' end as reason, count(*) as n
from customers full join current on customers.customer_id = current.customer_id group by 1"""
)
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return customers.exclusions(_current(spark, d), T.customers(spark, d))


@query(
    with_tables("catalog")
    + """ select model, case when model_id % 5 = 0 then 'live' else color end as color from catalog
union all select 'new-' || model, 'live' from catalog where model_id % 50 = 0"""
)
def catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = T.catalog(spark, d)
    changed = base.filter("model_id % 5 = 0").select("model", F.lit("live").alias("color"))
    added = base.filter("model_id % 50 = 0").select(F.concat(F.lit("new-"), "model").alias("model"), F.lit("live").alias("color"))
    return snapshots.upsert(base.select("model", "color"), changed.unionByName(added), ["model"])


@query(
    with_tables("catalog")
    + """, asked as (select model from catalog union all select 'x' || model from catalog where model_id % 100 = 0)
select a.model, c.visual is not null as vector_generated, case when c.model is null then 'not_in_catalog' else '' end as missing from asked a left join catalog c on a.model = c.model"""
)
def model_status(spark: SparkSession, d: str) -> DataFrame:
    base = T.catalog(spark, d)
    asked = base.select("model").unionByName(base.filter("model_id % 100 = 0").select(F.concat(F.lit("x"), "model").alias("model")))
    lacking = encoders.missing_attributes(("main_category", "theme", "color"))
    out = lookups.model_status(asked, base, lacking)
    return out.withColumn("missing", joined(F.col("missing")))


@query(
    with_tables("views")
    + f""", sums as (
  select model, list_transform(range(1, 65), lambda i: (main[i]::double + coalesce(pers[i]::double, 0) + side[i]::double) / (case when pers is null then 2 else 3 end)) as mean from views)
select model, i::int as place, {M.format("mean[i] / sqrt(list_dot_product(mean, mean))")} as value_micro from sums, range(1, 65) as t(i)"""
)
def visual_combine(spark: SparkSession, d: str) -> DataFrame:
    visual = V.combine_views(F.col("main"), F.col("pers"), F.col("side"))
    # outer: else the optimizer computes the vector once more, to leave out empty ones before the joins
    combined = T.views(spark, d).select("model", F.posexplode_outer(visual).alias("place", "value"))
    return combined.select("model", (F.col("place") + 1).alias("place"), micro(F.col("value")).alias("value_micro"))


@query(
    with_tables("views")
    + """ select model, image_type, e[1]::double as first_value, len(e)::int as size from (
  select model, 'main' as image_type, main as e from views union all select model, 'pers', pers from views union all select model, 'side', side from views) where e is not null"""
)
def view_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.unpivot_views(T.views(spark, d)).select("model", "image_type", F.col("embedding")[0].cast("double").alias("first_value"), F.size("embedding").alias("size"))


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("purchases_before")
    made = S.numeric_features(n, n, F.col("recency_days"), F.col("tenure_days"), F.col("full_price_ratio_before"), F.col("discount_ratio_before"), F.col("avg_discount_before"))
    return _sequences(spark, d).select("customer_id", F.col("place").cast("long").alias("place"), *made)


NUMERIC = """, numeric_features as (
  select customer_id, place::bigint as place, ln(1 + purchases_before) as log_purchases, ln(1 + purchases_before) as log_history,
         ln(1 + (epoch_us(purchase_date) - epoch_us(last_date)) / 86400000000.0) as log_recency,
         ln(1 + (epoch_us(purchase_date) - epoch_us(first_date)) / 86400000000.0) as log_tenure, 0.0 as tenure_missing,
         (purchases_before - discounts_before) / purchases_before as full_price_ratio, discounts_before / purchases_before as discount_ratio,
         discount_sum_before / purchases_before as avg_discount
  from sequences)"""


@query(with_tables("sequences") + NUMERIC + " select customer_id, place, " + ", ".join(f"{M.format(c)} as {c}" for c in S.NUMERIC_FEATURES) + " from numeric_features")
def numeric_features(spark: SparkSession, d: str) -> DataFrame:
    return _numeric(spark, d).select("customer_id", "place", *[micro(F.col(c)).alias(c) for c in S.NUMERIC_FEATURES])


@query(
    with_tables("sequences")
    + NUMERIC
    + " select "
    + ", ".join(f"{M.format(f'avg({c})')} as mean_{c}, {M.format(f'(case when stddev_pop({c}) < 1e-6 then 1 else stddev_pop({c}) end)')} as std_{c}" for c in S.NUMERIC_FEATURES)
    + " from numeric_features"
)
def numeric_scaler(spark: SparkSession, d: str) -> DataFrame:
    one = encoders.numeric_scaler(_numeric(spark, d))
    return one.select(*[micro(F.col(c)).alias(c) for c in one.columns])


@query(with_tables("catalog") + " select main_category as token, (row_number() over (order by min(model_id), main_category) + 1)::int as index from catalog group by 1")
def vocab_index(spark: SparkSession, d: str) -> DataFrame:
    return encoders.vocabulary(T.catalog(spark, d), "main_category", "model_id")


def _people(histories: DataFrame, looks: DataFrame) -> DataFrame:
    return kept(customers.mean_vectors(histories, looks, keep=("last_purchase_date",)))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """customer_id, vector, last_purchase_date of customers that aren't excluded, kept: a query may use them several times."""
    looks = T.catalog(spark, d)
    return _people(customers.recent_histories(T.prepared(spark, d), looks, T.TIES), looks)


def _models(spark: SparkSession, d: str) -> DataFrame:
    return T.catalog(spark, d).filter("visual is not null").select("model", F.col("visual").alias("vector"))


PAIRS = """, scores as (
  select v.customer_id, c.model, list_dot_product(v.vector, c.visual::double[]) as score from vectors v, catalog c where c.visual is not null)"""


@query(
    with_tables("pooled")
    + PAIRS
    + f" select model, customer_rank::int as customer_rank, customer_id, {M.format('score')} as score_micro from (select *, row_number() over (partition by model order by score desc, customer_id) as customer_rank from scores) where customer_rank <= 20"
)
def rank_customers_per_model(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_customers(_vectors(spark, d), _models(spark, d), 20).select("model", "customer_rank", "customer_id", micro(F.col("score")).alias("score_micro"))


@query(
    with_tables("pooled")
    + PAIRS
    + f" select customer_id, rank_for_customer::int as rank_for_customer, model, {M.format('score')} as score_micro from (select *, row_number() over (partition by customer_id order by score desc, model) as rank_for_customer from scores) where rank_for_customer <= 6"
)
def rank_models_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_models(_vectors(spark, d), _models(spark, d), 6).select("customer_id", "rank_for_customer", "model", micro(F.col("score")).alias("score_micro"))


LAST = ", last as (select customer_id, max(purchase_date)::date as last_day from prepared group by 1)"
ELIGIBLE = """, ranked as (
  select *, row_number() over (partition by model order by score desc, customer_id) as customer_rank
  from scores join last using (customer_id) where date_diff('day', last_day, date '2001-09-01') >= 60)"""


@query(with_tables("pooled") + PAIRS + LAST + ELIGIBLE + f" select model, customer_rank::int as customer_rank, customer_id, {M.format('score')} as score_micro from ranked where customer_rank <= 10")
def rank_with_recency(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_eligible(_vectors(spark, d), _models(spark, d), T.AS_OF, 10).select("model", "customer_rank", "customer_id", micro(F.col("score")).alias("score_micro"))


def _arriving(spark: SparkSession, d: str) -> tuple[scorer.CustomerCache, list[dict[str, int]]]:
    """A cache after three updates: most purchases, then some that are earlier and later ones mixed, then the rest."""
    bought = kept(T.prepared(spark, d).withColumn("arrival", F.when(F.col("purchase_id") % 10 < 8, 1).when(F.col("purchase_id") % 1000 == 8, 2).otherwise(3).cast("long")))
    cache, looks = scorer.CustomerCache(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", ties=T.TIES, dimension=T.DIMENSION), T.catalog(spark, d)
    return cache, [cache.update(bought.filter(F.col("arrival") <= n), looks, "arrival") for n in (1, 2, 3)]


@query(with_tables("pooled") + PAIRS + LAST + ELIGIBLE + f" select model, customer_rank::int as customer_rank, customer_id, {M.format('score')} as score_micro from ranked where customer_rank <= 10")
def cached_ranking(spark: SparkSession, d: str) -> DataFrame:
    cache, _ = _arriving(spark, d)
    return ranking.rank_eligible(cache.vectors(), _models(spark, d), T.AS_OF, 10).select("model", "customer_rank", "customer_id", micro(F.col("score")).alias("score_micro"))


@query(
    with_tables("prepared")
    + """ select case when purchase_id % 10 < 8 then 1 when purchase_id % 1000 = 8 then 2 else 3 end as version, count(*) as arrived, count(distinct customer_id) as touched from prepared group by 1"""
)
def cached_updates(spark: SparkSession, d: str) -> DataFrame:
    _, made = _arriving(spark, d)
    return spark.createDataFrame([(u["version"], u["arrived"], u["touched"]) for u in made], "version int, arrived long, touched long")


@query(
    with_tables("prepared")
    + LAST
    + """, aged as (select date_diff('day', last_day, date '2001-09-01') as n from last)
select case when n < 60 then '<60d' when n <= 180 then '60-180d' when n < 365 then '181-365d' when n < 1095 then '1-3y' else '3y+' end as bucket, count(*) as n from aged group by 1"""
)
def recency_buckets(spark: SparkSession, d: str) -> DataFrame:
    last = T.prepared(spark, d).groupBy("customer_id").agg(F.max("purchase_date").alias("last"))
    days = S.days_since(day(F.col("last")), F.lit(T.AS_OF).cast("date"))
    return last.groupBy(S.recency_bucket(days).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(spark: SparkSession, d: str, people: DataFrame | None = None) -> DataFrame:
    return ranking.rank_eligible(_vectors(spark, d) if people is None else people, _models(spark, d), T.AS_OF, 50)


TOP = with_tables("pooled") + PAIRS + LAST + ELIGIBLE + ", best as (select * from ranked where customer_rank <= 50)"


@query(
    TOP
    + f""" select model, string_agg(customer_id, ',' order by customer_rank) filter (customer_rank <= 10) as top_10, string_agg(customer_id, ',' order by customer_rank) filter (customer_rank <= 25) as top_25,
  string_agg(customer_id, ',' order by customer_rank) as top_50, {M.format("max(score)")} as score_max, {M.format("median(score)")} as score_median, {M.format("min(score)")} as score_min from best group by 1"""
)
def ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.model_summary(_ranked(spark, d))
    return out.select("model", *[joined(F.col(c)).alias(c) for c in ("top_10", "top_25", "top_50")], *[micro(F.col(c)).alias(c) for c in ("score_max", "score_median", "score_min")])


@query(
    TOP
    + f""", per as (select customer_id, count(*) as n from best where customer_rank <= 25 group by 1)
select count(*) as unique_customers, {M.format("sum(n) / count(*)")} as average_micro, max(n) as most_models, (select customer_id from per order by n desc, customer_id limit 1) as most_repeated from per"""
)
def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    return ranking.overlap(_ranked(spark, d)).select("unique_customers", micro(F.col("average_models")).alias("average_micro"), "most_models", "most_repeated")


@query(TOP + " select count(distinct customer_id) as n from best where customer_rank <= 10")
def unique_top(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).filter("customer_rank <= 10").agg(F.count_distinct("customer_id").alias("n"))


@query(
    TOP
    + f""" select count(*) as n, count(*) filter (score < 0.25) as below_25, count(*) filter (score >= 0.25 and score < 0.5) as below_50,
  count(*) filter (score >= 0.5 and score < 0.75) as below_75, count(*) filter (score >= 0.75) as from_75,
  {M.format("avg(score)")} as average, {M.format("median(score)")} as median, {M.format("min(score)")} as least,
  {M.format("quantile_cont(score, 0.1)")} as p10, {M.format("quantile_cont(score, 0.9)")} as p90 from best"""
)
def score_report(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.score_summary(_ranked(spark, d))
    return out.select("n", "below_25", "below_50", "below_75", "from_75", *[micro(F.col(c)).alias(c) for c in ("average", "median", "least", "p10", "p90")])


@query(TOP + ", names as (select customer_id, max(last_name) as customer_name from prepared group by 1) select model, customer_rank::int as customer_rank, customer_id, customer_name, strftime(last_day, '%Y-%m-%d') as last_day from best join names using (customer_id) where customer_rank <= 10")
def ranking_export(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.enrich(_ranked(spark, d).filter("customer_rank <= 10"), _current(spark, d))
    return out.select("model", "customer_rank", "customer_id", "customer_name", day(F.col("last_purchase_date")).alias("last_day"))


#: The worked example of a fitted curve.
CURVE = calibration.Calibrator((0.10, 0.40, 0.55, 0.70), (0.0, 1 / 3, 1.0, 1.0))


FAULTY = """select model, customer_rank + (case when model like '%1' and customer_rank >= 3 then 1 else 0 end) as customer_rank,
         case when model like '%2' and customer_rank = 2 then '99999999' when model like '%3' and customer_rank = 2 then first_id else customer_id end as customer_id,
         case when model like '%4' and customer_rank = 1 then -2.0 else score end as score from heads where model not like '%5'"""


@query(
    TOP
    + f""", heads as (select *, first_value(customer_id) over (partition by model order by customer_rank) as first_id from best where customer_rank <= 10),
faulty as ({FAULTY}),
seen as (select *, lead(score) over w as next_score, row_number() over w as turn, count(*) over (partition by model, customer_id) as times from faulty window w as (partition by model order by customer_rank)),
new_models as (select min(model) as m from prepared)
select distinct model, problem from (
  select model, unnest([case when customer_rank <> turn then 'rank' end, case when next_score > score then 'order' end, case when times > 1 then 'repeated' end, case when customer_id = '99999999' then 'anonymous' end]) as problem from seen)
where problem is not null
union all select distinct model, 'absent' from best where model like '%5'
union all select null, 'history' from new_models where m in (select model from prepared)"""
)
def ranking_violations(spark: SparkSession, d: str) -> DataFrame:
    """A ranking with a planted fault of each kind, by the last digit of the model."""
    # the histories, of which there are the vectors and among which a new model is looked for, are made once
    now = kept(_current(spark, d).select("customer_id", "history", "catalog_history", "last_purchase_date", "excluded"))
    heads = kept(_ranked(spark, d, _people(now.filter("excluded is null"), T.catalog(spark, d))).filter("customer_rank <= 10"))
    model, rank = F.col("model"), F.col("customer_rank")
    first = F.first("customer_id").over(Window.partitionBy("model").orderBy("customer_rank"))
    faulty = heads.filter(~model.endswith("5")).select(
        "model",
        (rank + F.when(model.endswith("1") & (rank >= 3), 1).otherwise(0)).alias("customer_rank"),
        F.when(model.endswith("2") & (rank == 2), S.ANONYMOUS_CUSTOMER).when(model.endswith("3") & (rank == 2), first).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(model.endswith("4") & (rank == 1), -2.0).otherwise(F.col("score")).alias("score"),
    )
    new = now.agg(F.min(F.array_min("history"))).first()[0]
    return ranking.violations(faulty, now, [new], heads.select("model"))


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    """customer_id, target (the last catalog model), catalog_history (those before it): what is predicted is no part of the vector."""
    now = _current(spark, d).filter("excluded is null and size(catalog_history) > 1")
    return now.select("customer_id", F.element_at("catalog_history", -1).alias("target"), F.expr("slice(catalog_history, 1, size(catalog_history) - 1)").alias("catalog_history"))


LIKE = "(case when score <= 0.10 then 0.0 when score < 0.40 then (score - 0.10) * ((1.0::double / 3) / 0.30) when score < 0.55 then 1.0::double / 3 + (score - 0.40) * ((2.0::double / 3) / 0.15) else 1.0 end)::double"
LIKED = (
    with_tables("pooled")
    + PAIRS
    + LAST
    + f""", aged as (select *, date_diff('day', last_day, date '2001-09-01') as n, {LIKE} as liked from scores join last using (customer_id)),
liked as (select *, row_number() over (partition by model order by liked desc, customer_id)::int as customer_rank from aged where n >= 60 qualify customer_rank <= 20)"""
)
AGES = ", ".join(f"count(*) filter (n {c})::bigint as {name}" for name, c in (("from_60", ">= 60 and n <= 180"), ("from_181", "> 180 and n < 365"), ("from_1y", ">= 365 and n < 1095"), ("from_3y", ">= 1095")))


def _liked(spark: SparkSession, d: str, people: DataFrame | None = None) -> DataFrame:
    return ranking.rank_eligible(_vectors(spark, d) if people is None else people, _models(spark, d), T.AS_OF, 20, CURVE)


@query(LIKED + f" select model, customer_rank, customer_id, {M.format('liked')} as like_micro, {M.format('score')} as similarity_micro from liked")
def rank_by_like_score(spark: SparkSession, d: str) -> DataFrame:
    return _liked(spark, d).select("model", "customer_rank", "customer_id", micro(F.col("score")).alias("like_micro"), micro(F.col("similarity")).alias("similarity_micro"))


@query(
    LIKED
    + f""" select model, (select count(*) from vectors) as total_scored, (select count(*) from vectors join last using (customer_id) where date_diff('day', last_day, date '2001-09-01') < 60) as excluded_recent,
  (select count(*) from vectors join last using (customer_id) where date_diff('day', last_day, date '2001-09-01') >= 60) as eligible, count(*) as returned, {AGES}, 0::bigint as undated from liked group by 1"""
)
def recency_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    people = _vectors(spark, d)
    return ranking.diagnostics(people, _liked(spark, d, people), T.AS_OF)


@query(
    LIKED
    + f""", plain as (select *, row_number() over (partition by model order by score desc, customer_id) as turn from aged qualify turn <= 20),
both_ways as (select model, 'like_score' as ranking, n, liked as v from liked union all select model, 'similarity', n, score from plain)
select model, ranking, count(*) as results, {AGES}, {M.format("avg(v)")} as average, {M.format("median(v)")} as median, {M.format("min(v)")} as least,
  {M.format("quantile_cont(v, 0.1)")} as p10, {M.format("quantile_cont(v, 0.9)")} as p90 from both_ways group by 1, 2"""
)
def like_score_report(spark: SparkSession, d: str) -> DataFrame:
    people = _vectors(spark, d)
    out = ranking.score_comparison(ranking.rank_both(people, _models(spark, d), T.AS_OF, 20, CURVE), people, T.AS_OF)
    return out.select("model", "ranking", "results", "from_60", "from_181", "from_1y", "from_3y", *[micro(F.col(c)).alias(c) for c in ("average", "median", "least", "p10", "p90")])


@query(
    LIKED.replace("customer_rank <= 20)", "customer_rank <= 100)")
    + f" select customer_rank, customer_id, {M.format('round(liked, 4)')} as like_micro, {M.format('score')} as similarity_micro from liked where model = '7'"
)
def recommend_for_model(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.recommend(_vectors(spark, d), T.catalog(spark, d), "7", CURVE, T.AS_OF)
    return out.select("customer_rank", "customer_id", micro(F.col("like_score")).alias("like_micro"), micro(F.col("similarity")).alias("similarity_micro"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


SCORED = ", asked as (select vec_id::varchar as query_id, embedding as q from embeddings where vec_id % 20 = 0), scored as (select query_id, model, image_type, position, list_dot_product(q::double[], embedding::double[]) as s from asked, images)"


@query(with_tables("images") + SCORED + f" select query_id, rank::int as rank, model, image_type, position, {M.format('s')} as similarity_micro from (select *, row_number() over (partition by query_id order by s desc, position) as rank from scored) where rank <= 50")
def image_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_images(_queries(spark, d), T.images(spark, d), 50).select("query_id", "rank", "model", "image_type", "position", micro(F.col("similarity")).alias("similarity_micro"))


@query(
    with_tables("images")
    + SCORED
    + f""", firsts as (select *, row_number() over (partition by query_id, model order by s desc, position) as turn from scored)
select query_id, row_number() over (partition by query_id order by s desc, model, image_type)::int as rank, model, image_type as best_image_type, {M.format("s")} as score_micro from firsts where turn = 1 qualify rank <= 100"""
)
def model_max_rank(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_models_by_best(_queries(spark, d), T.images(spark, d), 100).select("query_id", "rank", "model", "best_image_type", micro(F.col("model_score")).alias("score_micro"))


def _prompts(d: DataFrame, low: int, high: int) -> list[list[float]]:
    return [r.embedding for r in d.filter(F.col("vec_id").between(low, high)).orderBy("vec_id").collect()]


@query(
    f"""with q as (select vec_id::varchar as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0),
scored as (select query_id, vec_id::varchar as id, list_dot_product(q, embedding::double[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))) as score from embeddings, q)
select query_id, id, {M.format("score")} as score_micro, row_number() over (partition by query_id order by score desc, id)::int as rank from scored qualify rank <= 100"""
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    candidates = T.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    found = retrieval.rank_for_queries(_queries(spark, d), candidates, 100)
    return found.select("query_id", "id", micro(F.col("score")).alias("score_micro"), "rank")


MEMORY = (
    with_tables("cases")
    + """, asked as (select vec_id::varchar as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0),
scored as (
  select query_id, case_key, list_dot_product(q, embedding::double[]) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::double[], embedding::double[]))
         * case review_status when 'approved' then 1.10 when 'draft' then 1.02 else 1.0 end as score
  from cases, asked where role_id = 'customer_success' and trim(text) <> '' and wa_id <> 'src3'),
found as (select *, row_number() over (partition by query_id order by score desc, case_key)::int as rank from scored qualify rank <= 5)"""
)


def _memory(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.memory_search(T.cases(spark, d), _queries(spark, d), k=5, exclude={"wa_id": ["src3", ""]})


@query(MEMORY + f" select query_id, case_key, {M.format('score')} as score_micro, rank from found")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d).select("query_id", "case_key", micro(F.col("score")).alias("score_micro"), "rank")


@query(
    MEMORY
    + f""", per as (
  select 'mode' || (query_id::int // 20 % 2) as mode, max(case when rank = 1 and query_id = case_key then 1.0 else 0.0 end) as h1,
         max(case when rank <= 3 and query_id = case_key then 1.0 else 0.0 end) as h3, max(case when query_id = case_key then 1.0 else 0.0 end) as r5
  from asked left join found using (query_id) group by query_id)
select coalesce(mode, 'all') as mode, count(*) as queries, {M.format("avg(h1)")} as hit_1, {M.format("avg(h3)")} as hit_3, {M.format("avg(r5)")} as recall_5 from per group by grouping sets ((mode), ())"""
)
def hit_recall(spark: SparkSession, d: str) -> DataFrame:
    expected = _queries(spark, d).select("query_id", F.concat(F.lit("mode"), (F.col("query_id").cast("int") / 20 % 2).cast("int").cast("string")).alias("mode"), F.array("query_id").alias("keys"))
    out = metrics.retrieval_metrics(_memory(spark, d), expected)
    return out.select(F.coalesce("mode", F.lit("all")).alias("mode"), "queries", *[micro(F.col(c)).alias(c) for c in ("hit_1", "hit_3", "recall_5")])


GATE = """with prompts as (
  select (select list(embedding::double[]) from embeddings where vec_id between 0 and 2) as footwear, (select list(embedding::double[]) from embeddings where vec_id between 3 and 5) as junk,
         (select list(embedding::double[]) from embeddings where vec_id between 6 and 8) as orders, (select list(embedding::double[]) from embeddings where vec_id between 9 and 11) as delivery),
best as (
  select vec_id, list_max(list_transform(footwear, lambda p: list_dot_product(embedding::double[], p))) as f, list_max(list_transform(junk, lambda p: list_dot_product(embedding::double[], p))) as j,
         list_max(list_transform(orders, lambda p: list_dot_product(embedding::double[], p))) as o, list_max(list_transform(delivery, lambda p: list_dot_product(embedding::double[], p))) as s
  from embeddings, prompts)
"""


def _gate(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "embeddings")
    best = {n: V.best_of(F.col("embedding"), F.array(*map(V.literal, _prompts(e, low, low + 2)))) for n, low in (("f", 0), ("j", 3), ("o", 6), ("s", 9))}
    return e.select("vec_id", *[c.alias(n) for n, c in best.items()])


@query(GATE + f"select vec_id, case when f >= j then 'footwear' else 'irrelevant' end as relevance, {M.format('f')} as footwear_micro, {M.format('j')} as junk_micro from best")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select("vec_id", V.relevance(F.col("f"), F.col("j")).alias("relevance"), micro(F.col("f")).alias("footwear_micro"), micro(F.col("j")).alias("junk_micro"))


@query(
    GATE
    + """select vec_id, case when o >= f and o >= j then 'order' when f >= j then 'shoe' else 'garbage' end as scene,
  case when o >= s and o >= j then 'order' when s >= j then 'delivery_notice' else 'garbage' end as non_shoe from best"""
)
def scene_kind(spark: SparkSession, d: str) -> DataFrame:
    f, j, o, s = (F.col(c) for c in "fjos")
    return _gate(spark, d).select("vec_id", V.scene_kind(f, j, o).alias("scene"), V.non_shoe_kind(j, o, s).alias("non_shoe"))


@query(
    with_tables("histories")
    + ", held as (select customer_id, catalog_history[-1] as target, catalog_history[:-2] as catalog_history from histories where len(catalog_history) > 1),\n"
    + T.SQL["pooled"].replace("from histories", "from held")
    + PAIRS
    + f""", target as (select customer_id, target from held),
positions as (select model, model_id from catalog),
ranks as (
  select s.customer_id, 1 + count(*) filter (s.score > t.score or (s.score = t.score and p.model_id < tp.model_id)) as rank
  from scores s join positions p on s.model = p.model join target g on s.customer_id = g.customer_id
  join scores t on t.customer_id = s.customer_id and t.model = g.target join positions tp on tp.model = g.target group by 1)
select {M.format("avg(case when rank <= 5 then 1.0 else 0.0 end)")} as recall_5, {M.format("avg(case when rank <= 10 then 1.0 else 0.0 end)")} as recall_10, {M.format("avg(case when rank <= 20 then 1.0 else 0.0 end)")} as recall_20,
  {M.format("avg(case when rank <= 10 then 1 / log2(rank + 1) else 0.0 end)")} as ndcg_10, {M.format("avg(1.0 / rank)")} as mrr, {M.format("avg(case when rank <= 10 then 1.0 else 0.0 end)")} as hit_rate, count(*) as examples from ranks"""
)
def eval_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    now = _held_out(spark, d)
    models = T.catalog(spark, d).filter("visual is not null").select("model", F.col("model_id").alias("position"), F.col("visual").alias("vector"))
    target = models.select(F.col("model").alias("target"), F.col("position").alias("target_position"), F.col("vector").alias("target_vector"))
    asked = customers.mean_vectors(now, T.catalog(spark, d), keep=("target",)).join(target, "target")
    ranks = ranking.target_ranks(asked, models)
    out = metrics.ranking_metrics(ranks)
    return out.select(*[micro(F.col(c)).alias(c) for c in out.columns[:-1]], "examples")


EXAMPLES = (
    with_tables("examples")
    + f""", {BOUNDS}, numbered as (select s.*, {SPLIT} as split from examples s, bounds where reason = 'ok'),
seen as (
  select u.customer_id, u.place, u.i as turn, c.visual
  from (select customer_id, place, unnest(history[-20:]) as h, generate_subscripts(history[-20:], 1) as i from numbered) u join catalog c on c.model = u.h and c.visual is not null),
summed as (
  select customer_id, place, i, sum(visual[i]::double) as m, count(*) as used from seen, range(1, 65) as t(i) group by all),
as_of as (
  select customer_id, place, any_value(used) as used, list(m order by i) as total from summed group by 1, 2),
held as (
  select e.customer_id, e.place, e.model, e.split, a.used, list_transform(total, lambda x: x / sqrt(list_dot_product(total, total))) as vector
  from numbered e join as_of a on a.customer_id = e.customer_id and a.place = e.place)"""
)


def _example_vectors(spark: SparkSession, d: str) -> DataFrame:
    """customer_id, place, model, split, used, vector of all examples, kept."""
    bought = T.prepared(spark, d)
    bounds = F.broadcast(purchases.split_bounds(bought))
    found = examples.example_vectors(bought, T.catalog(spark, d), T.DIMENSION, ties=T.TIES)
    split = purchases.split_of(F.col("purchase_date"), F.col("train_end"), F.col("validation_end"))
    return kept(found.crossJoin(bounds).select("customer_id", "place", "model", split.alias("split"), "used", "vector"))


@query(EXAMPLES + f" select customer_id, place, model, split, used, {M.format('list_dot_product(vector, visual::double[])')} as similarity_micro from held join catalog using (model)")
def example_similarities(spark: SparkSession, d: str) -> DataFrame:
    looks = T.catalog(spark, d).select("model", "visual")
    return _example_vectors(spark, d).join(looks, "model").select("customer_id", "place", "model", "split", "used", micro(V.dot(F.col("vector"), F.col("visual"))).alias("similarity_micro"))


@query(
    EXAMPLES
    + f""", asked as (select * from held where split = 'test'),
scores as (select customer_id, place, a.model as target, c.model, c.model_id, list_dot_product(a.vector, c.visual::double[]) as score from asked a, catalog c where c.visual is not null),
ranks as (
  select s.customer_id, s.place, 1 + count(*) filter (s.model <> s.target and (s.score > t.score or (s.score = t.score and s.model_id < t.model_id))) as rank
  from scores s join scores t on t.customer_id = s.customer_id and t.place = s.place and t.model = t.target group by 1, 2)
select {M.format("avg(case when rank <= 5 then 1.0 else 0.0 end)")} as recall_5, {M.format("avg(case when rank <= 10 then 1.0 else 0.0 end)")} as recall_10, {M.format("avg(case when rank <= 20 then 1.0 else 0.0 end)")} as recall_20,
  {M.format("avg(case when rank <= 10 then 1 / log2(rank + 1) else 0.0 end)")} as ndcg_10, {M.format("avg(1.0 / rank)")} as mrr, {M.format("avg(case when rank <= 10 then 1.0 else 0.0 end)")} as hit_rate, count(*) as examples from ranks"""
)
def example_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    models = T.catalog(spark, d).filter("visual is not null").select("model", F.col("model_id").alias("position"), F.col("visual").alias("vector"))
    target = models.select(F.col("model").alias("target"), F.col("position").alias("target_position"), F.col("vector").alias("target_vector"))
    asked = _example_vectors(spark, d).filter("split = 'test'").select(F.concat_ws("-", "customer_id", "place").alias("customer_id"), F.col("model").alias("target"), "vector")
    out = metrics.ranking_metrics(ranking.target_ranks(asked.join(target, "target"), models))
    return out.select(*[micro(F.col(c)).alias(c) for c in out.columns[:-1]], "examples")


@query(
    f"""with x as (select vec_id, abs(embedding[1]::double) as s from embeddings)
select vec_id, {M.format("(case when s <= 0.10 then 0.0 when s < 0.40 then 0.0 + (s - 0.10) * ((0.3333333333333333 - 0.0) / (0.40 - 0.10)) when s < 0.55 then 0.3333333333333333 + (s - 0.40) * ((1.0 - 0.3333333333333333) / (0.55 - 0.40)) else 1.0 end)")} as like_micro from x"""
)
def like_score_transform(spark: SparkSession, d: str) -> DataFrame:
    s = F.abs(F.col("embedding")[0].cast("double"))
    return T.read(spark, d, "embeddings").select("vec_id", micro(CURVE.transform(s)).alias("like_micro"))


def _curve_of(spark: SparkSession, held: DataFrame, catalog: DataFrame) -> DataFrame:
    """x, y of the curve fitted on held (example_id, target, vector): their targets against models drawn for each."""
    held, looks = kept(held), catalog.select("model", "visual")
    negatives = calibration.negative_sample(held.select("example_id", "target"), looks)
    pairs = held.select("example_id", F.col("target").alias("model"), F.lit(1).alias("label")).unionByName(negatives.select("example_id", F.col("negative").alias("model"), F.lit(0).alias("label")))
    scored = pairs.join(held.select("example_id", "vector"), "example_id").join(looks, "model")
    curve = calibration.fit(scored.select(V.dot(F.col("vector"), F.col("visual")).alias("similarity"), "label"))
    return spark.createDataFrame(list(zip(curve.x, curve.y)), "x double, y double")


@query()
def like_score_fit(spark: SparkSession, d: str) -> DataFrame:
    catalog = T.catalog(spark, d).filter("visual is not null")
    held = customers.mean_vectors(_held_out(spark, d), catalog, keep=("target",))
    return _curve_of(spark, held.withColumnRenamed("customer_id", "example_id"), catalog)


@query()
def example_calibrator(spark: SparkSession, d: str) -> DataFrame:
    train = _example_vectors(spark, d).filter("split = 'train'")
    held = train.select(F.concat_ws("-", "customer_id", "place").alias("example_id"), F.col("model").alias("target"), "vector")
    return _curve_of(spark, held, T.catalog(spark, d).filter("visual is not null"))


@query()
def negative_sample(spark: SparkSession, d: str) -> DataFrame:
    now = _current(spark, d).filter("excluded is null").select(F.col("customer_id").alias("example_id"), F.element_at("catalog_history", -1).alias("target"))
    return calibration.negative_sample(now, T.catalog(spark, d).filter("visual is not null"))


@query(
    with_tables("notices")
    + r""", read as (
  select notice_id, text, nullif(regexp_extract(text, '(?i)\b(CS\d{8,12})\b', 1), '') as app,
         nullif(regexp_extract(text, '(?i)(?:new\s*order|order\s*(?:number|confirmation))\s*[:#\s]*([A-Z]{0,3}\d{5,12})\b', 1), '') as labelled,
         nullif(regexp_extract(text, '#(\d{5,6})\b', 1), '') as hashed,
         nullif(regexp_extract(text, '(?:^|\D)(\d{5}_\d{3})', 1), '') as model,
         replace(nullif(regexp_extract(text, '(?i)(?:-|size)\s*((?:3[5-9]|4[0-2])(?:[.,][05])?)', 1), ''), ',', '.') as size
  from notices)
select notice_id, coalesce(upper(app), labelled, hashed) as order_number, model, size,
       coalesce(upper(app), labelled, hashed) is not null and (regexp_matches(text, '(?i)thank you for your order|your order number') or labelled is not null or app is not null) as strong from read"""
)
def order_fields(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return T.notices(spark, d).select("notice_id", E.order_number(text).alias("order_number"), E.model_code(text).alias("model"), E.shoe_size(text).alias("size"), E.strong_order(text).alias("strong"))


@query(
    with_tables("notices")
    + r""" select notice_id, coalesce(nullif(regexp_extract(text, '(?i)tracking(?:\s*(?:number|no\.?))?\s*[:#\s]*(\d{8,14})', 1), ''),
    case when regexp_matches(text, '(?i)on the way|packed') then nullif(regexp_extract(text, '(?:^|\D)(\d{9,12})(?:\D|$)', 1), '') end) as tracking_number,
  case when regexp_matches(text, '(?i)on the way|packed') then 'on_the_way' end as status from notices"""
)
def delivery_fields(spark: SparkSession, d: str) -> DataFrame:
    return T.notices(spark, d).select("notice_id", E.tracking_number(F.col("text")).alias("tracking_number"), E.delivery_status(F.col("text")).alias("status"))


KIND = "case when regexp_matches(text, '(?i)on the way|track shipment') then 'delivery_notice' when regexp_matches(text, '(?i)thank you for your order|new order|order confirmation|your order number') then 'order' end"


@query(with_tables("notices") + f" select notice_id, {KIND} as kind from notices")
def document_kind(spark: SparkSession, d: str) -> DataFrame:
    return T.notices(spark, d).select("notice_id", E.document_kind(F.col("text")).alias("kind"))


SCANNED = with_tables("scans") + r""", numbers as (
  select notice_id, text,
    list_concat(regexp_extract_all(text, '(?i)\b(CS\d{8,12})\b', 1), regexp_extract_all(text, '(?i)\b(BS\d{8,12})\b', 1)) as apps,
    upper(nullif(regexp_extract(text, '(?i)\b([CB][5S]|8S)(\d{8,12})\b', 1), '')) as misread, regexp_extract(text, '(?i)\b([CB][5S]|8S)(\d{8,12})\b', 2) as digits,
    nullif(regexp_extract(text, '(?i)(?:new\s*order|order\s*(?:number|confirmation)|אישור\s*הזמנה|מספר\s*הזמנה|הזמנה)\s*[:#\s]*([A-Z]{0,3}\d{5,12})\b', 1), '') as labelled,
    nullif(regexp_extract(text, '#(\d{5,6})\b', 1), '') as hashed,
    replace(nullif(regexp_extract(text, '(?i)(?:-|size|מידה)\s*((?:3[5-9]|4[0-2])(?:[.,][05])?)', 1), ''), ',', '.') as size,
    nullif(regexp_extract(text, '(?i)(?:מספר\s*משלוח|tracking(?:\s*(?:number|no\.?))?|shipment(?:\s*number)?)\s*[:#\s]*(\d{8,14})', 1), '') as named,
    regexp_matches(text, '(?i)on the way|בדרך|packed|ארוז') as moving, nullif(regexp_extract(text, '(?:^|\D)(\d{9,12})(?:\D|$)', 1), '') as bare,
    case when regexp_matches(text, '(?i)on the way|מספר משלוח|מעקב משלוח|track shipment') then 'delivery_notice'
      when regexp_matches(text, '(?i)thank you for your order|new order|order confirmation|your order number|אישור\s*הזמנה|מספר\s*הזמנה|הזמנתך') then 'order' end as kind
  from scans),
fields as (
  select *, coalesce(case when len(apps) > 0 then upper(list_reduce(apps, lambda a, b: case when length(b) > length(a) then b else a end)) end,
      case when misread in ('CS', 'C5') then 'CS' || digits when misread is not null then 'BS' || digits end, labelled, hashed) as order_number,
    coalesce(named, case when moving then bare end) as tracking_number
  from numbers),
scanned as (
  select *, order_number is not null and (coalesce(kind, '') = 'order' or labelled is not null or regexp_matches(order_number, '^CS\d{8,12}$')) as strong_order,
    tracking_number is not null and coalesce(kind, '') = 'delivery_notice' as strong_delivery from fields)"""


@query(
    SCANNED.replace("from scans)", "from notices)", 1).replace(T.SQL["scans"], T.SQL["notices"])
    + """, seen as (select *, notice_id % 4 = 0 as shoe, case notice_id % 4 when 1 then 'order' when 2 then 'garbage' else 'unknown' end as scene, case when notice_id % 3 = 0 then 0.4 else 0.12 end as junk from scanned)
select notice_id, case when strong_order then 'order' when strong_delivery then 'delivery_notice' when shoe then 'shoe' when coalesce(kind, scene) in ('order', 'delivery_notice') then coalesce(kind, scene)
  when scene = 'garbage' or (scene = 'unknown' and junk >= 0.1 + 0.05) then 'garbage' else 'unknown' end as kind from seen"""
)
def image_routing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("notice_id")
    scene = F.when(n % 4 == 1, "order").when(n % 4 == 2, "garbage").otherwise("unknown")
    junk = F.when(n % 3 == 0, 0.4).otherwise(0.12)
    return T.notices(spark, d).select("notice_id", decisions.route(F.col("text"), n % 4 == 0, scene, F.lit(0.1), junk).alias("kind"))


@query(SCANNED + " select notice_id, order_number, size, tracking_number, case when moving then 'on_the_way' end as status, kind, strong_order, strong_delivery from scanned")
def scanned_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of texts in Hebrew, with misread prefixes, and with several numbers."""
    text = F.col("text")
    return T.scans(spark, d).select(
        "notice_id", E.order_number(text).alias("order_number"), E.shoe_size(text).alias("size"), E.tracking_number(text).alias("tracking_number"), E.delivery_status(text).alias("status"),
        E.document_kind(text).alias("kind"), E.strong_order(text).alias("strong_order"), E.strong_delivery(text).alias("strong_delivery"),
    )


@query(
    SCANNED
    + """, seen as (select *, notice_id % 5 = 0 as shoe, ['unknown', 'order', 'garbage', 'delivery_notice', 'shoe', null][notice_id % 7 % 6 + 1] as scene,
  case when notice_id % 11 <> 0 then 0.2 end as footwear, [0.3, 0.22, null][notice_id % 13 % 3 + 1] as junk from scanned)
select notice_id, case when strong_order then 'order' when strong_delivery then 'delivery_notice' when shoe then 'shoe'
  when coalesce(kind, scene) in ('order', 'delivery_notice') then coalesce(kind, scene)
  when scene = 'garbage' then 'garbage' when coalesce(scene, '') <> 'shoe' and coalesce(junk, 0) >= coalesce(footwear, 0) + 0.05 then 'garbage' else 'unknown' end as route from seen"""
)
def scanned_routes(spark: SparkSession, d: str) -> DataFrame:
    """The routing of such texts beside scenes and scores that may be missing."""
    n = F.col("notice_id")
    pick = lambda at, *xs: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    scene = pick(n % 7 % 6, "unknown", "order", "garbage", "delivery_notice", "shoe", None)
    footwear, junk = F.when(n % 11 != 0, 0.2), pick(n % 13 % 3, 0.3, 0.22, None)
    return T.scans(spark, d).select("notice_id", decisions.route(F.col("text"), n % 5 == 0, scene, footwear, junk).alias("route"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A verifier's answer on three candidates for each image, in one of its forms of text."""
    v = F.col("vec_id")
    row = lambda i: F.struct(
        F.concat(F.lit("m"), ((v + i) % 5).cast("string")).alias("model"), F.when((v + i) % 3 == 0, "same").otherwise("different").alias("verdict"),
        *[((v * (i + 2) % 7) / 7.0 + 0.3).alias(c) for c in decisions.MEASURES],
        F.when(v % 4 == 0, F.array(F.lit("strap"))).otherwise(F.array().cast("array<string>")).alias("contradictions"), F.lit("").alias("reason"),
    )
    body = F.to_json(F.struct(F.array(row(0), row(1), row(5)).alias("candidates")))
    text = F.when(v % 3 == 0, body).when(v % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    return T.read(spark, d, "embeddings").select(v.alias("request_id"), decisions.parse_verdicts(F.when(v % 11 != 0, text)).alias("candidates"), F.array(*[F.lit(f"m{i}") for i in range(4)]).alias("retrieved"))


@query(
    f"""with rows as (
  select vec_id, i, 'm' || ((vec_id + i) % 5) as model, (vec_id + i) % 3 = 0 as same, least(vec_id * (i + 2) % 7 / 7.0 + 0.3, 1.0) as x from embeddings, (values (0), (1), (5)) t(i)),
good as (
  select vec_id, i, model, x from rows where same and model <> 'm4' and vec_id % 11 <> 0 and not (vec_id % 4 = 0 and x < 0.55) and not x < 0.55),
per as (select vec_id, count(*) as n, min(model) as model, min(x) as x, string_agg(model, ',' order by i) as names from good group by 1)
select e.vec_id as request_id, case when n = 1 then 'match' else 'uncertain' end as status, case when n = 1 then model end as model,
  {M.format("(case when n = 1 then x end)")} as confidence_micro,
  case when e.vec_id % 11 = 0 then 'verifier_failed' when n = 1 then 'unique_same_model' when n > 1 then 'ambiguous_same_models:' || names else 'no_unique_same_model' end as reason
from embeddings e left join per on e.vec_id = per.vec_id"""
)
def verifier_decision(spark: SparkSession, d: str) -> DataFrame:
    out = decisions.decide_identity(_requests(spark, d))
    return out.select("request_id", "status", "model", micro(F.col("confidence")).alias("confidence_micro"), "reason")


@query("select null::varchar as model, null::varchar as image_type, null::varchar as issue where false union all select model, image_type, 'duplicate_key' from (select label::varchar as model, case vec_id % 3 when 0 then 'main' when 1 then 'pers' else 'side' end as image_type, count(*) as n from embeddings group by all) where n > 1")
def catalog_integrity(spark: SparkSession, d: str) -> DataFrame:
    return integrity.catalog_issues(T.images(spark, d), T.VECTOR_MODEL, T.DIMENSION)


@query(
    with_tables("faulty_images")
    + """, told as (select *, len(embedding) as n, len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 as broken, abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 0.001 as off from faulty_images),
flags as (select model, image_type, unnest([case when embedding_model <> 'synthetic-64' then 'embedding_model' end, case when n <> 64 then 'dimension' end, case when n = 0 then 'empty' end,
  case when broken then 'non_finite' end, case when n > 0 and (broken or off) then 'norm' end]) as issue from told),
shared as (select min((model, image_type)) as k from faulty_images where len(embedding) > 0 group by embedding::varchar having count(distinct model) > 1)
select model, image_type, issue, count(*) as n from (
  select * from flags where issue is not null
  union all select model, image_type, 'duplicate_key' from faulty_images group by all having count(*) > 1
  union all select k[1], k[2], 'duplicate_vector' from shared) group by all"""
)
def catalog_faults(spark: SparkSession, d: str) -> DataFrame:
    """Images with a planted fault of each kind."""
    out = integrity.catalog_issues(T.faulty_images(spark, d), T.VECTOR_MODEL, T.DIMENSION)
    return out.groupBy("model", "image_type", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with stored as (select vec_id, case when vec_id % 7 = 0 then '' else sha256(vec_id::varchar) end as stored_hash from embeddings),
now as (select vec_id, sha256((case when vec_id % 5 = 0 then vec_id + 1 else vec_id end)::varchar) as current_hash from embeddings where vec_id % 9 <> 0)
select stored.vec_id::varchar as model, stored_hash = '' or current_hash is null or stored_hash <> current_hash as stale from stored left join now on stored.vec_id = now.vec_id"""
)
def stale_audit(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    e = T.read(spark, d, "embeddings").select(v, v.cast("string").alias("model"), F.lit("main").alias("image_type"))
    stored = e.withColumn("image_hash", F.when(v % 7 == 0, "").otherwise(F.sha2(v.cast("string"), 256)))
    now = e.filter(v % 9 != 0).withColumn("image_hash", F.sha2(F.when(v % 5 == 0, v + 1).otherwise(v).cast("string"), 256))
    return integrity.stale_images(stored, now).select("model", "stale")


MATCHED = (
    SCANNED
    + """, prompts as (
  select (select list(embedding::double[]) from embeddings where vec_id between 0 and 2) as footwear, (select list(embedding::double[]) from embeddings where vec_id between 3 and 5) as junk,
         (select list(embedding::double[]) from embeddings where vec_id between 6 and 8) as orders, (select list(embedding::double[]) from embeddings where vec_id between 9 and 11) as delivery),
crops as (
  select vec_id // 4 + 1 as image_id, vec_id % 4 as crop, [1.0, 0.5, 0.3, 0.05][vec_id % 4 + 1]::double as area, embedding::double[] as v,
    list_max(list_transform(footwear, lambda p: list_dot_product(embedding::double[], p))) as f, list_max(list_transform(junk, lambda p: list_dot_product(embedding::double[], p))) as j,
    list_max(list_transform(orders, lambda p: list_dot_product(embedding::double[], p))) as o, list_max(list_transform(delivery, lambda p: list_dot_product(embedding::double[], p))) as s
  from embeddings, prompts),
seen as (
  select image_id, crop, c.label::varchar as model, c.vec_id, c.vec_id % 3 as kind, list_dot_product(v, c.embedding::double[]) as score from crops, embeddings c where c.vec_id % 16 < 3),
models as (
  select *, row_number() over (partition by image_id, crop order by score desc, model) as rank from (
    select *, row_number() over (partition by image_id, crop, model order by score desc, vec_id) as turn from seen) where turn = 1),
scored as (
  select c.*, m.score, (crop = 0 or area >= 0.12) and (f >= j or m.score >= 0.62) as shoe from crops c join models m using (image_id, crop) where rank = 1),
best as (
  select image_id, first(crop order by round(score, 5) desc, crop = 0, area) filter (shoe) as best, first(crop order by round(score, 5) desc, crop = 0, area) as near, any_value(f) filter (crop = 0) as f, any_value(j) filter (crop = 0) as j, any_value(o) filter (crop = 0) as o, any_value(s) filter (crop = 0) as s
  from scored group by 1),
texts as (select notice_id as image_id, notice_id % 3 = 0 and strong_order as strong_order, notice_id % 3 = 0 and strong_delivery as strong_delivery, case when notice_id % 3 = 0 then kind end as doc from scanned),
told as (
  select b.*, coalesce(strong_order, false) as strong_order, coalesce(strong_delivery, false) as strong_delivery,
    coalesce(doc, case when o >= s and o >= j then 'order' when s >= j then 'delivery_notice' else 'garbage' end) as told,
    case when o >= f and o >= j then 'order' when f >= j then 'shoe' else 'garbage' end as scene
  from best b left join texts using (image_id)),
kinds as (
  select *, case when strong_order then 'order' when strong_delivery then 'delivery_notice' when best is not null then 'shoe' when told in ('order', 'delivery_notice') then told
    when scene = 'garbage' then 'garbage' else 'unknown' end as kind from told),
chosen as (select *, case kind when 'shoe' then best when 'unknown' then near else 0 end as crop from kinds)"""
)


def _matched(spark: SparkSession, d: str) -> DataFrame:
    e, at = T.read(spark, d, "embeddings"), F.col("vec_id")
    prompts = matching.Prompts(*[tuple(map(tuple, _prompts(e, low, low + 2))) for low in (0, 3, 6, 9)])
    share = F.get(F.array(*map(F.lit, (1.0, 0.5, 0.3, 0.05))), (at % 4).cast("int"))
    crops = e.select((F.floor(at / 4) + 1).alias("image_id"), (at % 4).cast("int").alias("crop"), share.alias("area_share"), F.col("embedding").cast("array<double>").alias("vector"))
    texts = T.scans(spark, d).filter("notice_id % 3 = 0").select(F.col("notice_id").alias("image_id"), "text")
    pictures = crops.select("image_id").distinct().join(texts, "image_id", "left")
    return matching.match_images(pictures, crops, T.images(spark, d).filter("position % 16 < 3"), prompts, top=5, verify_top=3)


@query(
    MATCHED
    + f""", listed as (select image_id, crop, string_agg(model, ',' order by rank) as models, max(score) as score from models where rank <= 5 group by 1, 2)
select image_id, kind, case when kind in ('shoe', 'unknown') then 'needs_verification' else kind end as status, c.crop::int as crop, c.crop > 0 as isolated,
  case when kind in ('shoe', 'unknown') then models else '' end as models, case when kind in ('shoe', 'unknown') then {M.format('score')} end as score_micro
from chosen c join listed using (image_id, crop)"""
)
def matched_images(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.transform("candidates", lambda c: c["model"]), ",")
    return _matched(spark, d).select("image_id", "kind", "status", "crop", "isolated", names.alias("models"), micro(F.col("catalog_score")).alias("score_micro"))


@query(
    MATCHED
    + """, slots as (
  select image_id, crop, rank, m.model, i.kind + 1 as spot from chosen c join models m using (image_id, crop)
  left join (select distinct label::varchar as model, vec_id % 3 as kind from embeddings where label <> 4) i on i.model = m.model where c.kind in ('shoe', 'unknown') and rank <= 3)
select image_id, 'customer,' || string_agg('candidate_' || rank || '/' || model || '/' || ['main', 'pers', 'side'][coalesce(spot, 1)], ',' order by rank, coalesce(spot, 1)) as slots, count(*) filter (spot is null) as without_views from slots group by 1"""
)
def matched_requests(spark: SparkSession, d: str) -> DataFrame:
    """What a verifier is asked; the models' views are those of all images, but one model has none."""
    views = T.images(spark, d).filter("model <> '4'").select("model", "image_type", F.concat_ws("/", F.lit("http://images"), "model", "image_type").alias("url")).distinct()
    asked = matching.verifier_request(_matched(spark, d), views, 3)
    told = F.transform("slots", lambda s: F.concat_ws("/", s["label"], s["model"], s["image_type"]))
    return asked.select("image_id", joined(told).alias("slots"), F.size(F.filter("slots", lambda s: s["model"].isNotNull() & s["url"].isNull())).cast("long").alias("without_views"))


REFRESH = """with images as (
  select vec_id, label::varchar as model, 'v' || vec_id as image_type, vec_id % 11 = 0 as changed, vec_id % 13 = 0 as blank from embeddings)
"""


@query(
    REFRESH.rstrip()
    + """, counts as (select count(*) as n, count(*) filter (changed or blank) as stale from images)
select unnest(['before', 'after_failure', 'after_refresh']) as moment, n as images, unnest([stale, stale, 0]) as stale, n - unnest([stale, stale, 0]) as fresh, unnest([1, 1, 2])::int as version from counts"""
)
def refresh_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audits of stored images: before, after a refresh that one image's failure stopped, and after a whole one."""
    e = T.read(spark, d, "embeddings")
    at, text = F.col("vec_id"), F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    named = e.select(at, F.col("label").cast("string").alias("model"), F.concat(F.lit("v"), at.cast("string")).alias("image_type"), "embedding", text.alias("text"))
    stored = named.select(
        "model", "image_type", F.when(at % 2 == 0, at + 1).alias("row_id"), at.alias("model_id"), F.lit(T.VECTOR_MODEL).alias("embedding_model"), F.lit(T.DIMENSION).alias("embedding_dimension"),
        F.col("text").alias("embedding"), F.when(at % 13 != 0, F.sha2("text", 256)).alias("image_hash"),
    )
    # what a source gives now: every eleventh image is another one
    now = named.withColumn("embedding", F.when(at % 11 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    hashes = now.select("model", "image_type", F.sha2(F.to_json(F.transform("embedding", lambda x: x.cast("double"))), 256).alias("image_hash"), F.lit(None).cast("string").alias("error"))
    store = VersionStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    store.swap(store.current(), [store.write(stored)])

    def audited(moment: str) -> DataFrame:
        version = store.current()
        out = integrity.audit(store.segment(version.segments[-1]), hashes)
        return out.agg(F.lit(moment).alias("moment"), F.count(F.lit(1)).alias("images"), F.count_if("stale").alias("stale"), F.count_if(~F.col("stale")).alias("fresh"), F.lit(version.number).alias("version"))

    before = audited("before")
    stale = kept(integrity.audit(store.segment(store.current().segments[-1]), hashes))
    try:
        # one image has no vector of the dimension
        integrity.refresh_store(store, stale, now.withColumn("embedding", F.when(at == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))), T.VECTOR_MODEL, T.DIMENSION)
    except Exception as error:
        if "INVALID_VECTOR" not in str(error):
            raise
    failed = audited("after_failure")
    integrity.refresh_store(store, stale, now, T.VECTOR_MODEL, T.DIMENSION)
    return before.unionByName(failed).unionByName(audited("after_refresh"))


@query("select p_partkey as model_id, p_brand as brand, p_size as size from part where p_brand = (select min(p_brand) from part) and p_size = 7")
def procedure_rows(spark: SparkSession, d: str) -> DataFrame:
    """A procedure with a JSON argument, called in SQL over the whole catalog."""
    parts = T.read(spark, d, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    parts.createOrReplaceTempView("fernweave_parts")
    spark.udtf.register("models_like", procs.filtering("model_id long, brand string, size int"))
    least = parts.agg(F.min("brand")).first()[0]
    return spark.sql("SELECT * FROM models_like(TABLE(fernweave_parts), :value)", {"value": procs.argument({"brand": least, "size": 7})})


TOWER_FIELDS = ("main_category", "theme", "color")


def _artifact(spark: SparkSession, d: str) -> artifact.Artifact:
    """Encoders fitted on these tables and weights from a seed, saved and loaded again."""
    catalog, numeric = T.catalog(spark, d), _tower_numeric(spark, d)
    vocabularies, scaler = artifact.fit_encoders(catalog, T.customers(spark, d), numeric.select(*[F.col("numeric")[i].alias(c) for i, c in enumerate(S.NUMERIC_FEATURES)]), TOWER_FIELDS)
    n = artifact.sizes(vocabularies)
    weights = towers.random_weights(T.DIMENSION, 64, {f: n[f] for f in TOWER_FIELDS}, n[artifact.AGE], len(S.NUMERIC_FEATURES), seed=42)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    artifact.save_artifact(artifact.Artifact(vocabularies, scaler, weights, {}, {"model_version": "seeded"}), path)
    return artifact.load_artifact(spark, path)


def _tower_numeric(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("history_length")
    numeric = S.numeric_features(n, n, F.col("recency_days"), F.col("tenure_days"), F.col("full_prices") / n, F.col("discounts") / n, F.col("avg_discount"))
    return kept(_current(spark, d).filter("excluded is null").select("customer_id", "catalog_history", "age_group", F.array(*numeric).alias("numeric")))


@query()
def tower_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best models of each customer by the two towers, through a loaded artifact with weights from a seed."""
    loaded = _artifact(spark, d)
    indexed = loaded.indexed(T.catalog(spark, d).filter("visual is not null"), TOWER_FIELDS)
    models = kept(towers.model_vectors(indexed.select("model", "visual", F.array(*[F.col(f"_{f}") for f in TOWER_FIELDS]).alias("categories")), loaded.weights))
    now = loaded.indexed(_tower_numeric(spark, d), ("age_group",)).select("customer_id", "catalog_history", F.col("_age_group").alias("age"), loaded.scaled("numeric").alias("numeric"))
    return ranking.rank_models(towers.customer_vectors(now, models, loaded.weights), models, 6).select("customer_id", "rank_for_customer", "model", micro(F.col("score")).alias("score_micro"))


@query(
    with_tables("catalog")
    + " "
    + " union all ".join(f"select '{f}' as field, {f} as token, (row_number() over (order by min(model_id), {f}) + 1)::int as index from catalog group by {f}" for f in TOWER_FIELDS)
    + " union all select 'age_group', c_mktsegment, (row_number() over (order by min(c_custkey::varchar), c_mktsegment) + 1)::int from customer group by c_mktsegment"
)
def artifact_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """The vocabularies of a loaded artifact."""
    return _artifact(spark, d).vocabularies.select("field", "token", F.col("index").cast("int").alias("index"))


CASES = """with c as (
  select a.vec_id::varchar as case_id, case when a.vec_id % 40 = 0 then 'screenshot' else 'packshot' end as kind, a.label::varchar as expected, b.embedding::double[] as original, a.embedding::double[] as isolated
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 20 = 0),
asked as (select case_id, kind, expected, unnest(['original', 'isolated']) as way, unnest([original, isolated]) as q from c),
best as (
  select case_id, kind, expected, way, label::varchar as model, max(list_dot_product(q, embedding::double[])) as score from asked, embeddings group by all),
ranked as (select *, row_number() over (partition by case_id, way order by score desc, model) as rank from best qualify rank <= 10),
paired as (
  select case_id, kind, expected, max(model) filter (way = 'original' and rank = 1) as original_top1, min(rank) filter (way = 'original' and model = expected) as original_rank,
    max(score) filter (way = 'original' and rank = 1) - max(score) filter (way = 'original' and rank = 2) as original_margin,
    max(model) filter (way = 'isolated' and rank = 1) as isolated_top1, min(rank) filter (way = 'isolated' and model = expected) as isolated_rank,
    max(score) filter (way = 'isolated' and rank = 1) - max(score) filter (way = 'isolated' and rank = 2) as isolated_margin
  from ranked group by 1, 2, 3)"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    e, at = T.read(spark, d, "embeddings"), F.col("vec_id")
    isolated = e.filter(at % 20 == 0).select(at.cast("string").alias("case_id"), F.when(at % 40 == 0, "screenshot").otherwise("packshot").alias("kind"), F.col("label").cast("string").alias("expected"), (at + 1).alias("_o"), F.col("embedding").alias("isolated"))
    cases = isolated.join(e.select(at.alias("_o"), F.col("embedding").alias("original")), "_o").drop("_o")
    return metrics.paired_ranks(cases, T.images(spark, d))


@query(CASES + f" select case_id, kind, original_top1, original_rank::int as original_rank, {M.format('original_margin')} as original_margin, isolated_top1, isolated_rank::int as isolated_rank, {M.format('isolated_margin')} as isolated_margin from paired")
def benchmark_cases(spark: SparkSession, d: str) -> DataFrame:
    out = _paired(spark, d)
    return out.select("case_id", "kind", *[c for w in ("original", "isolated") for c in (f"{w}_top1", f"{w}_rank", micro(F.col(f"{w}_margin")).alias(f"{w}_margin"))])


@query(
    CASES
    + " select count(*) as cases, "
    + ", ".join(f"{M.format(f'avg(case when {w}_rank <= {k} then 1.0 else 0.0 end)')} as {w}_recall_{k}" for w in ("original", "isolated") for k in (1, 3, 5, 10))
    + ", case when bool_and(coalesce(isolated_rank = 1, false)) and count(*) filter (isolated_rank = 1) >= count(*) filter (original_rank = 1) then 'not_required' else 'warranted' end as verdict from paired"
)
def benchmark_verdict(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.benchmark_verdict(_paired(spark, d))
    return out.select("cases", *[micro(F.col(c)).alias(c) for c in out.columns if "recall" in c], "verdict")


@query(
    """with marked as (
  select user_id, ts, value, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
numbered as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from marked)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events, floor(sum(value) * 1000 + 0.5)::bigint as value_milli from numbered group by user_id, n"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An extension beyond the retail operators."""
    out = streams.sessions(T.read(spark, d, "events"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("value_milli"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H') as hour, event_type, count(*) as events, floor(sum(value) * 1000 + 0.5)::bigint as value_milli from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension beyond the retail operators."""
    out = streams.window_counts(T.read(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("value_milli"))


HITS = with_tables("images") + SCORED + ", hits as (select query_id, model, image_type, position, s, row_number() over (partition by query_id order by s desc, position)::int as rank from scored qualify rank <= 10)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_images(_queries(spark, d), T.images(spark, d), 10)


@query(HITS + f" select query_id, model, {M.format('s')} as similarity_micro from hits where rank = 1 and s >= 0.2")
def production_hits(spark: SparkSession, d: str) -> DataFrame:
    return lookups.production_top(_hits(spark, d)).select("query_id", "model", micro(F.col("similarity")).alias("similarity_micro"))


@query(HITS + " select query_id, rank, position from hits where model = '3' and image_type = 'main'")
def hits_of_model(spark: SparkSession, d: str) -> DataFrame:
    return lookups.hits_of(_hits(spark, d), "3", "main").select("query_id", "rank", "position")


@query(HITS + """ select query_id, rank, format('{:>3d}  {:<16s} {:<5s} {:.4f}', rank, model, image_type, s) as line from hits""")
def hit_lines(spark: SparkSession, d: str) -> DataFrame:
    return lookups.hit_lines(_hits(spark, d))


@query(HITS + """ select query_id, rank::int as rank, format('{} | {} | {} | {:.6f}', rank, model, image_type, s) as line from hits union all select distinct query_id, 0, 'rank | model | image_type | similarity' from hits""")
def hit_table(spark: SparkSession, d: str) -> DataFrame:
    return lookups.image_table(_hits(spark, d))


@query(
    HITS
    + f""", expected as (select vec_id::varchar as query_id, label::varchar as model from embeddings where vec_id % 20 = 0),
per as (select query_id, max(s) filter (rank = 1) - max(s) filter (rank = 2) as margin from hits group by 1),
own as (select query_id, min(rank) as expected_rank from hits join expected using (query_id, model) group by 1)
select query_id, expected_rank, {M.format("margin")} as margin_micro, {", ".join(f"case when expected_rank <= {k} then 1 else 0 end as recall_{k}" for k in (1, 3, 5, 10))} from expected left join per using (query_id) left join own using (query_id)"""
)
def match_margins(spark: SparkSession, d: str) -> DataFrame:
    expected = T.read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("label").cast("string").alias("model"))
    out = lookups.margins(_hits(spark, d).withColumn("score", F.col("similarity")), expected)
    return out.select("query_id", "expected_rank", micro(F.col("margin")).alias("margin_micro"), *[F.col(f"recall_{k}").cast("int").alias(f"recall_{k}") for k in (1, 3, 5, 10)])


ORDERED = "array_to_string(list_sort(list(distinct case image_type when 'main' then '1main' when 'pers' then '2pers' when 'side' then '3side' else '4' || image_type end)), ',')"


@query(with_tables("images") + f" select model, regexp_replace({ORDERED}, '[0-9]', '', 'g') as views from images group by 1")
def views_of_models(spark: SparkSession, d: str) -> DataFrame:
    return lookups.ordered_views(T.images(spark, d)).select("model", joined(F.col("views")).alias("views"))


@query(HITS + f", views as (select model, regexp_replace({ORDERED}, '[0-9]', '', 'g') as v from images where model <> '4' group by 1) select query_id as request_id, string_agg(rank || ':' || model || ':' || coalesce(v, 'main'), ';' order by rank) as slots from hits left join views using (model) group by 1")
def verifier_requests(spark: SparkSession, d: str) -> DataFrame:
    """One model has no known views, and is asked about by its main one."""
    out = lookups.verifier_requests(_hits(spark, d).select(F.col("query_id").alias("request_id"), "rank", "model"), T.images(spark, d).filter("model <> '4'"))
    told = F.transform("slots", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["model"], joined(x["views"])))
    return out.select("request_id", F.array_join(told, ";").alias("slots"))


@query(with_tables("catalog") + " select vec_id, model_name as code from embeddings join catalog on vec_id = model_id where model_id % 4 <> 0")
def codes_of_ids(spark: SparkSession, d: str) -> DataFrame:
    codes = T.catalog(spark, d).select(F.col("model_id").alias("vec_id"), F.when(F.col("model_id") % 4 != 0, F.col("model_name")).otherwise(" ").alias("code"))
    return lookups.with_codes(T.read(spark, d, "embeddings").select("vec_id"), codes, "vec_id")


@query(
    """with flagged as (select label, vec_id, vec_id - row_number() over (partition by label order by vec_id) as island from (
  select l_orderkey % 50 as label, l_linenumber + 10 * (l_orderkey // 50) as vec_id from lineitem where l_quantity > 20))
select label, min(vec_id) as start, max(vec_id) + 1 as stop, max(vec_id) + 1 - min(vec_id) as length from flagged group by label, island having max(vec_id) + 1 - min(vec_id) >= 2"""
)
def value_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("label"), (F.col("l_linenumber") + 10 * F.expr("l_orderkey div 50")).alias("vec_id"), "l_quantity")
    return lookups.runs(rows, "label", "vec_id", F.col("l_quantity") > 20, 2)


@query(
    """with b as (select l_orderkey, l_linenumber, (l_partkey % 300)::int - 50 as x0, (l_suppkey % 200)::int - 40 as y0, (l_partkey % 300)::int + l_quantity::int * 4 - 60 as x1, (l_suppkey % 200)::int + l_quantity::int * 3 as y1 from lineitem),
c as (select *, least(greatest(x0, 0), 199) as l, least(greatest(y0, 0), 99) as t from b),
e as (select *, least(greatest(x1, l + 1), 200) as r, least(greatest(y1, t + 1), 100) as m from c)
select l_orderkey, l_linenumber, l as "left", t as top, r as "right", m as bottom, (r - l) * (m - t) < 0.92 * 200 * 100 as isolates from e"""
)
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    x, y = (F.col("l_partkey") % 300).cast("int"), (F.col("l_suppkey") % 200).cast("int")
    raw = F.struct((x - 50).alias("left"), (y - 40).alias("top"), (x + q * 4 - 60).alias("right"), (y + q * 3).alias("bottom"))
    box = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lookups.clamped_box(raw, F.lit(200), F.lit(100)).alias("box"))
    return box.select("l_orderkey", "l_linenumber", "box.*", lookups.isolates(F.col("box"), F.lit(200), F.lit(100)).alias("isolates"))


@query("select c_custkey as customer from customer where c_custkey is not null")
def customer_numbers(spark: SparkSession, d: str) -> DataFrame:
    return T.customers(spark, d).select(lookups.customer_number(F.concat(F.lit(" "), "customer_id")).alias("customer"))


@query(with_tables("images") + " select position, case when position % 5 <> 0 and position % 5 <> 1 then model end as model, case when position % 5 <> 0 and position % 5 <> 1 then image_type end as image_type from images")
def self_test_specs(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("position") % 5
    spec = F.when(at == 0, F.col("model")).when(at == 1, F.concat("model", F.lit("/back"))).otherwise(F.concat("model", F.lit("/ "), F.upper("image_type")))
    return T.images(spark, d).select("position", lookups.self_test(spec).alias("t")).select("position", "t.model", "t.image_type")


@query(with_tables("catalog", "prepared") + " select 0 as part, main_category as token, count(*) as n from catalog group by 2 union all select 1, season, count(*) from prepared group by 2")
def vocabulary_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = lookups.in_sequence(T.catalog(spark, d).select(F.col("main_category").alias("token")), T.prepared(spark, d).select(F.col("season").alias("token")))
    return rows.groupBy("part", "token").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("catalog") + " select model, color from catalog order by color desc, model limit 40 offset 25")
def view_page(spark: SparkSession, d: str) -> DataFrame:
    return datasets.select(T.catalog(spark, d), ("model", "color"), ("-color", "model"), 40, 25)


@query(
    """select o_orderkey as request_id, case when o_orderkey % 3 = 0 then 'match' else 'uncertain' end as status, case when o_orderkey % 3 = 0 then (o_orderkey % 7)::varchar end as model,
  case when o_orderkey % 3 = 0 and o_orderkey % 7 < 5 then (o_orderkey % 7) * 10 end as score, o_orderkey % 3 = 0 and o_orderkey % 7 >= 5 as synthesized from orders"""
)
def matched_candidates(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = T.read(spark, d, "orders")
    decided = orders.select(key.alias("request_id"), F.when(key % 3 == 0, "match").otherwise("uncertain").alias("status"), F.when(key % 3 == 0, (key % 7).cast("string")).alias("model"))
    among = orders.select(key.alias("request_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("m")).select("request_id", F.col("m").cast("string").alias("model"), (F.col("m") * 10).alias("score"), F.lit("main").alias("image_type"))
    return lookups.attach_candidates(decided, among).select("request_id", "status", "model", "score", "synthesized")


@query(
    r"""with kept as (select doc_id::varchar as case_key, case when doc_id % 7 <> 0 and trim(text, E' \t\n\x0b\f\r') <> '' then text else '.' end as recognition,
  case when doc_id % 5 <> 0 and trim(text, E' \t\n\x0b\f\r') <> '' then text when doc_id % 3 <> 0 then lang || ' ' || source else '.' end as told from documents where doc_id % 13 <> 0),
texts as (select case_key, 'r' as kind, recognition as text from kept union all select case_key, 'c', told from kept),
words as (select case_key, kind, unnest(regexp_split_to_array(lower('passage: ' || trim(regexp_replace(text, '[\t-\r]', ' ', 'g'))), ' +')) as w from texts),
places as (select case_key, kind, ('0x' || substr(md5(w), 1, 7))::int % 64 as place, count(*) as n from words group by all),
sums as (select case_key, kind, sqrt(sum(n * n)) as length, count(*) as filled from places group by all),
vectors as (select case_key, kind, any_value(filled) as filled, string_agg(place || ':' || floor(n / length * 1e6 + 0.5)::bigint, ' ' order by place) as v from places join sums using (case_key, kind) group by all)
select a.case_key, a.filled as recognition_places, a.v as recognition_vector, b.filled as case_places, b.v as case_vector from vectors a join vectors b on a.case_key = b.case_key and a.kind = 'r' and b.kind = 'c'"""
)
def memory_vectors(spark: SparkSession, d: str) -> DataFrame:
    """An index of the documents as cases, some without a key or with blank texts."""
    k = F.col("doc_id")
    cases = T.read(spark, d, "documents").select(
        F.when(k % 13 != 0, k.cast("string")).alias("case_key"), F.when(k % 7 != 0, F.col("text")).otherwise(" \n").alias("recognition_text"),
        F.when(k % 5 != 0, F.col("text")).alias("case_text"), F.when(k % 3 != 0, F.concat_ws(" ", "lang", "source")).alias("case_summary"),
    )
    out = memory_index.build_index(cases, memory_index.hashing_encoder())
    filled = lambda c: F.filter(F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] > 0)
    told = lambda c: F.array_join(F.transform(filled(c), lambda e: F.concat_ws(":", e["i"].cast("string"), micro(e["x"]).cast("string"))), " ")
    made = out.select("case_key", "recognition_vector", "case_vector")
    return made.select("case_key", *[x for c in ("recognition", "case") for x in (F.size(filled(F.col(f"{c}_vector"))).cast("long").alias(f"{c}_places"), told(F.col(f"{c}_vector")).alias(f"{c}_vector"))])


@query(
    HITS
    + """ select floor(sum(case when h.model = e.label::varchar then 1 else 0 end) / nullif(count(h.model), 0) * 1e6 + 0.5)::bigint as precision_micro, floor(count(h.model) / count(*) * 1e6 + 0.5)::bigint as coverage_micro
from embeddings e left join (select * from hits where rank = 1 and s >= 0.2 and position % 40 <> 0) h on h.query_id = e.vec_id::varchar where e.vec_id % 20 = 0"""
)
def decision_quality(spark: SparkSession, d: str) -> DataFrame:
    expected = T.read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("label").cast("string").alias("expected"))
    top = lookups.production_top(_hits(spark, d)).filter("position % 40 <> 0").select("query_id", F.col("model").alias("predicted"))
    out = metrics.decision_metrics(expected.join(top, "query_id", "left"))
    return out.select(micro(F.col("precision")).alias("precision_micro"), micro(F.col("coverage")).alias("coverage_micro"))


LAST_MONTHS = ", late as (select purchase_date from prepared where purchase_date > (select max(purchase_date) - interval 90 day from prepared)), days as (select distinct purchase_date::date as day from late), numbered as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n from days)"


@query(
    with_tables("prepared")
    + LAST_MONTHS
    + """, ends as (select n, least(floor(n * 0.7::double), n - 2) as low from numbered limit 1)
select strftime((select day from numbered where i = low), '%Y-%m-%d') as train_end, strftime((select day from numbered where i = least(greatest(floor(n * 0.85::double), low + 1), n - 1)), '%Y-%m-%d') as validation_end, 'default_quantiles' as strategy from ends
union all select '1997-06-01', '1997-09-01', 'configured'"""
)
def other_split_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds by quantiles of the days, where the purchases span too short a time, and bounds that are given."""
    bought = T.prepared(spark, d)
    last = bought.agg((F.max("purchase_date") - F.expr("INTERVAL 90 DAYS")).alias("since"))
    late = bought.join(F.broadcast(last), F.col("purchase_date") > F.col("since"))
    out = purchases.split_bounds(late).unionByName(purchases.split_bounds(bought, train_end="1997-06-01", validation_end="1997-09-01"))
    return out.select(day(F.col("train_end")).alias("train_end"), day(F.col("validation_end")).alias("validation_end"), "strategy")
