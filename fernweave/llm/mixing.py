"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, without, written

#: A rate above this is drawn as a sum of that many parts, so that exp(-rate) stays above zero.
PART = 500.0


def uniform(*parts: Column) -> Column:
    """In [0, 1): 48 bits of the MD5 of the parts, joined by colons."""
    hexes = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)
    return F.conv(hexes, 16, 10).cast("long") / F.lit(float(2**48))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """source (null: empty), n, rate: how often a document of the source is repeated on average.

    weights maps sources to parts of the mixture; sources that it lacks get none. Without it a source's weight is its
    count to the power temperature. The expected output has epochs times as many rows as docs.
    """
    counts = docs.groupBy(F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        named = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, weight double")
        counts = counts.join(named, "source", "left").fillna(0.0, ["weight"])
    counts = written(counts)
    # summed as decimals, so that the total doesn't depend on the order of rows
    n, weight = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("weight").cast("decimal(38,12)")).cast("double"), F.lit(0.0))).first()
    share = F.lit(float(epochs * n)) * F.col("weight") / F.lit(weight or 1.0)
    return counts.select("source", "n", (share / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", max_broadcast_sources: int = 10_000) -> DataFrame:
    """docs, each row as often as its Poisson draw says, shuffled; with replica (from 1), n_replicas, shuffle_key.

    The draw inverts the Poisson distribution of the source's mean rate at a number in [0, 1) that the seed and the id
    fix, so any run gives the same result. Rows go to partitions by a random key and are sorted by it there.

    The rates, a row per source, are broadcast up to max_broadcast_sources of them; beyond, the join is a plain one
    whose hot keys adaptive execution splits.

    A null source is a source of its own, the empty one. Rows with equal ids, or null ids, get equal draws, as rows that
    repeat do. Texts, null, empty or very long, are copied with their rows and not looked at. Input columns named like the three new ones are replaced. An empty table gives an empty result.
    """
    docs = without(docs, "replica", "n_replicas", "shuffle_key")
    s, rate, parts, cdf, u = fresh(docs, "source_key", "rate", "parts", "cdf", "u")
    rates = source_rates(docs, weights, temperature, epochs, source_col)
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("part", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("part") + 12 * F.sqrt("part") + 30).cast("int")

    def grow(state: Column, k: Column) -> Column:
        p = state["p"] * state["mean"] / k
        return F.struct(p.alias("p"), state["mean"].alias("mean"), F.array_append(state["c"], F.element_at(state["c"], -1) + p).alias("c"))

    p0 = F.exp(-F.col("part"))
    start = F.struct(p0.alias("p"), F.col("part").alias("mean"), F.array(p0).alias("c"))
    rates = written(rates.select(F.col("source").alias(s), F.col("parts").alias(parts), F.aggregate(F.sequence(F.lit(1), last), start, grow)["c"].alias(cdf)))
    keyed = docs.withColumn(s, F.coalesce(docs[source_col].cast("string"), F.lit("")))
    if rates.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources:
        rates = F.broadcast(rates)
    ident = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(str(seed)), ident, j.cast("string")))
    drawn = keyed.join(rates, s).withColumn(u, draws)
    count = F.aggregate(u, F.lit(0), lambda a, x: a + F.size(F.filter(cdf, lambda c: c <= x)))
    drawn = drawn.withColumn("n_replicas", count).filter("n_replicas > 0")
    out = drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("n_replicas"))).alias("replica"), "n_replicas")
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(out[id_col].cast("string"), F.lit("")), out["replica"].cast("string"))), 1, 16)
    spread = F.pmod(F.xxhash64(*[c for c in docs.columns if c != id_col]), F.lit(64)) if docs.columns != [id_col] else F.lit(0)
    # rows of one id, or without one, share a key but not all of them a partition
    return out.withColumn("shuffle_key", key).repartition("shuffle_key", spread).sortWithinPartitions("shuffle_key")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = """
with recursive counts as (select coalesce(source, '') as s, count(*) as n, sqrt(count(*)) as weight from documents group by 1),
rates as (select s, (select sum(n) from counts)::double * weight / (select sum(weight) from counts) / n as rate from counts),
cdf as (
  select s, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all
  select s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < rate + 12 * sqrt(rate) + 30),
lists as (select s, list(c) as cs from cdf group by s),
drawn as (
  select d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 12))::bigint / 281474976710656.0))::int as n_replicas
  from documents d join lists on s = coalesce(source, ''))
select d.*, replica::int as replica, substr(md5('order 17:' || doc_id || ':' || replica), 1, 16) as shuffle_key
from drawn d, unnest(range(1, n_replicas + 1)) as t(replica)
"""
