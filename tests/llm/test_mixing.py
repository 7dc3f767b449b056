from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernweave.llm.mixing import PART, mix_sources

from .brute import poisson_counts

SCHEMA = "doc_id long, source string, text string, rate string, replica string"


def rows(n):
    return [(i, None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", f"t{i}", "r", "mine") for i in range(n)]


def test_against_plain_inversion(spark):
    data = rows(2000)
    got = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    counts = Counter(r.doc_id for r in got)
    assert [counts[i] for i in range(2000)] == poisson_counts([(r[0], r[1]) for r in data])
    assert all(r.rate == "r" and r.n_replicas == counts[r.doc_id] and 1 <= r.replica <= r.n_replicas for r in got)


def test_both_joins_agree(spark):
    df = spark.createDataFrame(rows(500), SCHEMA)
    a, b = (sorted((r.doc_id, r.replica, r.shuffle_key) for r in mix_sources(df, max_broadcast_sources=m).collect()) for m in (10_000, 1))
    assert a == b


def test_weights_and_large_rates(spark):
    df = spark.createDataFrame([(i, "rare" if i == 0 else "big", "t", "r", "x") for i in range(4000)], SCHEMA)
    got = mix_sources(df, {"rare": 1.0, "big": 1.0}).groupBy("source").agg(F.count(F.lit(1))).collect()
    counts = dict(got)
    assert 2000 > PART and counts["rare"] == pytest.approx(2000, rel=0.1) and counts["big"] == pytest.approx(2000, rel=0.1)
    assert mix_sources(df, {"rare": 1.0}, epochs=0.01).filter("source = 'big'").isEmpty()


def test_order_is_mixed_empty_and_null_ids(spark):
    ids = [r.doc_id for r in mix_sources(spark.createDataFrame(rows(2000), SCHEMA)).collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.4 < rising < 0.6
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None)] * 20, SCHEMA)
    assert len({r.n_replicas for r in mix_sources(odd).collect()}) <= 1
