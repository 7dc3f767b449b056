import zlib

import numpy as np
from pyspark.sql import functions as F

from fernweave.llm.sharding import differencing, shard_by_bytes

from .brute import differencing as plain

SCHEMA = "doc_id long, text string, shard string"


def test_differencing_balances_and_fills_loads():
    sizes = np.random.default_rng(1).integers(10, 10_000, 3000)
    loads = np.bincount(differencing(sizes, 24), sizes, 24)
    assert loads.max() - loads.min() < 100
    first = np.array([500_000, 0, 0, 300_000] + [0] * 20)
    loads = first + np.bincount(differencing(sizes, 24, first), sizes, 24)
    assert loads.max() - loads.min() < 100
    assert (differencing(np.array([3, 1, 1, 1]), 2) == differencing(np.array([3, 1, 1, 1]), 2)[0]).sum() == 1
    assert len(differencing(np.zeros(0, int), 5)) == 0


def test_law_groups_slots_crc(spark):
    texts = ["hot " * 30 if i % 3 == 0 else f"text {i} " * (i % 40 + 1) for i in range(4000)] + [None, "", "é" * 5]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, "lost", "x")]
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), per_block=300).collect()
    assert len(got) == len(rows)
    by_text, loads, slots = {}, np.zeros(24, np.int64), {}
    for r in got:
        text = "lost" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        by_text.setdefault(text, set()).add(r.shard)
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = next(iter(by_text["hot " * 30]))
    others = np.delete(loads, hot)
    assert others.max() - others.min() < 0.01 * others.mean()


def test_empty_and_one(spark):
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = shard_by_bytes(spark.createDataFrame([(1, "a", "x")], SCHEMA)).collect()
    assert row.slot == 0 and row.size == 9


def test_query_over_documents(spark):
    from fernweave.llm.sharding import op8_sharding

    out = op8_sharding(spark, "/root/testdata/sf0.01")
    loads = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 24 and max(loads) - min(loads) < 0.01 * sum(loads) / 24


def test_differencing_against_the_plain_method():
    random = np.random.default_rng(7)
    for shards in (2, 3, 5, 24):
        for n in (0, 1, 2, 7, 60):
            sizes = random.integers(1, 10**9, n)  # so large that no spreads are equal
            loads = np.bincount(differencing(sizes, shards), sizes, shards) if n else np.zeros(shards)
            assert sorted(loads.astype(int)) == sorted(plain(sizes.tolist(), shards) if n else [0] * shards)
