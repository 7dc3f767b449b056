"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. The partial partitions with the largest spread are combined again and again, one
in rising and the other in falling order, until one partition of all groups is left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import reachable, table, text_of, written

#: Groups above this part of a shard's mean load are placed first, on the driver: at most shards * BIG of them exist.
BIG = 64


def differencing(sizes: np.ndarray, shards: int, loads: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item so that loads + sizes are near equal.

    loads is a first partial partition whose slots are the shards themselves; it takes part in the combining.
    """
    n = len(sizes)
    loads = np.zeros(shards, np.int64) if loads is None else np.asarray(loads, np.int64)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.argsort(loads, kind="stable")  # slot -> shard of the loads' own leaf
    # nodes 0..n-1 are items, n is the loads, the rest are combinations
    values: dict[int, np.ndarray] = {n: loads[first] - loads.min()}
    heap = [(-int(s), i) for i, s in enumerate(sizes)] + [(-int(values[n][-1]), n)]
    heapq.heapify(heap)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.empty((n, shards), np.int16)

    def value(i: int) -> np.ndarray:
        if i >= n:
            return values.pop(i)
        leaf = np.zeros(shards, np.int64)
        leaf[-1] = sizes[i]
        return leaf

    for step in range(n):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = value(a) + value(b)[::-1]
        rank = np.argsort(both, kind="stable")
        both = both[rank]
        left[step], right[step], order[step] = a, b, rank
        node = n + 1 + step
        values[node] = both - both[0]
        heapq.heappush(heap, (-int(both[-1] - both[0]), node))
    labels: dict[int, np.ndarray] = {2 * n: np.arange(shards)}
    out, own = np.empty(n, np.int64), None
    for step in range(n - 1, -1, -1):
        here = labels.pop(n + 1 + step)
        for child, slots in ((left[step], order[step]), (right[step], shards - 1 - order[step])):
            theirs = np.empty(shards, np.int64)
            theirs[slots] = here
            if child < n:
                out[child] = theirs[-1]
            elif child == n:
                own = theirs
            else:
                labels[int(child)] = theirs
    shard_of = np.empty(shards, np.int64)
    shard_of[own] = first
    return shard_of[out]


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", per_block: int = 2000, buckets: int = 256) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 8. Rows of equal text share a shard; the shards' bytes are near equal, as far as
    one group isn't larger than a shard. slot: gapless from 0 in each shard.

    Rows are pre-aggregated to groups. The few groups above 1/BIG of a shard are combined first; all others, about
    per_block a block, are combined block by block in parallel, each block starting from its part of the first loads,
    so that what the large groups leave uneven is filled by the small ones. Each block ends with a spread of about its
    smallest group.

    Null texts count as empty and form one group with empty texts. A very long text is hashed where it lies and isn't
    shuffled. Repeated rows keep a slot each; null ids are placed like others. Other columns are not read. An empty table
    gives an empty result.
    """
    reachable(docs.sparkSession)
    text = text_of(docs, text_col)
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
    )
    groups = written(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    large = F.col("bytes") * (shards * BIG) > total
    big = sorted((r for r in groups.filter(large).collect()), key=lambda r: (r.bytes, r.k1, r.k2))
    placed = differencing(np.array([r.bytes for r in big], np.int64), shards)
    loads = np.zeros(shards, np.int64)
    np.add.at(loads, placed, np.array([r.bytes for r in big], np.int64))
    rest = max(1, total - int(loads.sum()))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "k1", "k2"], ignore_index=True)
        sizes = pdf["bytes"].to_numpy(np.int64)
        share = (loads * (sizes.sum() / rest)).round().astype(np.int64)
        # without large groups the slots are alike: start at another shard in each block
        turn = int(pdf["block"].iat[0]) % shards
        shard = differencing(sizes, shards, np.roll(share, -turn))
        return pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "shard": ((shard + turn) % shards).astype("int32")})

    blocks = max(1, -(-n // per_block))
    schema = "k1 long, k2 long, shard int"
    small = groups.filter(~large).withColumn("block", F.pmod(F.xxhash64("k2", "k1"), F.lit(blocks))).groupBy("block").applyInPandas(block, schema)
    spark = docs.sparkSession
    homes = small.unionByName(spark.createDataFrame([(r.k1, r.k2, int(s)) for r, s in zip(big, placed)], schema))
    # homes comes from groups, so both sides of the join are exchanged alone and a hot text is split as a skewed join
    put = written(rows.join(homes, ["k1", "k2"]).select("id", "size", "crc", "shard", F.pmod(F.xxhash64(F.lit("slot"), "id", F.spark_partition_id()), F.lit(buckets)).alias("bucket")))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # shards * buckets rows at most
    before = put.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("shard", "bucket").orderBy("id", "size", "crc")
    return (
        put.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(before), ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("place")).alias("slot"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
