"""A Merkle manifest of a dataset by superblock reduction.

Rows hash to leaves, ordered by id in their group. Indices are bucketed by fanout^levels; a bucket's task collapses that
many levels and gives each leaf its lower proof. The buckets' roots are reduced in the same way until one node a group is
left, and lower and upper proofs are concatenated. The groups' roots are reduced likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, reachable, table, written

#: A level's entry in a path: 16 * place + length of the run, in one byte.
MOST_FANOUT = 15


def leaf_hash(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _node(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _collapse(hashes: list[str], fanout: int, levels: int) -> tuple[str, list[bytes], list[bytes]]:
    """The node that levels levels make of consecutive nodes, and each node's path and siblings."""
    paths, siblings = [b""] * len(hashes), [b""] * len(hashes)
    below, width = hashes, 1
    for _ in range(levels):
        runs = [below[i : i + fanout] for i in range(0, len(below), fanout)]
        raw = [[bytes.fromhex(h) for h in run] for run in runs]
        for leaf in range(len(hashes)):
            run, place = divmod(leaf // width, fanout)
            own = raw[run]
            paths[leaf] += bytes([16 * place + len(own)])
            siblings[leaf] += b"".join(own[:place] + own[place + 1 :])
        below, width = [_node(run) for run in runs], width * fanout
    return below[0], paths, siblings


def _depth(nodes: int, fanout: int) -> int:
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def _proofs(nodes: DataFrame, most: int, fanout: int, levels: int) -> DataFrame:
    """nodes (g, idx from 0 in g, n nodes in g, hash, and others) with path, siblings and root of g; no g has more than most."""
    block = fanout**levels
    kept = [f for f in nodes.schema.fields if f.name != "bucket"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", bucket long, path binary, siblings binary, root string"

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        root, paths, siblings = _collapse(pdf["hash"].tolist(), fanout, min(levels, _depth(int(pdf["n"].iat[0]), fanout)))
        return pdf.assign(path=paths, siblings=siblings, root=root)

    low = nodes.withColumn("bucket", F.floor(F.col("idx") / block)).groupBy("g", "bucket").applyInPandas(collapse, schema)
    low = written(low)
    if most <= block:
        return low
    tops = low.filter(F.col("idx") % block == 0).select("g", F.col("bucket").alias("idx"), F.ceil(F.col("n") / block).alias("n"), F.col("root").alias("hash"))
    upper = _proofs(tops, -(-most // block), fanout, levels).select("g", F.col("idx").alias("bucket"), F.col("path").alias("up"), F.col("siblings").alias("aside"), F.col("root").alias("top"))
    return low.join(upper, ["g", "bucket"]).select(
        *[f.name for f in kept], "bucket", F.concat("path", "up").alias("path"), F.concat("siblings", "aside").alias("siblings"), F.col("top").alias("root")
    )


def _placed(rows: DataFrame, *order: str) -> tuple[DataFrame, int, list[DataFrame]]:
    """rows with idx, the place from 0 in its group g by order, and n, the group's rows; the largest n; the files in use.

    Ranges of (g, *order) are sorted where they lie; what is shuffled besides is one row for each range and group in it.
    """
    sorted_rows = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("mid", F.monotonically_increasing_id())
    placed = written(sorted_rows.withColumn("part", F.shiftright("mid", 33)))
    ahead = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = written(
        placed.groupBy("part", "g")
        .agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("here"))
        .select("part", "g", "first", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("before"), F.sum("here").over(W.partitionBy("g")).alias("n"))
    )
    most = starts.agg(F.max("n")).first()[0] or 0
    out = placed.join(starts, ["part", "g"]).withColumn("idx", F.col("before") + F.col("mid") - F.col("first"))
    return out.drop("part", "mid", "first", "before"), most, [placed, starts]


def merkle_manifest(rows: DataFrame, leaf: str = "leaf", id_col: str = "doc_id", group_col: str = "source", fanout: int = 3, levels: int = 7) -> DataFrame:
    """rows with path and siblings (binary), subroot and root (hex); columns of these names are replaced.

    leaf: the column with a row's hash, in lowercase hex. In each group leaves ascend by id (nulls first, then by hash);
    while a group has several nodes, each fanout consecutive ones become their hash; what remains is the group's
    subroot. The subroots, ordered by group (null first, by bytes), give root in the same way. path has a byte a level, 16 *
    place in the run + length of the run, and siblings the other members' digests, 32 bytes each, level by level.

    A bucket of fanout^levels leaves is a task's unit, so the largest group is spread like all others; a group's
    size grows only the number of buckets. Rows that repeat in full are leaves of their own, side by side; null and empty
    values are hashed by leaf_hash alone, very long texts where they lie. A group of one row has its leaf as subroot, with
    an empty path. An empty table gives an empty result.
    """
    if not 2 <= fanout <= MOST_FANOUT:
        raise ValueError(f"fanout must be between 2 and {MOST_FANOUT}")
    reachable(rows.sparkSession)
    own = {"path", "siblings", "subroot", "root"}
    others = [c for c in rows.columns if c.lower() not in own]
    names = {c: f"c{i}" for i, c in enumerate(others)}
    # null groups come first, all others after them by bytes
    g = F.when(rows[group_col].isNull(), "").otherwise(F.concat(F.lit("+"), rows[group_col].cast("string")))
    inner = written(rows.select(*[rows[c].alias(n) for c, n in names.items()], g.alias("g"), rows[leaf].alias("hash"), F.monotonically_increasing_id().alias("tie")))
    placed, most, files = _placed(inner, names[id_col], "hash", "tie")
    discard(inner)
    low = _proofs(placed.drop("tie"), most, fanout, levels)
    discard(*files)
    tops = low.filter("idx = 0").select("g", F.col("root").alias("subroot"))
    groups, count, files = _placed(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("subroot").alias("hash")), "of")
    upper = _proofs(groups, count, fanout, levels).select(F.col("of").alias("g"), F.col("path").alias("up"), F.col("siblings").alias("aside"), F.col("root").alias("all"))
    discard(*files)
    return low.join(upper, "g").select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.concat("path", "up").alias("path"),
        F.concat("siblings", "aside").alias("siblings"),
        F.col("root").alias("subroot"),
        F.col("all").alias("root"),
    )


def _folded(leaf: str, path: bytes, siblings: bytes) -> str:
    at = 0
    for step in path:
        place, run = divmod(step, 16)
        others = [siblings[at + 32 * i : at + 32 * (i + 1)].hex() for i in range(run - 1)]
        leaf, at = _node(others[:place] + [leaf] + others[place:]), at + 32 * (run - 1)
    return leaf


def folded(leaf: str, path: str = "path", siblings: str = "siblings") -> Column:
    """The root that a leaf has by its path and siblings. Null where one of them is null."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for leaves, paths, others in batches:
            yield pd.Series([None if h is None or p is None or s is None else _folded(h, p, s) for h, p, s in zip(leaves, paths, others)], dtype=object)

    return fold(leaf, path, siblings)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [docs[c] for c in FIELDS]
    chosen = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    changed = F.when(chosen, leaf_hash([*fields[:-1], F.translate(docs["text"], "\n", "")]))
    leaves = docs.select("doc_id", "source", leaf_hash(fields).alias("leaf"), changed.alias("tampered"))
    proved = merkle_manifest(leaves).withColumn("delivered", F.coalesce("tampered", "leaf")).withColumn("folded_root", folded("delivered"))
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = r"""
with recursive d as (
  select doc_id, case when source is null then '' else '+' || source end as g, source, lang, n_chars, text,
         list_reduce([4294967295] || flatten(list_transform(range(length(cast(doc_id as varchar))),
                       lambda i: list_transform(range(8), lambda j: case when j = 0 then ascii(substr(cast(doc_id as varchar), i + 1, 1)) else 0 end))),
                     lambda c, s: xor(xor(c, s) >> 1, 3988292384 * (xor(c, s) & 1))) as register
  from documents),
f as (
  select doc_id, g, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as front,
         text, replace(text, chr(10), '') as cut, (register & 1) = 1 as tampered from d),
leaves as (
  select doc_id, g, sha256(front || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when tampered then sha256(front || coalesce(strlen(cut) || ':' || cut, '-')) end as other,
         row_number() over (partition by g order by doc_id) - 1 as idx
  from f),
low as (
  select 0 as lv, g, idx, count(*) over (partition by g) as n, leaf as h from leaves
  union all
  select lv + 1, g, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by idx)) from low where n > 1 group by lv, g, idx // 3),
subroots as (select g, h, row_number() over (order by g) - 1 as idx from low where n = 1),
high as (
  select 0 as lv, idx, count(*) over () as n, h from subroots
  union all
  select lv + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by idx)) from high where n > 1 group by lv, idx // 3),
tree as (
  select lv, g, idx, h from low where n > 1
  union all
  select 1000 + high.lv, s.g, high.idx, high.h from high, subroots s where high.n > 1),
runs as (
  select g, lv, idx // 3 as run, list(h order by idx) as hs from tree group by all),
spots as (
  select doc_id, l.g, idx, leaf, other, lv, hs, 1 + (idx // (3**lv)::bigint) % 3 as place
  from leaves l join runs r on r.g = l.g and lv < 1000 and run = (idx // (3**lv)::bigint) // 3
  union all
  select doc_id, l.g, l.idx, leaf, other, lv, hs, 1 + (s.idx // (3**(lv - 1000))::bigint) % 3
  from leaves l join subroots s on s.g = l.g join runs r on r.g = l.g and lv >= 1000 and run = (s.idx // (3**(lv - 1000))::bigint) // 3),
steps as (
  select g, idx, row_number() over (partition by g, idx order by lv) as step,
         array_to_string(hs[:place - 1], '') as ahead, array_to_string(hs[place + 1:], '') as behind
  from spots),
proofs as (select g, idx, string_agg(ahead || behind, '' order by step) as proof, count(*) as depth from steps group by all),
fold as (
  select g, idx, 0 as step, coalesce(other, leaf) as h from leaves
  union all
  select f.g, f.idx, f.step + 1, sha256(s.ahead || f.h || s.behind) from fold f join steps s on s.g = f.g and s.idx = f.idx and s.step = f.step + 1)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(coalesce(p.proof, '')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from leaves l join subroots s using (g) cross join (select h from high where n = 1) r
left join proofs p on p.g = l.g and p.idx = l.idx
join fold f on f.g = l.g and f.idx = l.idx and f.step = coalesce(p.depth, 0)
"""
