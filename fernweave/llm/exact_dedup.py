"""Exact dedup by content sort.

Texts are equal when they are identical after white space (space, tab, newline, vertical tab, form feed, carriage
return) is deleted. Sampled splitters range-partition the normalised bytes, Spark's external sort places equals side by
side, and a window compares neighbours in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of, written

WHITE_SPACE = " \t\n\x0b\x0c\r"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, prefix_chars: int = 16) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest id (nulls last).

    The range key is the first characters of the normalised text, its digest and a salt of the id: the splitters that
    the driver gathers stay small however long texts are, a common opening spreads by digest, and a group of copies
    spreads over `salts` ranges. Each range compares neighbours byte by byte; the heads of the ranges, at most `salts`
    a group, then meet by digest.

    A very long text is one row of one range's sort, which spills. Null and empty texts are equal to each other and to texts of white space. Rows that repeat in full count as copies:
    one of them stays. Null ids compare last. Other columns are not read. An empty table gives an empty result.
    """
    text = text_of(docs, text_col)
    normal = F.translate(text, WHITE_SPACE, "")
    rows = docs.select(
        docs[id_col].alias("id"),
        normal.alias("normal"),
        F.length(text).alias("chars"),
        F.pmod(F.xxhash64(docs[id_col], F.spark_partition_id()), F.lit(salts)).cast("int").alias("salt"),
    ).withColumns({"prefix": F.substring("normal", 1, prefix_chars), "sha": F.sha2("normal", 256)})
    rows = rows.repartitionByRange("prefix", "sha", "salt")
    equal = W.partitionBy("prefix", "sha", "salt", "normal")
    ranked = equal.orderBy(F.desc("chars"), F.asc_nulls_last("id"))
    narrow = written(
        rows.select(
            "id",
            "sha",
            "salt",
            "chars",
            F.row_number().over(ranked).alias("place"),
            F.count(F.lit(1)).over(equal).alias("here"),
        )
    )
    same = W.partitionBy("sha")
    best = same.orderBy(F.desc("chars"), F.asc_nulls_last("id"), "salt")
    heads = narrow.filter("place = 1").select(
        "sha",
        "salt",
        F.first("id").over(best).alias("keep_id"),
        F.first("salt").over(best).alias("keep_salt"),
        F.sum("here").over(same).alias("group_size"),
    )
    return narrow.join(heads, ["sha", "salt"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by normal) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       sha256(normal) as text_sha256
from d
window w as (partition by normal order by chars desc, doc_id)
"""
