"""Further queries of the operators: the parts of their results that SQL can tell too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality_classifier import op7_quality_classifier
from .quality_rules import BASE, op9_quality_rules
from .sharding import op8_sharding


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of op9."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", *BASE, "base_failed")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums of op8, and whether texts share a shard and its slots run from 0 without gaps."""
    out = op8_sharding(spark, sf_dir)
    alone = F.count(F.lit(1)).over(W.partitionBy("shard", "slot")) == 1
    within = (F.col("slot") >= 0) & (F.col("slot") < F.count(F.lit(1)).over(W.partitionBy("shard")))
    same = F.min("shard").over(W.partitionBy("size", "text_crc32")) == F.max("shard").over(W.partitionBy("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", (alone & within).alias("gapless"), same.alias("together"))


def classifier_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is held out in op7, and that predictions follow from scores."""
    out = op7_quality_classifier(spark, sf_dir)
    follows = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.3).cast("int"))
    return out.select("doc_id", "held_out", follows.alias("follows"))


QUERIES = {"quality_base": quality_base, "shard_rows": shard_rows, "classifier_folds": classifier_folds}

#: The CRC-32 of a list of bytes, by a table of the remainders of all byte values.
CRC = """crcs as (
  select list(list_reduce([b] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) order by b) as t from range(256) r(b))"""


def _crc(column: str) -> str:
    pairs = f"list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda p: ('0x' || p)::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {pairs}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


SQL = {
    "quality_base": r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from d where len(ws) > 4),
told as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as five from windows),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, five) as n from told) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(5) r(k) group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
repeated as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1)
select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
       coalesce(r.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(ws) < 10 or 100 * coalesce(c.n, 0) > 20 * len(ws) as base_failed
from d left join covered c using (doc_id) left join repeated r using (doc_id)
""",
    "shard_rows": f"""
with {CRC}
select doc_id, strlen(coalesce(text, '')) + 8 as size, {_crc("coalesce(text, '')")} as text_crc32, true as gapless, true as together from documents, crcs
""",
    "classifier_folds": f"""
with {CRC}
select doc_id, {_crc("doc_id::varchar")} % 5 = 0 as held_out, true as follows from documents, crcs
""",
}
