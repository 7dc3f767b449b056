"""A corpus pipeline of five stages: rules, line dedup, near dedup, mixing, tokens.

In all stages very long texts are read whole, in chunks where they are large, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.bpe import bpe
from fernweave.llm.common import discard, table, written
from fernweave.llm.line_dedup import dedup_lines
from fernweave.llm.mixing import mix_sources
from fernweave.llm.near_dedup import drop_near_duplicates
from fernweave.llm.quality_rules import quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


READ = ("doc_id", "text", "lang", "source")


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that operators don't read under names that no operator's own columns have, and these names."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    return docs.withColumnsRenamed(names), names


def restored(out: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail them; of rows that repeat all stay or go; a distance
    at its threshold passes. Other columns stay."""
    own, names = shielded(docs)
    return restored(quality_rules(own).filter("kept"), docs, names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; those of which nothing is left go. n_chars is that of the new text.

    Texts that were empty or null before stay as they are; rows that repeat are one document, and all lose the same lines. Of
    documents with equal passages that of the smallest id keeps them.
    """
    own, names = shielded(docs)
    out = dedup_lines(own).filter((F.col("removed_lines") == 0) | (F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0))
    if "n_chars" in names:
        n = names["n_chars"]
        out = out.withColumn(n, F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return restored(out, docs, names)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id, nulls first. Null and empty texts are one
    class; of rows that repeat one stays; pairs at the threshold are alike."""
    return drop_near_duplicates(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate says, in random order. A null source is a source of its own; rows that repeat are drawn alike.
    Rows of equal keys come in any order."""
    own, names = shielded(docs)
    return restored(mix_sources(own), docs, names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, and digests of the ids and of what they decode to. Null and empty texts have no ids."""
    out = bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [("quality rules", rules), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("byte-level BPE", tokens)]

#: SQL can't express the alignment, the sampling or the merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one is written, so one corpus at a time is kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
