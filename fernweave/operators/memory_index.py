"""Vectors of texts by feature hashing, and the index of case memories that any encoder builds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text is encoded as.
PREFIXES = ("passage", "query")

Encoder = Callable[[Column, str], Column]


def hashing_encoder(dimension: int = 64) -> Encoder:
    """encode(text, prefix): the unit vector of how many words a hash puts into each place; the prefix counts as a word.

    The words are lower case and parted by ASCII white space. Null and blank texts raise TEXT_REQUIRED.
    """

    @F.pandas_udf("array<double>")
    def unit_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            counts = (np.bincount(p, minlength=dimension).astype(float) for p in places)
            yield pd.Series([c / np.sqrt(c @ c) for c in counts], dtype=object)

    def encode(text: Column, prefix: str) -> Column:
        if prefix not in PREFIXES:
            raise ValueError("INVALID_TEXT_PREFIX")
        clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r]", " "))
        told = F.when(clean != "", clean).otherwise(F.raise_error(F.lit("TEXT_REQUIRED")).cast("string"))
        words = F.split(F.lower(F.concat(F.lit(f"{prefix}: "), told)), " +")
        return unit_counts(F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % dimension).cast("int")))

    return encode


def build_index(cases: DataFrame, encode: Encoder) -> DataFrame:
    """cases with recognition_vector and case_vector, a vector for each text of a case.

    cases: case_key, recognition_text, case_text, case_summary and others. Cases without a key go. The summary stands in
    for a blank case text, and a full stop for what is blank then.
    """
    def some(*names: str) -> Column:
        blank = [F.when(F.trim(F.regexp_replace(c, r"[\t-\r]", " ")) != "", F.col(c)) for c in names]
        return F.coalesce(*blank, F.lit("."))

    kept = cases.filter(F.coalesce("case_key", F.lit("")) != "")
    return kept.withColumns({"recognition_vector": encode(some("recognition_text"), "passage"), "case_vector": encode(some("case_text", "case_summary"), "passage")})
