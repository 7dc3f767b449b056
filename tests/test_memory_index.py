import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.operators import memory_index as M

CASES = "case_key string, recognition_text string, case_text string, case_summary string, extra int"


def test_index_drops_cases_without_a_key_and_fills_blank_texts(spark):
    rows = [("a", "Red shoe", " \n", "red SHOE", 1), ("b", None, None, "", 2), ("", "x", "x", "x", 3), (None, "x", "x", "x", 4), ("a", "Red shoe", " \n", "red SHOE", 1)]
    out = M.build_index(spark.createDataFrame(rows, CASES), M.hashing_encoder(16)).collect()
    assert sorted(r.case_key for r in out) == ["a", "a", "b"] and {r.extra for r in out} == {1, 2}
    for r in out:
        assert len(r.recognition_vector) == 16 and np.isclose(np.linalg.norm(r.case_vector), 1)
        assert r.recognition_vector == r.case_vector  # case and white space don't count, nor does which text is blank
    assert M.build_index(spark.createDataFrame([], CASES), M.hashing_encoder()).collect() == []


def test_encoder_counts_words_and_the_prefix(spark):
    encode = M.hashing_encoder(32)
    one = spark.createDataFrame([("a a  a\tb",)], "t string")
    (row,) = one.select(encode(F.col("t"), "query").alias("v"), encode(F.col("t"), "passage").alias("p")).collect()
    assert sorted(x for x in np.square(row.v) * 11 if x > 0) == pytest.approx([1, 1, 9]) and row.v != row.p
    with pytest.raises(ValueError, match="INVALID_TEXT_PREFIX"):
        encode(F.col("t"), "title")
    for blank in (None, "", " \n"):
        with pytest.raises(Exception, match="TEXT_REQUIRED"):
            spark.createDataFrame([(blank,)], "t string").select(encode(F.col("t"), "query")).collect()
    long = spark.createDataFrame([("word " * 300_000,)], "t string").select(encode(F.col("t"), "query").alias("v")).first().v
    assert max(long) == pytest.approx(1)
