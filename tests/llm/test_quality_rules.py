import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweave.llm import quality_rules as Q
from fernweave.llm.text_stats import CLASSES, COMMON_NAMES, stats

from .brute import base_metrics, quality_verdicts

ALPHABET = st.sampled_from("aab  \n\n#%.é日\t\x0b\x0c\r\x85\xa0 Z9!")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=90)), min_size=1, max_size=12))
def test_base_metrics(texts):
    s = stats(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(s[k][i] for k in Q.BASE) == base_metrics(t)
        assert s["classes"][i].sum() == len(t or "")
        assert s["common"][i].sum() == s["n_words"][i]


def test_distance():
    # halves against (1, 0): middle (3/4, 1/4), divergences 1/2 log2(2/3) + 1/2 log2(2) and log2(4/3)
    half = np.sqrt((0.5 * np.log2(2 / 3) + 0.5 + np.log2(4 / 3)) / 2)
    got = Q.jensen_shannon(np.array([[2, 0], [0, 2], [0, 0], [1, 1]]), np.array([1.0, 0.0]))
    assert np.allclose(got, [0, 1, 1, half])


def test_query_keeps_clean_and_drops_junk(spark):
    d = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = Q.op9_quality_rules(spark, d).collect()
    assert len(got) == len(texts)
    for r in got[::37]:
        metrics = base_metrics(texts[r.doc_id])
        assert tuple(r[k] for k in Q.BASE) == metrics
        assert r.base_failed == (metrics[0] < 10 or 100 * metrics[4] > 20 * metrics[0])
    assert not any(r.kept and r.base_failed for r in got)
    judged = [r for r in got if r.doc_id in labels and not r.base_failed]
    clean, junk = ([r.kept for r in judged if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(clean) > 0.995 and np.mean(junk) < 0.1


def test_edge_cases(spark):
    long = "the words of this text are not repeated " * 30_000
    rows = [(1, None, "en", 5), (2, "", None, 5), (3, long, "xx", 5), (4, "the house is by the sea and it was there for all of us", "en", 5), (4, "the house is by the sea and it was there for all of us", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = Q.quality_rules(df).collect()
    assert len(got) == 5 and [r.base_failed for r in got] == [True, True, True, False, False]
    assert got[3] == got[4] and Q.quality_rules(df.limit(0)).collect() == []


def test_verdicts_against_plain_divergences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    japanese = "これは短い文章ですがちゃんと読めます。 " * 3
    rows += [(90_000 + i, japanese + f"別の話 {i} " * 20, "ja") for i in range(2)] + [(90_010, None, "en"), (90_011, "", None)]
    want = quality_verdicts(rows, Q.Rules(), Q.DRAFT, CLASSES, COMMON_NAMES)
    got = Q.quality_rules(spark.createDataFrame(rows, docs.schema)).collect()
    for r in got:
        kept, x, y = want[r.doc_id]
        assert abs(r.class_distance - x) < 1e-6 and abs(r.word_distance - y) < 1e-6
        assert r.kept == kept
    assert 0 < sum(r.kept for r in got) < len(rows)


def test_two_documents_of_another_language_stay(spark):
    rng = random.Random(5)
    english = "the of and to in is that it for was on are with as by this be at from or an have not".split()
    made = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(made if rng.random() < 0.55 else english) for _ in range(300)), "en") for i in range(600)]
    rows += [(1000 + i, " ".join("".join(rng.choices("あいうえおかきくけこ", k=4)) for _ in range(80)), "ja") for i in range(2)]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000] and got[1001]


def test_rare_languages(spark):
    rng = random.Random(3)

    def text(words, n, common):
        return " ".join(rng.choice(words) if rng.random() < 0.55 else rng.choice(common) for _ in range(n))

    made = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    english = "the of and to in is that it for was on are with as by this be at from or an have not".split()
    rows = [(i, text(made, 500, english), "en") for i in range(3000)]
    # 0.1% of all words, without any common word; two more with too few words for a reference
    other = ["".join(rng.choices("κλμνξοπ", k=5)) for _ in range(900)]
    rows += [(10_000 + i, text(other, 500, other), "el") for i in range(3)]
    rows += [(20_000 + i, text(other, 100, other), lang) for i, lang in enumerate(("xa", "xb"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.quality_rules(df).collect()}
    assert not any(got[i].base_failed for i in got if i >= 10_000)
    assert all(got[i].kept for i in got if i >= 10_000)
    assert max(got[10_000 + i].word_distance for i in range(3)) < 0.27
    # in a rare language with a reference, junk still goes
    plain = [(30_000 + i, text(other, 500, other), "ru") for i in range(10)]
    junk = " ".join(f"#{i}$%%&&||" for i in range(60))
    more = df.union(spark.createDataFrame([*plain, (40_000, junk, "ru")], df.schema))
    got = {r.doc_id: r.kept for r in Q.quality_rules(more).collect()}
    assert not got[40_000] and all(got[i] for i, _, _ in plain)


def test_word_salad_of_a_fifth_language_goes(spark):
    """Its common words are counted in the corpus: prose that has them stays, the same words without them go."""
    rng = random.Random(9)
    small = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(20)]
    large = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(small) if rng.random() < 0.45 else rng.choice(large) for _ in range(n))
    salad = lambda n: " ".join(rng.choice(large) for _ in range(n))
    rows = [(i, prose(300), "zz") for i in range(400)] + [(1000 + i, salad(300), "zz") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(small) <= set(Q.frequent_words(df, ["zz"], 20))
    got = {r.doc_id: r.kept for r in Q.quality_rules(df).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(20))
    assert Q.frequent_words(df.limit(0), ["zz"], 20) == []
