import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fernweave.llm import near_dedup, quality_rules
from fernweave.llm.common import written
from fernweave.llm.pretokens import ranks_of, read_vocabulary
from fernweave.llm.text_stats import CLASSES, COMMON_NAMES

from .brute import WHITE, line_bounds, near_classes, poisson_counts, quality_verdicts

D = "/root/testdata/sf0.001"


def bare(text):
    return [x.strip(WHITE) for x in (text or "").split("\n") if x.strip(WHITE)]


def test_against_plain_versions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdicts = quality_verdicts([(r.doc_id, r.text, r.lang) for r in rows.values()], quality_rules.Rules(), quality_rules.DRAFT, CLASSES, COMMON_NAMES)
    kept = {i: rows[i].text for i in rows if verdicts[i][0]}
    one = written(corpus_pipeline.rules(spark, docs, D))
    assert {r.doc_id: r.text for r in one.collect()} == kept
    two = written(corpus_pipeline.lines(spark, one, D))
    cut = {r.doc_id: r.text for r in two.collect()}
    for i, (lines, must, may) in line_bounds(list(kept.items())).items():
        n = len(bare(cut[i])) if i in cut else 0
        assert len(lines) - len(may) <= n <= len(lines) - len(must)
        if must == may and i in cut:
            assert bare(cut[i]) == [x for p, x in enumerate(lines) if p not in must]
        assert i in cut or must or may
    classes = near_classes(list(cut.items()), near_dedup.Settings())
    cut = {i: t for i, t in cut.items() if classes[i] == i}
    ids = sorted(cut)
    counts = poisson_counts([(i, rows[i].source) for i in ids])
    ranks = ranks_of(read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, n in zip(ids, counts):
        tokens = encoding.encode_ordinary(cut[i])
        digest = hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in tokens)).hexdigest()
        want += [(i, rows[i].source, len(tokens), digest, hashlib.sha256(cut[i].encode()).hexdigest())] * n
    got = corpus_pipeline.run(spark, D).collect()
    assert sorted((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    text = "the words of this text are in the order that they have, and it is not long but long enough for all rules"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, text + " and more of it by the end")]
    made = [(i, t, "en" if i != 4 else None, "web" if i != 1 else None, 5, 1, 2, 3, "x") for i, t in rows]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, own int, turn int, kept int, replica string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        got = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert all((r.own, r.turn, r.kept, r.replica) == (1, 2, 3, "x") for r in got), name
        if name == "near dedup":
            assert sorted(r.text or "" for r in got) in (["", text], ["", text, text + " and more of it by the end"])
        if name == "byte-level BPE":
            assert [r.n_tokens for r in got if r.doc_id in (2, 3)] == [0, 0]


def test_stages_keep_the_columns_and_survive_empty_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, D)
        assert out.collect() == [], name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name


def test_counts_of_characters_follow_the_text(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.lines(spark, docs, D)
    assert out.filter(F.col("n_chars") != F.length("text")).isEmpty()
