import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweave.llm.bpe import Encoder, bpe, bpe_decode, op3_bpe
from fernweave.llm.pretokens import ranks_of, read_vocabulary

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = ranks_of(read_vocabulary(PATH))
OWN = Encoder(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab theinrs\n0123'.日é "), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_as_the_library(text):
    ids = OWN.encode(text)
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


def test_very_long_pretoken():
    random.seed(4)
    text = "a" * 5000 + "".join(random.choice("abcdest") for _ in range(20_000))
    assert OWN.encode(text).tolist() == TIKTOKEN.encode_ordinary(text)


def test_text_beyond_the_list_bound(monkeypatch):
    monkeypatch.setattr("fernweave.llm.pretokens.LONG", 10)
    assert OWN.encode("the words of a text go bit by bit").tolist() == TIKTOKEN.encode_ordinary("the words of a text go bit by bit")


def test_operator(spark):
    texts = [None, "", "hello  world", "<|endoftext|>", "x " * 200_000]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = bpe(df, PATH, P.PATTERN, ("n_tokens", "ids", "decoded", "ids_sha256"))
    rows = bpe_decode(out.withColumnRenamed("decoded", "direct"), PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.ids == TIKTOKEN.encode_ordinary(t or "") and r.n_tokens == len(r.ids)
        assert bytes(r.decoded) == bytes(r.direct) == (t or "").encode()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()
    assert bpe(spark.createDataFrame([], "text string"), PATH, P.PATTERN).collect() == []


def test_ids_that_the_vocabulary_lacks():
    for bad in (-1, 50_256, 10**9, None):
        with pytest.raises(ValueError):
            OWN.known([3, bad])
    assert OWN.decode(OWN.known([])) == b""


def test_long_pretokens_are_not_kept():
    own = Encoder(RANKS, P.PATTERN)
    text = "short words and " + "q" * 1000
    assert own.encode(text).tolist() == TIKTOKEN.encode_ordinary(text)
    assert max(map(len, own.cache.young)) <= 256


def test_query_over_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op3_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
