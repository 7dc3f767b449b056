import collections

import public_tokenizers as P
import regex

from fernweave.llm import token_counts as K
from fernweave.llm.pretokens import ranks_of, read_vocabulary

from .brute import segment, unigram

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = ranks_of(read_vocabulary(PATH))
SCORES = K.zipf(RANKS)


def plain(text, scores=SCORES):
    words = regex.findall(P.PATTERN, text or "")
    best = [unigram(w.encode(), scores) for w in words]
    return len(words), sum(t for _, t in best), sum(s for s, _ in best)


def fitted(texts):
    counts = collections.Counter()
    for word, n in collections.Counter(w for t in texts for w in regex.findall(P.PATTERN, t or "")).items():
        for piece in segment(word.encode(), SCORES):
            counts[RANKS[piece]] += n
    return counts


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    counts = fitted(texts.values())
    assert K.piece_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH, P.PATTERN) == counts
    scores = K.fitted(RANKS, counts)
    got = {r.doc_id: r for r in K.op4_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 200
    for i in sorted(texts)[::4]:
        assert (got[i].n_pretokens, got[i].n_tokens, got[i].score) == plain(texts[i], scores)


def test_long_pretokens_are_counted_alone(monkeypatch):
    own = K.Counter(SCORES)
    word = "abcdthe" * 60
    want = plain(word)
    assert own.count_text(word, P.PATTERN) == want and len(own.best) == 1 and not own.words.young
    assert own.pieces(word) == segment(word.encode(), SCORES)
    assert own.count_text(f"the {word} the", P.PATTERN) == plain(f"the {word} the")


def test_small_trie_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "NODES", 5)
    own = K.Counter(SCORES)
    for w in ("the", "then", "thence", "other", "the", "日本"):
        assert own.count_text(w, P.PATTERN) == plain(w)


def test_edge_cases(spark):
    texts = [None, "", " \n", "a" * 3000, "é日 '", "same", "same"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = K.token_counts(df, PATH, P.PATTERN).orderBy("doc_id").collect()
    scores = K.fitted(RANKS, fitted(texts))
    assert [(r.n_pretokens, r.n_tokens, r.score) for r in rows] == [plain(t, scores) for t in texts]
    assert K.token_counts(spark.createDataFrame([], "text string"), PATH, P.PATTERN).collect() == []


def test_long_pretokens_are_sent_in_bounded_batches(spark, monkeypatch):
    """Encoded data: many distinct pre-tokens too long to keep. Counts don't depend on how they are sent."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdef", k=400)) for _ in range(40)]
    rows = [(1, " ".join(words + words[:5])), (2, "plain words " * 50), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = K.piece_counts(df, PATH, P.PATTERN)
    monkeypatch.setattr(K, "LONG_BYTES", 1000)
    monkeypatch.setattr(K, "TALLY", 3)
    assert K.piece_counts(df, PATH, P.PATTERN) == want and sum(want.values()) > 45 * 20


def test_many_new_pretokens_are_segmented_together(monkeypatch):
    """Arrays give what the trie gives, which they leave as it was; of pieces too where segmentations tie."""
    import random

    import numpy as np

    from fernweave.llm.segments import Segments

    rng = random.Random(4)
    words = ["".join(rng.choices(["th", "e", "ing", "é", "日", "\x00", "7", "-"], k=rng.randint(1, 40))) for _ in range(600)]
    texts = ["", " ".join(words), "the " * 30, "x" * 300 + " " + "日" * 250, " ".join(words[:90] + ["z" * 700])]
    want = [plain(t) for t in texts]
    own = K.Counter(SCORES)
    assert own.count_texts(texts[:3], P.PATTERN) == want[:3] and len(own.best) == 1
    assert own.count_texts(texts, P.PATTERN) == want
    monkeypatch.setattr(K, "LONG", 20)
    monkeypatch.setattr(K, "WORDS", 100)
    assert K.Counter(SCORES).count_texts(texts, P.PATTERN) == want
    ties = {bytes([b]): K.packed(-3, 1) for b in range(256)} | {p: K.packed(s, 1) for p, s in {b"ab": -5, b"bc": -5, b"abc": -8, b"cab": -9}.items()}
    raws = ["".join(rng.choices("abcd", k=rng.randint(1, 12))).encode() for _ in range(300)]
    made, small = Segments(ties), {p: v + 1 >> K.FIELD for p, v in ties.items()}
    counts = collections.Counter()
    for i, raw in enumerate(raws):
        for piece in segment(raw, small):
            counts[piece] += i
    got = made.tally(raws, np.arange(len(raws)))
    assert {made.pieces[node]: n for node, n in enumerate(got.tolist()) if n} == counts
    assert [K.unpacked(v) for v in made.values(raws)] == [unigram(raw, small)[::-1] for raw in raws]
