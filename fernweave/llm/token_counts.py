"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens go into a trie. A node's forward score is that of the best segmentation of its prefix; it is
computed once, for all pre-tokens that share the prefix. A pre-token's last node has its count. Where many are new at
once, as in most lists of texts, segments.py takes them together instead.

The model is fitted to the corpus: its distinct pre-tokens, by how often they occur, are segmented under Zipf's law by
rank, and a piece's log-probability is that of its count among them.
"""

from __future__ import annotations

import collections
import math
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, reachable, table, without
from .pretokens import KEPT, LONG, Recent, pre_tokens, ranks_of, read_vocabulary
from .segments import FIELD, LONGEST, Segments

UNIT = 1 << 16  # scores are whole numbers of 1 / UNIT, so that sums and ties are exact
NODES, WORDS = 800_000, 300_000  # that a worker keeps: nodes, and words of each generation
LOWEST = -(1 << 128)  # less than any packed number; FIELD bits of such hold a token count (a text has fewer tokens than bytes)
TALLY = 200_000  # distinct pre-tokens, of KEPT characters at most, that a worker counts before it sends them on
MANY = 50  # new pre-tokens from which arrays are faster than the trie
LONG_BYTES = 8 << 20  # characters of longer ones that are sent at a time
ADDED = ("n_pretokens", "n_tokens", "score")


def zipf(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Log-probabilities by Zipf's law: a piece of rank r has a probability in proportion to 1 / (r + 2)."""
    total = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {piece: round(-UNIT * (math.log(r + 2) + total)) for piece, r in ranks.items()}


def fitted(ranks: dict[bytes, int], counts: dict[int, int]) -> dict[bytes, int]:
    """Log-probabilities of pieces by the counts of their ranks, one added to each."""
    total = math.log(sum(counts.values()) + len(ranks))
    return {piece: round(UNIT * (math.log(counts.get(r, 0) + 1) - total)) for piece, r in ranks.items()}


def packed(score: int, tokens: int) -> int:
    """Score and tokens as one number: of two segmentations, the larger one is that of the higher score, then of fewer tokens."""
    return (score << FIELD) - tokens


def unpacked(value: int) -> tuple[int, int]:
    """(tokens, score) of a packed number, or of a sum of such."""
    tokens = -value & ((1 << FIELD) - 1)
    return tokens, (value + tokens) >> FIELD


class Counter:
    """Token counts and scores of pre-tokens: the segmentation of the highest score, of equal ones that with fewest tokens."""

    def __init__(self, scores: dict[bytes, int]) -> None:
        self.scores = scores
        self.span = max(map(len, scores))
        self.words = Recent(WORDS)
        self._start()

    @cached_property
    def tails(self) -> tuple[dict, int | None, int]:
        """The pieces spelled backwards: what ends at a place is found by walking back as long as some piece goes on.

        A node is its children, the packed number of the piece that it spells (None if none), and the depth."""
        root: tuple[dict, int | None, int] = ({}, None, 0)
        for piece, score in sorted(self.scores.items(), key=lambda x: len(x[0])):
            node = root
            for depth, b in enumerate(reversed(piece), 1):
                above, node = node, node[0].get(b)
                if node is None:
                    node = above[0][b] = ({}, None, depth)
            above[0][piece[0]] = (node[0], packed(score, 1), node[2])
        return root

    @cached_property
    def segments(self) -> Segments:
        return Segments({piece: packed(score, 1) for piece, score in self.scores.items()})

    def _start(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.size = [0], [0]

    def _step(self, ending: bytes, values: list[int]) -> tuple[int, int]:
        """The best packed number of a prefix, and its last token's bytes. ending: the prefix, or its last span bytes;
        values: the numbers of the shorter prefixes, or of the longest of them, in order."""
        below = self.tails[0]
        best, size = LOWEST, 0
        for b, value in zip(reversed(ending), reversed(values)):
            node = below.get(b)
            if node is None:
                break
            below, own, depth = node
            if own is not None and value + own > best:
                best, size = value + own, depth
        return best, size

    def insert(self, word: bytes) -> list[int]:
        """The word's path in the trie, which it is a part of from now on."""
        node, path, values = 0, [0], [0]
        for d, b in enumerate(word, 1):
            child = self.children.get(node << 8 | b)
            if child is None:
                best, size = self._step(word[:d], values)
                child = self.children[node << 8 | b] = len(self.best)
                self.best.append(best)
                self.size.append(size)
            path.append(child)
            values.append(self.best[child])
            node = child
        return path

    def _alone(self, word: bytes) -> tuple[int, array]:
        """(packed number, the last token's bytes for each prefix) of a word that is too long for the trie."""
        values, sizes = collections.deque([0], self.span), array("H", [0])
        for d in range(1, len(word) + 1):
            best, size = self._step(word[max(0, d - self.span) : d], values)
            values.append(best)
            sizes.append(size)
        return values[-1], sizes

    def fresh_word(self, word: str) -> int:
        """The packed number of a pre-token."""
        raw = word.encode()
        if len(word) > KEPT:
            return self._alone(raw)[0]
        if len(self.best) > NODES:
            self._start()
        return self.best[self.insert(raw)[-1]]

    def pieces(self, word: str) -> list[bytes]:
        """The best segmentation of a pre-token."""
        raw = word.encode()
        if len(word) > KEPT:
            sizes = self._alone(raw)[1]
        else:
            if len(self.best) > NODES:
                self._start()
            sizes = [self.size[node] for node in self.insert(raw)]
        out, d = [], len(raw)
        while d:
            out.append(raw[d - sizes[d] : d])
            d -= sizes[d]
        return out[::-1]

    def _held(self, words: set[str]) -> dict[str, int]:
        """A dictionary with the packed numbers of all these pre-tokens, and maybe more."""
        new = [w for w in self.words.missing(words) if len(w) <= KEPT]
        raws = [w.encode() for w in new] if len(new) >= MANY else []
        some = [i for i, raw in enumerate(raws) if 0 < len(raw) <= LONGEST]
        made = dict(zip([new[i] for i in some], self.segments.values([raws[i] for i in some]))) if some else {}
        return self.words.hold(words, lambda w: made[w] if w in made else self.fresh_word(w))

    def count_text(self, text: str, pattern: str) -> tuple[int, int, int]:
        """(pre-tokens, tokens, score) of the text."""
        n = total = 0
        for some in pre_tokens(text, pattern):
            n += len(some)
            total += sum(map(self._held(set(some)).__getitem__, some))
        return n, *unpacked(total)

    def count_texts(self, texts: Iterable[str], pattern: str) -> list[tuple[int, int, int]]:
        """count_text of each; those that are not very long in groups of LONG characters and one more text at most."""
        out: list[tuple[int, int, int]] = []
        group: list[list[str]] = []
        size = 0

        def close() -> None:
            held = self._held(set().union(*group))
            out.extend((len(some), *unpacked(sum(map(held.__getitem__, some)))) for some in group)
            group.clear()

        for text in texts:
            if len(text) > LONG or size > LONG:
                close()
                size = 0
            if len(text) > LONG:
                out.append(self.count_text(text, pattern))
            else:
                group.extend(pre_tokens(text, pattern))
                size += len(text)
        close()
        return out


@lru_cache(1)
def counter(file: bytes, counts: bytes | None) -> Counter:
    """A worker's counter. counts: pairs of rank and count as 64-bit integers, or None for the law by rank."""
    ranks = ranks_of(file)
    if counts is None:
        return Counter(zipf(ranks))
    flat = array("q", counts)
    return Counter(fitted(ranks, dict(zip(flat[::2], flat[1::2]))))


def piece_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> dict[int, int]:
    """How often each rank of the vocabulary is a piece of the texts' pre-tokens, segmented under the law by rank.

    Distinct pre-tokens are counted over the whole corpus and segmented once each; only a number for each piece of the
    vocabulary reaches the driver. A worker holds TALLY pre-tokens of KEPT characters at most, and of longer ones LONG_BYTES and one more.
    """
    spark = docs.sparkSession
    reachable(spark)
    file = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: collections.Counter = collections.Counter()

        def sent(counts: collections.Counter) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for text in batch.column(0):
                for some in pre_tokens(text.as_py() or "", pattern):
                    if max(map(len, some), default=0) > KEPT:
                        # long ones go on at once, in batches of bounded bytes
                        long, size = collections.Counter(), 0
                        for word in some:
                            if len(word) > KEPT:
                                long[word] += 1
                                size += len(word)
                                if size > LONG_BYTES:
                                    yield sent(long)
                                    size = 0
                        yield sent(long)
                        some = [word for word in some if len(word) <= KEPT]
                    held.update(some)
                    if len(held) > TALLY:
                        yield sent(held)
        yield sent(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ranks = counter(file.value, None), ranks_of(file.value)
        held: collections.Counter = collections.Counter()
        nodes = np.zeros(len(own.segments.own), np.int64)
        for batch in batches:
            raws, counts = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy()
            short = np.fromiter((0 < len(raw) <= LONGEST for raw in raws), bool, len(raws))
            nodes += own.segments.tally([raws[i] for i in np.flatnonzero(short).tolist()], counts[short])
            for i in np.flatnonzero(~short).tolist():
                for piece in own.pieces(raws[i].decode()):
                    held[ranks[piece]] += int(counts[i])
        held.update({ranks[own.segments.pieces[node]]: int(nodes[node]) for node in np.flatnonzero(nodes).tolist()})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

    words = docs.select(F.col(text_col).cast("string")).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = words.mapInArrow(cut, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["piece"].to_pylist(), rows["n"].to_pylist()))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", counts: dict[int, int] | None = None) -> DataFrame:
    """docs with n_pretokens, n_tokens and score (the log-probability of the segmentation, in units of 1 / UNIT).

    vocabulary is the path of a file of ranks on the driver; its pieces must hold all single bytes, so every text has a
    segmentation. counts are those of the model (piece_counts of these docs, if not given).

    Null and empty texts have no tokens and score 0. Very long texts are cut bit by bit; pre-tokens of more than KEPT
    characters are counted alone, in time in proportion to them, and not kept. Rows that repeat get equal counts. Input
    columns named like the new ones are replaced. An empty table gives an empty result. What a worker keeps is bounded
    by NODES, and by WORDS entries of KEPT characters at most. Only distinct pre-tokens are shuffled, by the fit.
    """
    spark = docs.sparkSession
    reachable(spark)
    docs = without(docs, *ADDED)
    (text,) = fresh(docs, "text_")
    counts = piece_counts(docs, vocabulary, pattern, text_col) if counts is None else counts
    model = spark.sparkContext.broadcast((read_vocabulary(vocabulary), array("q", [x for pair in sorted(counts.items()) for x in pair]).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(*model.value)
        for batch in batches:
            made = own.count_texts((x.as_py() or "" for x in batch.column(batch.num_columns - 1)), pattern)
            columns = [pa.array(list(c), pa.int64()) for c in (zip(*made) if made else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *ADDED])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, T.LongType()) for k in ADDED]])
    return docs.withColumn(text, docs[text_col].cast("string")).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", *ADDED)
