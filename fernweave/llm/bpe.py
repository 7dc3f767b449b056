"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. A bucket for each merge rank holds list positions; a bitmap of two levels says
which buckets have any, so that find-first-set gives the least rank. Positions whose pair has changed since are stale
and skipped. Each merge costs a few steps, however long the pre-token is.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, reachable, table, without
from .pretokens import Recent, pre_tokens, ranks_of, read_vocabulary

WIDTH = 8  # 2**8 ranks a word of the bitmap
LAST = (1 << WIDTH) - 1
#: Pre-tokens of each generation of a Python worker's cache.
CACHE = 400_000


class Encoder:
    """ids of texts by the ranks of a vocabulary, each match of the pattern separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.tokens = dict(zip(ranks.values(), ranks))
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}  # first id << 32 | second id: the rank of the merged token, -1 if there is none
        self.cache = Recent(CACHE)  # pre-token: its ids, as little-endian unsigned 32-bit integers
        lengths = np.zeros(max(self.tokens) + 1, np.int64)
        lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.lengths, self.ends = lengths, np.cumsum(lengths)
        self.spelled = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(lengths))), np.uint8)

    def _rank(self, pair: int) -> int:
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        rank = self.pairs[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, rank_of = self.pairs.get, self._rank
        ids = list(map(self.bytes.__getitem__, piece))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [-1] * n  # of the pair that begins here
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            pair = ids[i] << 32 | ids[i + 1]
            rank = known(pair)
            if rank is None:
                rank = rank_of(pair)
            if rank >= 0:
                ranks[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # places rise, so the list is a heap
                else:
                    buckets[rank] = [i]
        words: dict[int, int] = {}
        top = 0
        for rank in buckets:
            word = rank >> WIDTH
            words[word] = words.get(word, 0) | 1 << (rank & LAST)
            top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << WIDTH | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits &= bits - 1
                words[word] = bits
                if not bits:
                    top &= top - 1
            if ranks[at] != rank:
                continue  # stale
            gone = after[at]
            then = after[gone]
            ids[at], after[at] = rank, then
            ranks[gone] = ranks[at] = -1
            near = []
            if then < n:
                before[then] = at
                near.append((at, rank << 32 | ids[then]))
            if (last := before[at]) >= 0:
                near.append((last, ids[last] << 32 | rank))
            for place, pair in near:
                new = known(pair)
                if new is None:
                    new = rank_of(pair)
                if new == ranks[place]:
                    continue
                ranks[place] = new
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], place)
                    else:
                        buckets[new] = [place]
                        word = new >> WIDTH
                        words[word] = words.get(word, 0) | 1 << (new & LAST)
                        top |= 1 << word
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def _pack(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for some in pre_tokens(text, self.pattern):
            parts.append(b"".join(map(self.cache.hold(some, self._pack).__getitem__, some)))
        return np.frombuffer(b"".join(parts), "<u4")

    def known(self, ids: list[int | None]) -> np.ndarray:
        """The ids as an array, if the vocabulary has all of them."""
        bad = [x for x in ids if x is None or not 0 <= x < len(self.lengths) or not self.lengths[x]]
        if bad:
            raise ValueError(f"ids that the vocabulary lacks: {bad[:5]}")
        return np.array(ids, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one token after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = self.ends[ids] - ends  # from a token's place in the result to its place among the spelled tokens
        return self.spelled[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(2)
def encoder(file: bytes, pattern: str) -> Encoder:
    return Encoder(ranks_of(file), pattern)


KINDS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def bpe(docs: DataFrame, vocabulary: str, pattern: str, outputs: Sequence[str] = ("n_tokens", "ids"), text_col: str = "text") -> DataFrame:
    """docs with some of: n_tokens, ids, decoded (the bytes that the ids stand for), ids_sha256 (ids as little-endian
    unsigned 32-bit integers), decoded_sha256.

    vocabulary is the path of a file of ranks on the driver. Null and empty texts have no tokens; very long texts are cut
    into pre-tokens bit by bit. Rows that repeat are encoded alike, and an empty table gives an empty result. Input
    columns named like the outputs are replaced. Nothing is shuffled; what a worker keeps is bounded by CACHE pre-tokens of
    pretokens.KEPT characters at most, as longer ones aren't kept.
    """
    spark = docs.sparkSession
    reachable(spark)
    docs = without(docs, *outputs)
    (text,) = fresh(docs, "text_")
    file = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file.value, pattern)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in outputs}
            for text in batch.column(batch.num_columns - 1):
                ids = own.encode(text.as_py() or "")
                made = {"n_tokens": len(ids)}
                if "ids" in out:
                    made["ids"] = ids.astype(np.int32)
                if "ids_sha256" in out:
                    made["ids_sha256"] = digest(ids.tobytes())
                if "decoded" in out or "decoded_sha256" in out:
                    decoded = own.decode(ids)
                    made |= {"decoded": decoded, "decoded_sha256": digest(decoded)}
                for k in outputs:
                    out[k].append(made[k])
            arrays = [pa.array(out[k], pa.list_(pa.int32()) if k == "ids" else {"n_tokens": pa.int64(), "decoded": pa.binary()}.get(k, pa.string())) for k in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], *outputs])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, KINDS[k]) for k in outputs]])
    return docs.withColumn(text, docs[text_col].cast("string")).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded: the bytes of the ids. Null ids give null, no ids no bytes.

    An id that the vocabulary lacks, or a null one in a list, ends the job with a ValueError. Rows that repeat are decoded
    alike, and an empty table gives an empty result. An input column named decoded is replaced.
    """
    spark = rows.sparkSession
    reachable(spark)
    rows = without(rows, "decoded")
    file = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file.value, "")
        for batch in batches:
            decoded = [None if x is None else own.decode(own.known(x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
