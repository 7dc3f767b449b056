"""Line dedup by pairwise alignment.

Passages that two or more documents hold propose pairs of documents. A pair's common passages are aligned by patience
(the longest run of anchors in the same order in both), and the lines of aligned passages go from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, reachable, table, without, written
from .wordhash import Chunk, chunks

ADDED = ("n_lines", "removed_lines", "removed_words")
KEY = ("one", "two", "occurrence")


def passages(c: Chunk, min_words: int) -> tuple[np.ndarray, ...]:
    """Of each passage of each text: text, two halves of a digest, occurrence, and its first and last line.

    A passage is as few successive lines as have min_words words together, counted from each line on and back from each
    line; mostly it is one line. So any common block of min_words words in two texts is covered by common passages.
    Lines are numbered among those with a word, and compared without white space at their ends. occurrence counts equal
    passages of one text from 0, so that any can be an anchor.
    """
    word_start, word_end = c.bounds()
    text, start, end, full = c.lines()
    text, start, end = text[full], start[full], end[full]
    first, after = np.searchsorted(word_start, start), np.searchsorted(word_start, end)
    one, two = c.digests(word_start[first], word_end[after - 1])
    n = len(text)
    total = np.append(0, np.cumsum(after - first))
    index = np.arange(n)
    last = np.searchsorted(total[1:], total[:-1] + min_words)
    forth = np.flatnonzero(last < n)
    forth = forth[text[last[forth]] == text[forth]]
    begin = np.searchsorted(total, total[1:] - min_words, "right") - 1
    back = np.flatnonzero(begin >= 0)
    back = back[text[begin[back]] == text[back]]
    spans = np.unique(np.concatenate([np.stack([forth, last[forth]], 1), np.stack([begin[back], back], 1)]), axis=0) if n else np.zeros((0, 2), np.int64)
    a, b = spans[:, 0], spans[:, 1]
    key_one, key_two = one[a], two[a]
    several = np.flatnonzero(b > a)
    if len(several):
        raw = np.stack([one, two], 1).tobytes()
        made = b"".join(blake2b(raw[16 * i : 16 * j], digest_size=16, person=b"passage").digest() for i, j in zip(a[several].tolist(), (b[several] + 1).tolist()))
        pair = np.frombuffer(made, "<i8").reshape(-1, 2)
        key_one[several], key_two[several] = pair[:, 0], pair[:, 1]
    owner = text[a]
    order = np.lexsort((a, key_two, key_one, owner))
    same = np.zeros(len(order), bool)
    x, y = order[:-1], order[1:]
    same[1:] = (owner[x] == owner[y]) & (key_one[x] == key_one[y]) & (key_two[x] == key_two[y])
    place = np.arange(len(order))
    occurrence = np.empty(len(order), np.int64)
    occurrence[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    head = np.searchsorted(text, owner)  # of a text: its first line
    return owner, key_one, key_two, occurrence, index[a] - head, index[b] - head


def longest_increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(common: list[tuple[int, int, int]]) -> list[int]:
    """Of passages that two documents share, as (first, last, their first): the places of those that are aligned.

    common is in order of first and last; passages that begin with the same line follow each other by length in both.
    """
    return longest_increasing([(theirs, last - first) for first, last, theirs in common])


def _first_pass(shared: DataFrame) -> DataFrame:
    """shared: doc, found (of each passage with an earlier home: holder, theirs, first, last, one).

    doc, gone (lines), open (passages that kept a line: first, last, and the nearest aligned passages before and after).
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for found in batch.column(1).to_pylist():
                found.sort(key=itemgetter("first", "last"))
                by_holder: dict[int, list[int]] = {}
                for i, x in enumerate(found):
                    by_holder.setdefault(x["holder"], []).append(i)
                chosen = sorted(own[j] for own in by_holder.values() for j in aligned([(found[i]["first"], found[i]["last"], found[i]["theirs"]) for i in own]))
                lines = {p for i in chosen for p in range(found[i]["first"], found[i]["last"] + 1)}
                left = [i for i, x in enumerate(found) if any(p not in lines for p in range(x["first"], x["last"] + 1))]
                gone.append(sorted(lines))
                rows = []
                for i in left:
                    at = bisect_left(chosen, i)
                    rows.append({"first": found[i]["first"], "last": found[i]["last"], "prev": found[chosen[at - 1]]["one"] if at else None, "next": found[chosen[at]]["one"] if at < len(chosen) else None})
                kept.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, OPEN)], ["doc", "gone", "open"])

    kind = shared.schema["doc"].dataType.simpleString()
    return shared.mapInArrow(align, f"doc {kind}, gone array<int>, open array<struct<first:int,last:int,prev:bigint,next:bigint>>")


OPEN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("prev", pa.int64()), ("next", pa.int64())]))


def _align_pairs(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: doc, other (an earlier document). doc, gone: the lines of passages that align with other, by all that both have."""
    some = written(lines.join(pairs.select("doc").union(pairs.select("other")).distinct(), "doc", "left_semi"))
    theirs = some.select(F.col("doc").alias("other"), *KEY, F.col("first").alias("theirs"))
    common = some.join(pairs, "doc").join(theirs, ["other", *KEY]).groupBy("doc", "other").agg(F.collect_set(F.struct("first", "last", "theirs")).alias("found"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for found in batch.column(1).to_pylist():
                rows = sorted((x["first"], x["last"], x["theirs"]) for x in found)
                gone.append(sorted({p for i in aligned(rows) for p in range(rows[i][0], rows[i][1] + 1)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["doc", "gone"])

    out = written(_together(common.select("doc", "found").mapInArrow(align, f"doc {lines.schema['doc'].dataType.simpleString()}, gone array<int>")))
    discard(some)
    return out


def _together(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def _ranked(holders: DataFrame) -> DataFrame:
    """holders: KEY, doc, distinct. With rank (from 0) of the document among those of its key; no key is one task's work."""
    put = written(holders.repartitionByRange(*KEY, "doc").withColumn("part", F.spark_partition_id()))
    ahead = W.partitionBy(*KEY).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = put.groupBy(*KEY, "part").count().select(*KEY, "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy(*KEY, "part").orderBy("doc")) - 1
    out = written(put.withColumn("rank", inside).join(before, [*KEY, "part"]).select(*KEY, "doc", (F.col("rank") + F.col("before")).alias("rank")))
    discard(put)
    return out


def _more_gone(lines: DataFrame, first_pass: DataFrame) -> list[DataFrame]:
    """Tables of doc and gone, from aligning what the first pass left open with all earlier documents that hold it.

    An open passage first meets the first document where it is open between the same neighbours, then its holders from
    the first on, twice as many in each round. A passage is done when one of its alignments takes it.
    """
    place = F.explode("open").alias("o")
    rows = first_pass.filter(F.size("open") > 0).select("doc", place).select("doc", "o.*").withColumnRenamed("first", "f").withColumnRenamed("last", "l")
    keyed = lines.join(rows.select("doc", "f", "l", "prev", "next").distinct(), "doc").filter("first = f and last = l")
    still = written(keyed.select("doc", *KEY, "first", "last", "prev", "next").distinct())
    if still.isEmpty():
        discard(still)
        return []
    known = [first_pass.select("doc", "gone")]
    made: list[DataFrame] = []

    def test(pairs: DataFrame, still: DataFrame) -> DataFrame:
        asked = written(pairs.distinct())
        made.append(_align_pairs(lines, asked))
        discard(asked)
        known.append(made[-1])
        every = known[0]
        for x in known[1:]:
            every = every.unionByName(x)
        lines_gone = _together(every.join(still.select("doc").distinct(), "doc", "left_semi"))
        covered = F.forall(F.sequence("first", "last"), lambda p: F.array_contains("gone", p))
        left = written(still.join(lines_gone, "doc", "left").filter(~F.coalesce(covered, F.lit(False))).select(still.columns))
        discard(still)
        return left

    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("prev").alias("near")), F.struct(F.lit(1).alias("side"), F.col("next").alias("near")))).alias("s")
    beside = still.select("doc", *KEY, side).select("doc", *KEY, "s.*").filter("near is not null")
    firsts = beside.groupBy(*KEY, "side", "near").agg(F.min("doc").alias("other"))
    still = test(beside.join(firsts, [*KEY, "side", "near"]).filter("other < doc").select("doc", "other"), still)
    if not still.isEmpty():
        ranked = _ranked(lines.join(still.select(*KEY).distinct(), list(KEY), "left_semi").select(*KEY, "doc").distinct())
        low, width = 0, 1
        while True:
            holders = ranked.filter((F.col("rank") >= low) & (F.col("rank") < low + width)).select(*KEY, F.col("doc").alias("other"))
            pairs = written(still.join(holders, list(KEY)).filter("other < doc").select("doc", "other"))
            if pairs.isEmpty():
                discard(pairs)
                break
            still = test(pairs, still)
            discard(pairs)
            low, width = low + width, 2 * width
        discard(ranked)
    discard(still)
    return made


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without the passages that an earlier document has too, and n_lines, removed_lines, removed_words.

    Documents are ordered by id (nulls first), then by a hash of the text. A passage (see passages) proposes the pair of
    its first holder, its home, and each later one: as many pairs as holders, not as pairs of holders, so a passage may
    be as frequent as it likes, and rare ones need no bound. Per pair, the passages that the later document shares with
    that home are aligned, and the lines of aligned ones go. A passage that crosses others in its home is then aligned
    with the other earlier documents that hold it, by all that the pair shares, until one takes it or none is left.
    So what stays of earlier documents' passages stands in another order in each of them. Lines without a word stay, and
    don't part passages.

    Null texts count as empty and stay null. Rows that repeat in full are the same document: none removes lines from the
    other. A document whose lines all have earlier homes ends with an empty text. A very long text is read as a chunk of
    its own. Input columns named like the new ones are replaced, others keep their names. An empty table gives an empty
    result.
    """
    reachable(docs.sparkSession)
    docs = without(docs, *ADDED)
    doc, gone, key = fresh(docs, "doc", "gone", "key")
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    docs = docs.withColumn(doc, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for c in chunks(batch.column(1)):
                owner, one, two, occurrence, first, last = passages(c, min_words)
                rows = pa.array(at + owner)
                at += c.n
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(one), pa.array(two), *[pa.array(x.astype(np.int32)) for x in (occurrence, first, last)]], ["doc", *KEY, "first", "last"])

    kind = docs.schema[doc].dataType.simpleString()
    lines = written(docs.select(doc, text_col).mapInArrow(read, f"doc {kind}, one long, two long, occurrence int, first int, last int"))
    homes = lines.groupBy(*KEY).agg(F.min(F.struct("doc", "first")).alias("home"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    homes = written(homes.select(*KEY, F.col("home.doc").alias("home"), F.col("home.first").alias("theirs")))
    # both sides are plain scans: a passage that very many documents hold is split as a skewed join
    later = lines.join(homes, list(KEY)).filter("doc != home")
    # a set, so that rows that repeat in full count once
    found = F.collect_set(F.struct(F.xxhash64("home").alias("holder"), "theirs", "first", "last", "one")).alias("found")
    first_pass = written(_first_pass(later.groupBy("doc").agg(found)))
    discard(homes)
    more = _more_gone(lines, first_pass)
    discard(lines)
    cut_lines = first_pass.select("doc", "gone")
    for x in more:
        cut_lines = cut_lines.unionByName(x)
    cut_lines = (_together(cut_lines) if more else cut_lines).select(F.col("doc").alias(key), F.col("gone").alias(gone))
    # both sides grow with the input
    met = docs.hint("merge").join(cut_lines.hint("merge"), F.col(doc) == F.col(key), "left").drop(key, doc)
    names = [c for c in met.columns if c != gone]
    where = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            counts = np.zeros((3, len(texts)), np.int64)
            for i, places in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not texts[i]:
                    continue
                if not places:
                    counts[0, i] = texts[i].count("\n") + 1
                    continue
                parts, kept, at, places = texts[i].split("\n"), [], 0, set(places)
                counts[0, i], counts[1, i] = len(parts), len(places)
                for line in parts:
                    words = len(line.encode().split())  # at the white space of passages
                    if words and at in places:
                        counts[2, i] += words
                    else:
                        kept.append(line)
                    at += words > 0
                texts[i] = "\n".join(kept)
            columns = [*batch.columns[:-1], *map(pa.array, counts)]
            columns[where] = pa.array(texts, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, [*names, *ADDED])

    schema = T.StructType([*(met.schema[c] for c in names), *[T.StructField(c, T.LongType()) for c in ADDED]])
    return met.select(*names, gone).mapInArrow(cut, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
