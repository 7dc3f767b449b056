"""Near-duplicate documents by improved consistent weighted sampling (Ioffe, 2010).

A document is a weighted set of elements: its five-word shingles, a repeated one as often as it occurs (the j-th
occurrence is an element of its own, so that sets of elements have the term frequencies in them), each weighted by its
inverse document frequency. Each of bands * rows samples of a document agrees with another's with a probability of their
weighted Jaccard similarity; rows samples form a band. Documents that share a band are candidates; the weighted Jaccard
similarity of their elements and, after it, the plain one decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, fresh, reachable, table, written
from .components import connected_components
from .wordhash import Chunk, U, chunks, mixed, shingles


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    bands: int = 14
    rows: int = 3
    words: int = 5
    idf_gain: float = 0.5  # the rarest shingle weighs 1 + idf_gain times the commonest
    rare: float = 1e-2  # shingles in less than this part of the documents all count as rarest
    seed: int = 5

    @property
    def least(self) -> float:
        """What the weighted Jaccard similarity must reach: threshold, less what idf alone can take from a pair whose term
        frequencies reach it (all common shingles at weight 1, all others at 1 + idf_gain)."""
        return self.threshold / (self.threshold + (1 - self.threshold) * (1 + self.idf_gain)) - 1e-6


CELLS = 1 << 18  # of each of the two rows of the document-frequency sketch
FIELD = 10  # bits of an element's hash, times a sample's factor, that pick one of its random numbers
AGAIN = U(0x9FB21C651E98DF25)  # tells a shingle's occurrences apart


def elements(c: Chunk, words: int, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each element of each text: text, and hash, rising within the text; and for all texts two halves of a content key.

    A text of fewer words than a shingle has one shingle, of all its words. The content key is a cryptographic digest:
    texts of the same words in the same order have the same one. known: c.words() and the halves, if they are there already.
    """
    (text, starts, _, value), k1, k2 = known or (c.words(), None, None)
    n = np.bincount(text, minlength=c.n)
    if k1 is None:
        k1, k2 = c.contents(text, starts)
    at, hashes = shingles(text, value, words)
    owner = text[at]
    short = np.flatnonzero((n > 0) & (n < words))
    owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, k1[short].view(U)])
    owner, hashes = _sorted(owner, hashes)
    again = np.zeros(len(owner), bool)
    again[1:] = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    if again.any():
        index = np.arange(len(owner))
        turn = (index - np.maximum.accumulate(np.where(again, 0, index))).astype(U)
        owner, hashes = _sorted(owner, np.where(again, mixed(hashes + turn * AGAIN), hashes))
    return owner, hashes, k1, k2


def _sorted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By owner, then hash. owner rises but for a tail; a sort of each text's own part."""
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    if (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
        cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    hashes = hashes.copy()
    for part in np.split(hashes, cuts):
        part.sort()
    return owner, hashes


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & U(CELLS - 1)).astype(np.int32), ((hashes >> U(44)) & U(CELLS - 1)).astype(np.int32) + CELLS


def _added(counts: DataFrame) -> np.ndarray:
    """A sketch from rows of cell and n: 2 * CELLS numbers whatever the input."""
    sums = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * CELLS, np.float32)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def _filled(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    full = np.flatnonzero(cells)
    for at in range(0, len(full), 1 << 16):
        some = full[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells[some])], ["cell", "n"])


def document_frequencies(docs: DataFrame, settings: Settings, text_col: str) -> tuple[np.ndarray, int]:
    """A count-min sketch of the elements' document frequencies, and the number of documents.

    A cell adds the frequencies of the elements that share it, on average about 1/500 of the documents for texts of 500
    words; counts below Settings.rare of the documents make no difference.
    """
    words = settings.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(2 * CELLS, np.int32)
        for batch in batches:
            for c in chunks(batch.column(0)):
                for cell in _cells(elements(c, words)[1]):
                    np.add.at(cells, cell, 1)
        yield from _filled(cells)

    return _added(docs.select(docs[text_col].cast("string")).mapInArrow(count, "cell int, n int")), docs.count()


def idf(hashes: np.ndarray, cells: np.ndarray, documents: int, settings: Settings) -> np.ndarray:
    """Between 1 and 1 + idf_gain, by the logarithm of the share of documents."""
    a, b = _cells(hashes)
    share = np.minimum(cells[a], cells[b]) / np.float32(max(1, documents))
    return 1 + np.float32(settings.idf_gain / np.log(settings.rare)) * np.log(np.clip(share, np.float32(settings.rare), np.float32(1)))


@lru_cache(2)
def _numbers(settings: Settings) -> tuple[np.ndarray, ...]:
    """For each sample an odd factor; for each value of a field r (gamma), 1 / r, ln c - r (c gamma) and beta (uniform)."""
    random = np.random.default_rng(settings.seed)
    factors = random.integers(0, 1 << 31, settings.bands * settings.rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    r, c, beta = random.gamma(2, 1, 1 << FIELD), random.gamma(2, 1, 1 << FIELD), random.uniform(0, 1, 1 << FIELD)
    return factors, *[x.astype(np.float32) for x in (r, 1 / r, np.log(c), beta)]


def band_keys(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The texts with an element, and for each its keys of all bands.

    An element's numbers r, c and beta, picked by three fields of its hash times the sample's factor, give t = floor(ln S /
    r + beta) and ln a = ln c - r (t - beta) - r for weight S. The sample is the element and t of the least ln a, which
    itself stands for both: equal elements of equal t have the same bits.
    """
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    out = np.empty((len(start), settings.bands), U)
    if not len(start):
        return owner, out
    factors, r, inverse, log_c, beta = _numbers(settings)
    log_s = np.log(weights).astype(np.float32)
    short, size, mask = (hashes >> U(32)).astype(np.uint32), np.uint32(FIELD), np.uint32((1 << FIELD) - 1)
    for band in range(settings.bands):
        key = np.full(len(start), band + 1, U)
        for i in range(band * settings.rows, (band + 1) * settings.rows):
            x = short * factors[i]
            own_beta = beta[(x >> np.uint32(32 - 3 * FIELD)) & mask]
            log_a = log_c[(x >> np.uint32(32 - 2 * FIELD)) & mask]
            x >>= np.uint32(32 - FIELD)
            t = inverse[x]
            t *= log_s
            t += own_beta
            np.floor(t, out=t)
            t -= own_beta
            t += np.float32(1)
            t *= r[x]
            log_a -= t
            key = mixed(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(log_a, start).view(np.uint32).astype(U))
        out[:, band] = key
    return owner[start], out


def _signatures(docs: DataFrame, sketch: Broadcast, settings: Settings) -> DataFrame:
    """docs: id, own, text. id, own, k1, k2, keys (null for a text without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, documents = sketch.value
        for batch in batches:
            at = 0
            for c in chunks(batch.column(2)):
                owner, hashes, k1, k2 = elements(c, settings.words)
                texts, keys = band_keys(owner, hashes, idf(hashes, cells, documents, settings), settings)
                offsets = np.zeros(c.n + 1, np.int32)
                offsets[texts + 1] = settings.bands
                rows = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                part = batch.slice(at, c.n)
                at += c.n
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(k1), pa.array(k2), rows], ["id", "own", "k1", "k2", "keys"])

    return docs.mapInArrow(sign, f"id {docs.schema['id'].dataType.simpleString()}, own long, k1 long, k2 long, keys array<long>")


FILTER, PICKS = 1 << 20, 4  # 32-bit words of the filter of asked contents, and bits that each sets
TURNS = [U(i * int(AGAIN) & 0xFFFFFFFFFFFFFFFF) for i in range(PICKS)]


def _bits(ident: np.ndarray, k1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pick the word, and the bit in it, of (hash of the id, half of the content key)."""
    x = mixed(ident.view(U) ^ mixed(k1.view(U)))
    for turn in TURNS:
        y = mixed(x + turn)
        yield (y >> U(44)).astype(np.int32), np.uint32(1) << (y & U(31)).astype(np.uint32)


def _filter_of(asked: DataFrame) -> np.ndarray:
    """asked: v. A Bloom filter of FILTER words whatever the input; where contents fill it up, it only lets more pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER, np.uint32)
        for batch in batches:
            for at, bit in _bits(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                np.bitwise_or.at(words, at, bit)
        yield from _filled(words.view(np.int32))

    rows = asked.select(F.xxhash64("v.id").alias("ident"), F.col("v.k1").alias("half")).mapInArrow(count, "cell int, n int").groupBy("cell").agg(F.bit_or("n").alias("n")).toArrow()
    out = np.zeros(FILTER, np.int32)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.view(np.uint32)


def _sets(docs: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """docs: id, text. v, elements (64 bits each, rising) of the contents that asked (v) has.

    A filter that every task has lets few others pass, so that hardly more than what is asked for is shuffled.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_of(asked))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            at = 0
            for c in chunks(batch.column(1)):
                text, starts, _, _ = found = c.words()
                k1, k2 = c.contents(text, starts)
                part = batch.slice(at, c.n)
                at += c.n
                passed = np.ones(c.n, bool)
                for word, bit in _bits(part.column(2).to_numpy(), k1):
                    passed &= (words[word] & bit) > 0
                if not passed.any():
                    continue
                owner, hashes, _, _ = elements(c, settings.words, (found, k1, k2))
                cut = np.searchsorted(owner, np.arange(c.n + 1)) * 8
                raw = hashes.tobytes()
                rows = np.flatnonzero(passed)
                sets = [raw[cut[i] : cut[i + 1]] for i in rows.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(sets, pa.binary())], ["id", "k1", "k2", "elements"])

    made = docs.select("id", "text", F.xxhash64("id").alias("hash")).mapInArrow(gather, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, elements binary")
    made = made.dropDuplicates(["id", "k1", "k2"]).select(F.struct("id", "k1", "k2").alias("v"), "elements")
    # both sides grow with the input
    return made.hint("merge").join(asked.hint("merge"), "v", "left_semi")


def similarities(a: np.ndarray, b: np.ndarray, weigh: Callable[[np.ndarray], np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two rising sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return (0.0, 0.0) if len(a) or len(b) else (1.0, 1.0)
    common = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
    n = int(common.sum())
    plain = n / (len(a) + len(b) - n)
    wa = weigh(a)
    low = float(wa[common].sum(dtype=float))
    return low / (float(wa.sum(dtype=float)) + float(weigh(b).sum(dtype=float)) - low), plain


def _alike(pairs: DataFrame, sketch: Broadcast, settings: Settings) -> DataFrame:
    """pairs: a, b, sa, sb. a, b of the pairs whose weighted similarity reaches Settings.least and whose plain one reaches the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, documents = sketch.value
        for batch in batches:
            views = [[np.frombuffer(x, U) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            made = [similarities(x, y, lambda s: idf(s, cells, documents, settings)) for x, y in zip(*views)]
            yes = pa.array([w >= settings.least and p >= settings.threshold for w, p in made], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), batch.column(1).filter(yes)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "sa", "sb").mapInArrow(compare, f"a {kind}, b {kind}")


def _share_counts(sets: DataFrame) -> np.ndarray:
    """A sketch, as of document_frequencies, of the elements of these sets alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(2 * CELLS, np.int32)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for cell in _cells(np.frombuffer(x, U)):
                    np.add.at(cells, cell, 1)
        yield from _filled(cells)

    return _added(sets.select("elements").mapInArrow(count, "cell int, n int"))


GRAIN = np.log(1.05)  # of the classes of sizes in the prefix join


def _prefixes(sets: DataFrame, counts: Broadcast, threshold: float) -> DataFrame:
    """sets: k1, label, elements. A row for each element that may be the rarest common one of an alike pair.

    With the elements from rare to common, all that a pair has in common is in what follows the rarest common element, in
    both. For a pair at the threshold t that rest has t / (1 + t) of the pair's elements or more, in both. So a row holds
    the rest's size. longer: whether the set may be the longer of the pair, which counts in its class of sizes, own; last:
    the last class that the longer may have where it is the shorter, null where it can't be.
    """
    t = threshold * (1 - 1e-9)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        for batch in batches:
            keys, labels = (batch.column(i).to_numpy() for i in (0, 1))
            for at, x in enumerate(batch.column(2).to_pylist()):
                element = np.frombuffer(x, U)
                a, b = _cells(element)
                total = len(element)
                first = np.lexsort((element, np.minimum(cells[a], cells[b])))[: int(total * (1 - t)) + 1]  # no rest behind it is large enough
                rest = total - np.arange(len(first))
                # the largest partner for which this element is in the prefix
                most = rest * (1 + t) / t - total
                longer, shorter = rest >= t * total, most >= total * (1 - 1e-9)
                some = np.flatnonzero(longer | shorter)
                n = len(some)
                if n:
                    own = np.full(n, np.floor(np.log(total) / GRAIN))
                    last = np.floor(np.log(np.maximum(most[some], total)) / GRAIN)
                    sizes = [pa.array(own.astype(np.int32)), pa.array(last.astype(np.int32), mask=~shorter[some])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(element[first[some]].view(np.int64)), pa.array(np.full(n, keys[at])), pa.array(np.full(n, labels[at])), pa.array(np.full(n, total, np.int32)), pa.array(rest[some].astype(np.int32)), pa.array(longer[some]), *sizes],
                        ["element", "k1", "label", "total", "rest", "longer", "own", "last"],
                    )

    return sets.select("k1", "label", "elements").mapInArrow(cut, "element long, k1 long, label long, total int, rest int, longer boolean, own int, last int")


def _sized(rows: DataFrame) -> DataFrame:
    """rows of _prefixes. A row for the longer of a pair in its class of sizes, and rows for the shorter in each class that the longer may have."""
    long = rows.filter("longer").select("element", F.col("own").alias("size"), "longer", "k1", "label", "total", "rest")
    short = rows.filter("last is not null").select("element", F.explode(F.sequence("own", "last")).alias("size"), F.lit(False).alias("longer"), "k1", "label", "total", "rest")
    return long.unionByName(short)


def _missed_links(met: DataFrame, sets: DataFrame, labels: DataFrame, sketch: Broadcast, settings: Settings) -> DataFrame:
    """a, b: the alike pairs of different classes among the members of buckets that leaders left in several classes.

    met: v, key of bucket members that are no leaders. Exact: a prefix join on the rarest elements proposes the pairs.
    """
    spark = met.sparkSession
    label = F.xxhash64(F.coalesce("label", "v"))
    met = written(met.join(labels, "v", "left").select("v", "key", label.alias("label")))
    mixed_keys = met.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    open_ones = written(met.join(mixed_keys, "key", "left_semi").select("v", "label").distinct())
    discard(met)
    sets = written(sets.hint("merge").join(open_ones.hint("merge"), "v").select("v", F.col("v.k1").alias("k1"), "label", "elements"))
    counts = spark.sparkContext.broadcast(_share_counts(sets))
    prefixes = written(_prefixes(sets, counts, settings.threshold))
    discard(open_ones)
    # exactly, as a sketch fills up: few elements are in sets of several labels, and only these get a row for each class of sizes
    shared = written(prefixes.join(_of_several_labels(prefixes, ["element"]), "element", "left_semi"))
    discard(prefixes)
    rows = _sized(shared)
    some = written(rows.join(_of_several_labels(rows), KEY, "left_semi"))
    discard(shared)
    if some.isEmpty():
        discard(sets, some)
        kind = labels.schema["v"].dataType.simpleString()
        return written(spark.createDataFrame([], f"a {kind}, b {kind}"))
    # one of each class for an element: a class of thousands that borders on another class meets it once, and both are one from then on
    one = some.groupBy(*KEY, "longer", "label").agg(F.min(F.struct(F.xxhash64("k1").alias("h"), "k1", "total", "rest")).alias("r"))
    first = written(_proposed(one.select(*KEY, "longer", "label", "r.k1", "r.total", "r.rest"), settings))
    links = written(_compared(first, sets, sketch, settings))
    of = [sets.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b")]
    joined = connected_components(links.join(of[0], "a").join(of[1], "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    moved = some.join(joined.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    moved = written(moved)
    rest = written(_proposed(moved.join(_of_several_labels(moved), KEY, "left_semi"), settings).join(first, ["x", "y"], "left_anti"))
    discard(some)
    out = written(links.unionByName(_compared(rest, sets, sketch, settings)))
    discard(first, moved, rest, links, sets)
    return out


KEY = ["element", "size"]


def _of_several_labels(rows: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select(*key)


def _proposed(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows of _sized. x, y: the k1 of pairs of different labels that have a key in common and may reach the threshold."""
    long = rows.filter("longer").select(*KEY, F.col("k1").alias("x"), F.col("label").alias("lx"), F.col("total").alias("tx"), F.col("rest").alias("rx"))
    short = rows.filter("not longer").select(*KEY, F.col("k1").alias("y"), F.col("label").alias("ly"), F.col("total").alias("ty"), F.col("rest").alias("ry"))
    t = settings.threshold * (1 - 1e-9)
    near = (F.col("lx") != F.col("ly")) & (F.col("tx") >= F.col("ty")) & (F.least("rx", "ry") >= F.lit(t / (1 + t)) * (F.col("tx") + F.col("ty")))
    found = long.join(short, [long[c] == short[c] for c in KEY] + [near]).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return found.distinct()


def _compared(found: DataFrame, sets: DataFrame, sketch: Broadcast, settings: Settings) -> DataFrame:
    left = sets.select(F.col("k1").alias("x"), F.col("v").alias("a"), F.col("elements").alias("sa"))
    right = sets.select(F.col("k1").alias("y"), F.col("v").alias("b"), F.col("elements").alias("sb"))
    return _alike(found.join(left, "x").join(right, "y"), sketch, settings)


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, text_hash, class_id (the smallest id of its class), kept (one row of each class).

    A class is a connected component of documents at a plain Jaccard similarity of Settings.threshold or more, counting
    repeated shingles as often as they occur; the weighted similarity of such a pair is Settings.least or more.

    Texts of equal words collapse to one content first, so thousands of copies cost one signature. In each band bucket
    a content is compared with two leaders, the content of the smallest id and one that a hash picks by band: pairs grow
    with the members of buckets, not with their squares, and a group's members meet some leader in each of the bands
    that they share. Where the leaders leave a bucket's other members in several classes, as where unlike documents share
    a long passage, a prefix join on rare elements finds the alike pairs among those members. No bucket is capped or left out.

    Texts without words (null and empty ones too) are one class. Very long texts are read in chunks of their own. Ties go
    to the smaller id, nulls first; rows that repeat in full are copies, one of which is kept. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    reachable(spark)
    sketch = spark.sparkContext.broadcast(document_frequencies(docs, settings, text_col))
    plain = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("own"), docs[text_col].cast("string").alias("text"))
    signed = written(_signatures(plain, sketch, settings))
    contents = written(signed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("keys").alias("keys")).select(F.struct("id", "k1", "k2").alias("v"), "keys"))
    members = contents.select("v", F.posexplode("keys").alias("band", "key"))
    by_hash = F.struct(F.xxhash64("v", "band").alias("h"), F.col("v").alias("v"))
    leaders = members.groupBy("band", "key").agg(F.min("v").alias("first"), F.min(by_hash)["v"].alias("other"), F.count(F.lit(1)).alias("n"))
    leaders = written(leaders.filter("n > 1"))
    held = written(members.join(leaders, ["band", "key"]).select("v", "key", "first", "other", "n"))
    discard(leaders)
    met = held.select("v", F.explode(F.array_distinct(F.array("first", "other"))).alias("w")).filter("v != w")
    pairs = written(met.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct())
    asked = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    sets = written(_sets(plain.select("id", "text"), written(asked), settings))
    left = sets.select(F.col("v").alias("a"), F.col("elements").alias("sa"))
    right = sets.select(F.col("v").alias("b"), F.col("elements").alias("sb"))
    links = _alike(pairs.join(left, "a").join(right, "b"), sketch, settings)
    labels = connected_components(links)
    discard(pairs)
    others = held.filter("n > 2 and v != first and v != other").select("v", "key")
    more = _missed_links(others, sets, labels, sketch, settings)
    discard(held, sets)
    if not more.isEmpty():
        # links between classes: their labels' components
        of = [labels.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b")]
        ends = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        above = connected_components(ends).select(F.col("v").alias("label"), F.col("label").alias("above"))
        whole = contents.select("v").join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
        labels = written(whole.join(above, "label", "left").select("v", F.coalesce("above", "label").alias("label")))
    discard(more)
    homes = written(contents.join(labels, "v", "left").select("v.*", F.coalesce("label", "v").alias("class")).select("k1", "k2", F.col("id").alias("first_id"), F.col("class.id").alias("class_id"), (F.col("class") == F.struct("id", "k1", "k2")).alias("head")))
    discard(contents)
    # of a class's first content, the first of the rows with its id; counted before the join, which may then split a hot content
    turn = F.row_number().over(W.partitionBy("id", "k1", "k2").orderBy("own"))
    placed = signed.select("id", "own", "k1", "k2", turn.alias("turn")).join(homes, ["k1", "k2"])
    return placed.select(
        F.col("id").alias(id_col), F.col("own").alias("text_hash"), "class_id", (F.col("head") & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("turn") == 1)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each class of near duplicates: that of the smallest id, nulls first.

    Null and empty texts are one class, of which one row stays; of rows that repeat in full one stays, and of those of equal id and
    text the first by the other columns. Very long texts are read in chunks; similarities at the threshold are alike. Other
    columns are kept as they are, whatever their names. An empty table gives an empty result.
    """
    own, turn = fresh(docs, "own", "turn")
    kept = near_duplicates(docs, settings, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    out = keyed.join(kept, keyed[id_col].eqNullSafe(kept["_kept_id"]) & (keyed[own] == kept["_kept_hash"]), "left_semi")
    # by all columns that have an order, so that any run keeps the same row
    order = [F.col(f.name) for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind]
    return out.withColumn(turn, F.row_number().over(W.partitionBy(id_col, own).orderBy(*order, F.lit(0)))).filter(F.col(turn) == 1).drop(own, turn)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
