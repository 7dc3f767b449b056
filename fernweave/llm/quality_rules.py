"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with those of the corpus's languages by
Jensen-Shannon distance. Base rules on length and repetition come first. Common words are fixed ones of four languages; of
other languages with enough words, the most frequent words are counted in the corpus and join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, reachable, table, without, written
from .text_stats import CLASSES, COMMON, COMMON_NAMES, common_words, stats

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "class_distance", "word_distance", "kept")


References = list[tuple[str, np.ndarray, np.ndarray]]

#: Rare languages' references go to all tasks up to so many languages, else they are joined plainly.
MOST_SENT = 10_000


@dataclass(frozen=True)
class Corpus:
    """common: the references that serve all documents. rare: lang, own (the sums of its histograms; null: too few words).
    listed: the rising hashes of the words that the histograms count one by one."""

    common: References
    rare: DataFrame
    n_rare: int
    listed: np.ndarray = field(default_factory=lambda: COMMON)

    @property
    def width(self) -> int:
        return len(CLASSES) + len(self.listed) + 1


@dataclass(frozen=True)
class Rules:
    """Thresholds. A distance may reach base + per_word / n_words: short texts vary more by chance."""

    min_words: int = 10
    max_repeat_percent: int = 20
    guard_words: int = 40  # below, the distances don't decide
    class_base: float = 0.1
    class_per_word: float = 10.0
    word_base: float = 0.27
    word_per_word: float = 4.0
    min_share: float = 0.005  # of all words: the references of languages with more (200 at most) serve all documents
    known_share: float = 0.1  # a large language with a smaller share of common words gets its own ones counted
    own_words: int = 20  # that many
    lang_words: int = 1000  # a rarer language with so many words has a reference for its own documents; with fewer, distances don't decide


#: For the references alone: documents farther than this from the mean of all documents take no part in them. Junk that
#: a corpus holds moves that mean away from clean text, hence the wider bounds.
DRAFT = Rules(class_base=0.16, class_per_word=5.0, word_base=0.285, word_per_word=2.5)


def _with_own(docs: DataFrame, corpus: Corpus, lang: str, names: list[str]) -> DataFrame:
    """docs with names[0], whether the language is a rare one, and names[1], its own sums."""
    rare = corpus.rare.select(F.col("lang").alias(names[2]), F.col("own").alias(names[1]), F.lit(True).alias(names[0]))
    rare = F.broadcast(rare) if corpus.n_rare <= MOST_SENT else rare
    return docs.join(rare, F.coalesce(docs[lang].cast("string"), F.lit("")) == rare[names[2]], "left").drop(names[2])


def _own(rare: pa.Array, sums: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: whether a row's language is rare, the rows with a reference of their own, and these sums."""
    at = np.flatnonzero(sums.is_valid().to_numpy(zero_copy_only=False))
    own = sums.drop_null().flatten().to_numpy().astype(float).reshape(len(at), width)
    return rare.is_valid().to_numpy(zero_copy_only=False), at, own


def _sums(docs: DataFrame, text_col: str, lang_col: str, draft: Corpus | None, listed: np.ndarray) -> DataFrame:
    """A row for each language and Arrow batch: the sums of its histograms, with draft those of what it would keep."""
    common, width = draft.common if draft else None, len(CLASSES) + len(listed) + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = stats(batch.column(0), listed)
            rows = np.concatenate([s["classes"], s["common"]], axis=1)
            if common is not None:
                rows[~judged(s, common, DRAFT, _own(batch.column(2), batch.column(3), width))["kept"]] = 0
            langs, at = np.unique(np.array([x or "" for x in batch.column(1).to_pylist()], object).astype(str), return_inverse=True)
            sums = np.zeros((len(langs), rows.shape[1]), np.int64)
            np.add.at(sums, at, rows)
            yield pa.RecordBatch.from_arrays([pa.array(langs.tolist(), pa.string()), pa.array(list(sums), pa.list_(pa.int64()))], ["lang", "sums"])

    asked = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    if draft:
        asked = _with_own(asked, draft, "lang", ["rare", "own", "_lang"]).select("text", "lang", "rare", "own")
    return asked.mapInArrow(gather, "lang string, sums array<long>")


def language_references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> References:
    """(language, class histogram, common-word histogram) of the languages that corpus_references holds for all documents."""
    return corpus_references(docs, rules, text_col, lang_col).common


def corpus_references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> Corpus:
    """The class and common-word histograms of each language, over all documents.

    A second pass leaves out what lies far from the first pass's references. A null language counts as the language "".
    Languages of min_share of all words or more (or the largest, if none is) are few and held here, in order of the
    name; those of the others stay a table, however many they are.
    """
    reachable(docs.sparkSession)
    draft = _references(docs, rules, text_col, lang_col, None, COMMON)
    if not draft.common:
        return draft
    # the last column of a reference's words is that of all that aren't listed
    if strange := [lang for lang, _, words in draft.common if 1 - words[-1] < rules.known_share]:
        listed, _ = common_words([*COMMON_NAMES, *frequent_words(docs, strange, rules.own_words, text_col, lang_col)])
        draft = _references(docs, rules, text_col, lang_col, None, listed)
    final = _references(docs, rules, text_col, lang_col, draft, draft.listed)
    return final if final.common else draft


def frequent_words(docs: DataFrame, langs: list[str], n: int, text_col: str = "text", lang_col: str = "lang") -> list[str]:
    """The n words of each of these languages that are in most of its documents, of equal ones the first.

    Counted over all their documents; a row for each word is shuffled, after each task has added up its own. Words of
    more than 100 characters aren't common ones.
    """
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    words = docs.filter(lang.isin(langs)).select(lang.alias("lang"), F.explode(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).alias("word"))
    counts = words.filter((F.col("word") != "") & (F.length("word") <= 100)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("turn", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("turn") <= n)
    return [r.word for r in top.select("word").distinct().collect()]


def _references(docs: DataFrame, rules: Rules, text_col: str, lang_col: str, draft: Corpus | None, listed: np.ndarray) -> Corpus:
    width = len(CLASSES) + len(listed) + 1
    by_lang = _sums(docs, text_col, lang_col, draft, listed).groupBy("lang").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    words = F.aggregate(F.slice("sums", len(CLASSES) + 1, len(listed) + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    by_lang = written(by_lang.withColumn("words", words))
    every, most = by_lang.agg(F.sum("words"), F.max("words")).first()
    if not every:
        return Corpus([], by_lang.select("lang", F.col("sums").alias("own")).limit(0), 0, listed)
    large = (F.col("words") >= rules.min_share * every) | (F.col("words") == most)
    rows = by_lang.filter(large).collect()
    made = [(r.lang, np.array(r.sums, float)) for r in sorted(rows, key=lambda r: r.lang)]
    common = [(lang, x[: len(CLASSES)] / x[: len(CLASSES)].sum(), x[len(CLASSES) :] / x[len(CLASSES) :].sum()) for lang, x in made]
    rare = by_lang.filter(~large).select("lang", F.when(F.col("words") >= rules.lang_words, F.col("sums")).alias("own"))
    return Corpus(common, rare, rare.count(), listed)


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The distance (0 to 1) of each row of counts from the reference; a row of zeros is at distance 1."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(1, total)
    middle = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / middle), 0).sum(1) + np.where(reference > 0, reference * np.log2(reference / middle), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(bits / 2, 0, 1)), 1.0)


def judged(s: dict[str, np.ndarray], references: References, rules: Rules, own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """ADDED as arrays, from statistics. own: as _own gives it; without it, no language is rare."""
    n = s["n_words"]
    rare, at, sums = own or (np.zeros(len(n), bool), np.zeros(0, np.int64), np.zeros((0, s["classes"].shape[1] + s["common"].shape[1])))
    out = {k: s[k] for k in BASE}
    out["base_failed"] = (n < rules.min_words) | (100 * s["n_repeat_words"] > rules.max_repeat_percent * n)
    for name, hist, i, part in (("class_distance", s["classes"], 1, sums[:, : len(CLASSES)]), ("word_distance", s["common"], 2, sums[:, len(CLASSES) :])):
        out[name] = np.min([jensen_shannon(hist, r[i]) for r in references], axis=0) if references else np.zeros(len(n))
        if len(at):
            out[name][at] = np.minimum(out[name][at], jensen_shannon(hist[at], part / part.sum(1, keepdims=True)))
    some = np.maximum(1, n)
    far = (out["class_distance"] > rules.class_base + rules.class_per_word / some) | (out["word_distance"] > rules.word_base + rules.word_per_word / some)
    unknown = rare.copy()
    unknown[at] = False
    out["kept"] = ~out["base_failed"] & ~(far & (n >= rules.guard_words) & ~unknown)
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    Texts are read three times: twice for the languages' references, once for the verdicts (those of languages without known
    common words twice more); nothing is shuffled but the references' sums and the words' counts. The distances are those to the nearest reference of a language of min_share or more, whatever
    language the row claims, or of the row's own language. Where that is rarer and has under lang_words words, the
    distances don't decide.

    Null texts count as empty; an empty text has distance 1 and fails the base rules. Very long texts are read whole, in
    chunks. A distance at its threshold passes. Rows that repeat get equal
    verdicts. Input columns named like the new ones are replaced. An empty table gives an empty result.
    """
    docs = without(docs, *ADDED)
    references = corpus_references(docs, rules, text_col, lang_col)
    common, listed, width = references.common, references.listed, references.width
    text, rare, own, lang = fresh(docs, "text_", "rare_", "own_", "lang_")
    names = docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, is_rare, sums = batch.columns[-3:]
            v = judged(stats(texts, listed), common, rules, _own(is_rare, sums, width))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *[pa.array(v[k]) for k in ADDED]], [*names, *ADDED])

    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "class_distance": T.DoubleType(), "word_distance": T.DoubleType()}
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, kinds.get(k, T.LongType())) for k in ADDED]])
    asked = _with_own(docs.withColumn(text, docs[text_col].cast("string")), references, lang_col, [rare, own, lang])
    return asked.select(*names, text, rare, own).mapInArrow(judge, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs).select("doc_id", *BASE, "base_failed", "kept", "class_distance", "word_distance")
