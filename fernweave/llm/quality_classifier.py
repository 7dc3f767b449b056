"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel over document statistics. Each partition of the labelled rows sums its part
of the normal equations; the driver adds the few sums and solves. Isotonic regression turns scores into probabilities. It learns
from all labelled rows: each is scored by weights that its own fold had no part in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, reachable, table, without
from .text_stats import CLASSES, COMMON, stats


@dataclass(frozen=True)
class Settings:
    max_rows: int = 100_000  # labelled rows that are fitted on, a hash sample of all; the bound on what fitting holds
    parts: int = 16  # partitions of the fit
    folds: int = 4  # of the calibration
    features: int = 256
    width: float = 6.0  # of the Gaussian kernel, in standard deviations of the statistics
    ridge: float = 1.0
    seed: int = 11
    threshold: float = 0.3


def document_statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text: shares, means and logarithms, all finite, those of an empty text zero."""
    s = stats(column)
    n, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "n_chars", "n_lines"))
    classes = s["classes"] / chars[:, None]
    common = s["common"][:, : len(COMMON)].sum(1) / n
    kinds = (s["common"][:, : len(COMMON)] > 0).sum(1)
    columns = [
        np.log1p(s["n_words"]), s["word_chars"] / n, s["n_distinct_words"] / n, s["n_repeat_words"] / n, s["n_dup_lines"] / lines,
        np.log1p(n / lines), common, np.log1p(kinds), np.sqrt(classes[:, CLASSES.index("symbol")]), np.sqrt(classes[:, CLASSES.index("upper")]),
        *classes.T,
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return features((statistics - self.mean) / self.scale, self.frequencies, self.phases) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics), self.knots, self.values), 0, 1)


def features(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    z = np.sqrt(2 / len(phases)) * np.cos(np.clip(x, -8, 8) @ frequencies + phases)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of y on x by pooling adjacent violators, rows of equal x together.

    A knot lies at the mean of each pooled block, so that scores keep rising between them. Values stay a pseudo-row away
    from 0 and 1.
    """
    places, which = np.unique(x, return_inverse=True)
    counts, sums = np.bincount(which), np.bincount(which, y)
    blocks: list[tuple[float, float, float]] = []  # sum of x, sum of y, count
    for at, own, n in zip((places * counts).tolist(), sums.tolist(), counts.tolist()):
        while blocks and blocks[-1][1] * n >= own * blocks[-1][2]:
            before = blocks.pop()
            at, own, n = at + before[0], own + before[1], n + before[2]
        blocks.append((at, own, n))
    b, least = np.array(blocks), 1 / (len(x) + 2)
    return b[:, 0] / b[:, 2], np.clip(b[:, 1] / b[:, 2], least, 1 - least)


def fit(labelled: DataFrame, settings: Settings = Settings(), text_col: str = "text", label_col: str = "label", fold_col: str = "fold") -> Model:
    """labelled: text, label (0 or 1), fold (a number or boolean, modulo settings.folds; null is 0). Null labels are passed over.

    At most settings.max_rows rows should be given (see sample). The weights come from all rows; the calibration scores
    each row by weights without its fold. Rows of a single fold are calibrated by their own weights; without rows the
    model scores a half. Rows that repeat count as often as they are there.
    """
    reachable(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).cast("string"), F.col(label_col).cast("double"), F.pmod(F.coalesce(F.col(fold_col).cast("int"), F.lit(0)), F.lit(settings.folds))).filter(F.col(label_col).isNotNull())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(document_statistics(batch.column(0))), pa.list_(pa.float64())), *batch.columns[1:]], ["x", "y", "fold"])

    measured = rows.mapInArrow(measure, "x array<double>, y double, fold int").repartition(settings.parts).persist()
    try:
        return _fit(measured, settings)
    finally:
        measured.unpersist()


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.array(batch.column(0).flatten()).reshape(batch.num_rows, width)


def _fit(measured: DataFrame, settings: Settings) -> Model:
    width = document_statistics(pa.array([""])).shape[1]
    moments = measured.agg(
        F.array(*[F.coalesce(F.avg(F.col("x")[i]), F.lit(0.0)) for i in range(width)]),
        F.array(*[F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0)) for i in range(width)]),
        F.coalesce(F.avg("y"), F.lit(0.5)),
    ).first()
    mean, scale = np.array(moments[0]), np.maximum(1e-6, np.array(moments[1]))
    random = np.random.default_rng(settings.seed)
    frequencies = random.normal(0, 1 / settings.width, (width, settings.features))
    phases = random.uniform(0, 2 * np.pi, settings.features)
    size = settings.features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((settings.folds, size, size)), np.zeros((settings.folds, size))
        for batch in batches:
            z = features((_matrix(batch, width) - mean) / scale, frequencies, phases)
            y, fold = np.array(batch.column(1)), np.array(batch.column(2))
            for k in np.unique(fold):
                a[k] += z[fold == k].T @ z[fold == k]
                b[k] += z[fold == k].T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array(list(a.reshape(len(a), -1)), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64())), pa.array(range(len(a)), pa.int32())], ["a", "b", "fold"])

    # settings.parts * settings.folds rows of a fixed size
    a, b = np.zeros((settings.folds, size, size)), np.zeros((settings.folds, size))
    for r in measured.mapInArrow(sums, "a array<double>, b array<double>, fold int").toLocalIterator():
        a[r.fold] += np.array(r.a).reshape(size, size)
        b[r.fold] += r.b

    def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + settings.ridge * np.diag([*[1.0] * settings.features, 1e-6]), b)

    if not a[:, -1, -1].sum():
        return Model(mean, scale, frequencies, phases, np.zeros(size), np.zeros(1), np.array([moments[2]]))
    weights = solved(a.sum(axis=0), b.sum(axis=0))
    several = (a[:, -1, -1] > 0).sum() > 1
    unseen = np.stack([solved(a.sum(axis=0) - a[k], b.sum(axis=0) - b[k]) if several else weights for k in range(settings.folds)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = features((_matrix(batch, width) - mean) / scale, frequencies, phases)
            yield pa.RecordBatch.from_arrays([pa.array((z * unseen[np.array(batch.column(2))]).sum(axis=1)), batch.column(1)], ["s", "y"])

    # two numbers for each row of the bounded sample
    held = measured.mapInArrow(scored, "s double, y double").toPandas()
    return Model(mean, scale, frequencies, phases, weights, *isotonic(held["s"].to_numpy(), held["y"].to_numpy()))


def remainder(ident: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 5


def sample(labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id_col, label and fold of the labelled rows to learn from: those of remainder 1 to 4, which is the fold.

    About max_rows at most: beyond, a hash of the id decides. Null ids and labels are passed over; of several labels of
    an id the largest counts.
    """
    rest = remainder(labels[id_col])
    known = labels.filter(labels[id_col].isNotNull() & labels[label_col].isNotNull() & (rest != 0))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("label"))
    n = known.count()
    if n > settings.max_rows:
        known = known.filter(F.pmod(F.xxhash64(id_col, F.lit(settings.seed)), F.lit(1_000_000)) < int(1_000_000 * settings.max_rows / n))
    return known.withColumn("fold", remainder(F.col(id_col)))


def classify(docs: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Only the text is looked at. Null texts count as empty and get the score of an empty text; very long texts are scored
    whole. Rows that repeat, and texts of equal statistics, get equal scores; a score at the threshold is predicted 1.
    Input columns named like the new ones are replaced. An empty table gives an empty result.
    """
    reachable(docs.sparkSession)
    docs = without(docs, "score", "predicted")
    (text,) = fresh(docs, "text_")
    threshold = settings.threshold

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(document_statistics(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.withColumn(text, docs[text_col].cast("string")).mapInArrow(judge, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = sample(table(spark, sf_dir, "labels"))
    # about Settings.max_rows rows of three numbers at most; of rows with one id, one is learnt from
    known = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("fold").alias("fold"))
    model = fit(known)
    return classify(docs, model).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
