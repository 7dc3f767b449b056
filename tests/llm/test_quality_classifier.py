import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernweave.llm import quality_classifier as Q


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    return labels, Q.op7_quality_classifier(spark, d).collect()


def test_held_out(scored):
    labels, rows = scored
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    label = np.array([labels[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), label) > 0.99
    assert np.mean([r.predicted == y for r, y in zip(held, label)]) > 0.97


def test_held_out_labels_have_no_part(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    chosen = Q.sample(labels)
    turned = labels.withColumn("quality", F.when(Q.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(chosen.collect()) == sorted(Q.sample(turned).collect())
    assert chosen.filter(Q.remainder(F.col("doc_id")) == 0).isEmpty()


def test_sample_is_bounded(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    assert 800 < Q.sample(labels, Q.Settings(max_rows=1000)).count() < 1200


def test_isotonic_rises():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 2000)
    knots, values = Q.isotonic(x, (rng.uniform(0, 1, 2000) < x).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    assert abs(np.interp(0.5, knots, values) - 0.5) < 0.1


def test_statistics_are_finite():
    x = Q.document_statistics(pa.array([None, "", "\n", "a", "é" * 1000, "the " * 50_000]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


def test_edge_cases(spark):
    schema = "doc_id long, text string, label int, fold boolean, score string"
    rows = [(i, "the words are good here" if i % 2 else "### $$$ %%%", i % 2, i % 4 > 1, "x") for i in range(400)] + [(900, None, None, None, "x"), (901, "", 1, True, "x")]
    df = spark.createDataFrame(rows, schema)
    out = {r.doc_id: r for r in Q.classify(df, Q.fit(df)).collect()}
    assert out[1].score > out[0].score and out[900].score == out[901].score
    empty = df.limit(0)
    assert Q.classify(empty, Q.fit(empty)).collect() == []
    assert 0 <= Q.classify(df, Q.fit(empty)).first().score <= 1


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_with_few_labels(spark, sf):
    d = f"/root/testdata/sf{sf}"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in Q.op7_quality_classifier(spark, d).collect() if r.held_out and r.doc_id in labels]
    label = np.array([labels[r.doc_id] for r in held])
    assert np.mean([r.predicted == y for r, y in zip(held, label)]) > 0.97 and auc(np.array([r.score for r in held]), label) > 0.99


def plain_isotonic(x, y):
    """max over starts of min over ends of the mean: the rising least-squares fit, at each distinct x."""
    places = np.unique(x)
    n, s = np.array([(x == p).sum() for p in places]), np.array([y[x == p].sum() for p in places])
    mean = lambda j, k: s[j : k + 1].sum() / n[j : k + 1].sum()
    return places, np.array([max(min(mean(j, k) for k in range(i, len(places))) for j in range(i + 1)) for i in range(len(places))])


def test_isotonic_equals_plain_with_ties():
    rng = np.random.default_rng(8)
    for levels in (5, 17, 1000):
        x = rng.integers(0, levels, 60) / levels
        y = (rng.uniform(0, 1, 60) < x).astype(float)
        places, want = plain_isotonic(x, y)
        knots, values = Q.isotonic(x, y)
        blocks = [places[want == v] for v in np.unique(want)]
        assert len(knots) == len(blocks)
        np.testing.assert_allclose(values, np.clip(np.unique(want), 1 / 62, 1 - 1 / 62))
        np.testing.assert_allclose(knots, [x[np.isin(x, b)].mean() for b in blocks])


def test_fit_equals_plain_version(spark):
    """Statistics, kernel features, ridge weights, cross-fitted scores and calibration, by one matrix of all rows."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "of", "word", "Große", "##", "x9"], rng.integers(1, 60))) for _ in range(300)]
    label = [int(("##" not in t) or i % 11 == 0) for i, t in enumerate(texts)]
    settings = Q.Settings(features=40, parts=3)
    rows = [(t, y, i % 5) for i, (t, y) in enumerate(zip(texts, label))] + [("no label", None, 1)]
    model = Q.fit(spark.createDataFrame(rows, "text string, label int, fold int"), settings)
    x = np.stack([Q.document_statistics(pa.array([t]))[0] for t in texts])
    y, fold = np.array(label, float), np.arange(300) % 5 % 4
    random = np.random.default_rng(settings.seed)
    w, p = random.normal(0, 1 / settings.width, (x.shape[1], 40)), random.uniform(0, 2 * np.pi, 40)
    z = np.hstack([np.sqrt(2 / 40) * np.cos(np.clip((x - x.mean(0)) / np.maximum(1e-6, x.std(0)), -8, 8) @ w + p), np.ones((300, 1))])
    penalty = np.diag([1.0] * 40 + [1e-6])
    ridge = lambda rows: np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])
    np.testing.assert_allclose(model.weights, ridge(fold >= 0), rtol=1e-6, atol=1e-9)
    unseen = np.array([z[i] @ ridge(fold != fold[i]) for i in range(300)])
    knots, values = Q.isotonic(unseen, y)
    np.testing.assert_allclose(model.knots, knots, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(model.values, values, rtol=1e-9)


def test_repeats_ties_and_scores_at_the_threshold(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b a"), (3, None)], "doc_id long, text string")
    model = Q.Model(*(getattr(Q.fit(df.limit(0).selectExpr("doc_id", "text", "1 as label", "1 as fold")), f) for f in ("mean", "scale", "frequencies", "phases", "weights", "knots")), np.array([0.3]))
    out = Q.classify(df, model).collect()
    assert len(out) == 4 and all(r.score == 0.3 and r.predicted == 1 for r in out)
