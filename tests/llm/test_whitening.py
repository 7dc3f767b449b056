import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.llm.whitening import Summary, fitted, whiten

SCHEMA = "vec_id long, embedding array<float>, component string"


def plain(vectors):
    """Fit list, sums, eigenvalues and components by one decomposition of all."""
    x = np.unique(np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64), axis=0)
    gap = x * len(x) - x.sum(axis=0)
    values, vecs = np.linalg.eigh((gap / len(x)).T @ (gap / len(x)) / len(x))
    return x, x.sum(axis=0), values[::-1], vecs[:, ::-1].T


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "other") for i, v in rows], SCHEMA).repartition(7)


def check(spark, rows, good, dim):
    out, fit, error = whiten(frame(spark, rows))
    x, sums, values, vecs = plain(list(good.values()))
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(got) == len(good) * min(4, dim) and error < 1e-9
    sign = np.sign((fit.components * vecs).sum(axis=1))
    for ident, vector in good.items():
        own = np.floor(256 * np.asarray(vector, np.float32).astype(np.float64)).astype(np.int64)
        w = vecs[:4] @ (own - sums / len(x)) / np.sqrt(values[:4]) * sign[:4]
        for c in range(min(4, dim)):
            r = got[ident, c + 1]
            assert r["n"] == len(x) and r["deviation"] == sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(own, sums))
            assert r["whitened"] == pytest.approx(w[c], abs=1e-8) and r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-8)


def test_equals_one_decomposition(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 12)) * np.linspace(3, 0.2, 12) + 5
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(base)]
    hot = rows[0][1]
    rows += [(i, hot) for i in range(1000, 1300)]
    good = dict(rows)
    bad = [(2000, None), (2001, []), (2002, [None] + hot[1:]), (2003, [float("nan")] + hot[1:]), (2004, [float("inf")] + hot[1:]), (2005, hot[:5])]
    check(spark, rows + bad, good, 12)


def test_fewer_dimensions_than_components(spark):
    rows = [(i, [float(i % 7), float(-i % 5)]) for i in range(30)]
    check(spark, rows, dict(rows), 2)


def test_no_variance_and_single_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])]
    out, fit, error = whiten(frame(spark, rows))
    got = out.collect()
    assert len(got) == 8 and error == 0.0 and fit.n == 1
    assert all(r["whitened"] == 0 and r["explained"] == 0 and r["deviation"] == 0 for r in got)
    flat = [(i, [float(i), 0.0, 0.0, 0.0, 0.0]) for i in range(4)]
    got = whiten(frame(spark, flat))[0].collect()
    assert {r["component"] for r in got if r["whitened"] != 0} == {1}


def test_null_ids_and_repeats_stay_and_empty(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [4.0, 1.0]), (3, [0.0, 7.0])]
    out, fit, _ = whiten(frame(spark, rows))
    assert out.count() == 8 and fit.n == 3
    out, fit, error = whiten(frame(spark, []))
    assert out.collect() == [] and fit is None and error is None and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained"]
    assert whiten(frame(spark, [(1, None)]))[0].collect() == []


def test_huge_entries_are_exact(spark):
    rows = [(i, [1e14 * i, float(i * i)]) for i in range(1, 9)]
    rows = [(i, [float(np.float32(v)) for v in vector]) for i, vector in rows]
    out, _, error = whiten(frame(spark, rows))
    x = [[int(np.floor(256 * v)) for v in vector] for _, vector in rows]
    sums = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: int(r["deviation"]) for r in out.collect()}
    assert got == {i: sum((8 * a - s) ** 2 for a, s in zip(own, sums)) for (i, _), own in zip(rows, x)} and error < 1e-4
    # beyond 64 bits entries are the nearest long, and deviations of more than 38 digits are null
    out, _, _ = whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]))
    assert out.count() == 6


def test_merges_are_lossless(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2000, 2000, size=(5000, 8))
    whole = Summary.of(x)
    parts = [Summary.of(x[i::37]) for i in range(37)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    assert merged.n == 5000 and merged.sums == whole.sums == [int(s) for s in x.sum(axis=0)]
    np.testing.assert_allclose(merged.values, whole.values, rtol=1e-12)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(20)
    tree = fitted(df, 8, together=3)
    np.testing.assert_allclose(tree.values, whole.values, rtol=1e-12)
    np.testing.assert_allclose(np.abs((tree.vectors * whole.vectors).sum(axis=1)), 1, rtol=1e-9)
    assert tree.sums == whole.sums and fitted(df.filter(F.lit(False)), 8) is None
