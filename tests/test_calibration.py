import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.operators import calibration


def plain_curve(pairs):
    """Row by row: pool, then merge knots that are near in both, then thin plateaus."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    pools = []
    for s, label in pairs:
        pools.append([label, 1, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    fitted = [p[0] / p[1] for p in pools for _ in range(p[2])]
    x, y = [], []
    for (s, _), v in zip(pairs, fitted):
        if x and s - x[-1] < 1e-12:
            y[-1] = max(y[-1], v)
        elif x and v - y[-1] < 1e-6 and s - x[-1] < 1e-4:
            x[-1], y[-1] = s, v
        else:
            x.append(s)
            y.append(v)
    kept_x, kept_y = [x[0]], [y[0]]
    for i in range(1, len(x)):
        if i == len(x) - 1 or y[i] - kept_y[-1] > 1e-5:
            kept_x.append(x[i])
            kept_y.append(y[i])
    return kept_x, kept_y


def made(seed, n, grain):
    rng = np.random.default_rng(seed)
    s = np.round(rng.uniform(0, 1, n), grain)
    return [(float(a), int(b)) for a, b in zip(s, rng.uniform(0, 1, n) < s**2)]


@pytest.mark.parametrize("seed, n, grain", [(1, 3000, 9), (2, 3000, 2), (3, 20000, 4), (4, 7, 1), (5, 1500, 3)])
def test_parallel_fit_equals_row_by_row(spark, seed, n, grain):
    pairs = made(seed, n, grain)
    curve = calibration.fit(spark.createDataFrame(pairs, "similarity double, label int").repartition(5))
    x, y = plain_curve(pairs)
    assert curve.x == pytest.approx(x, abs=1e-12) and curve.y == pytest.approx(y, abs=1e-9)


def test_near_knots_merge_at_the_last(spark):
    pairs = [(0.1, 0), (0.10005, 0), (0.1001, 0), (0.3, 0), (0.5, 1), (0.50005, 1), (0.9, 1)]
    curve = calibration.fit(spark.createDataFrame(pairs, "similarity double, label int"))
    assert curve.x == pytest.approx((0.1001, 0.50005, 0.9)) and curve.y == (0.0, 1.0, 1.0) and plain_curve(pairs)[0] == pytest.approx(curve.x)


def test_ranges_merge_across_levels(spark):
    pairs = spark.createDataFrame(made(6, 4000, 9), "s double, label int").select("s", F.col("label").cast("double"), F.lit(1.0).alias("weight"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        two, many = calibration.isotonic_blocks(pairs, together=2), calibration.isotonic_blocks(pairs, together=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert two == many == calibration.pooled(sorted((r.s, r.s, r.s, r.label, 1.0) for r in pairs.collect()))


def test_single_value_null_and_empty(spark):
    one = calibration.fit(spark.createDataFrame([(0.5, 1), (0.5, 0), (None, 1), (float("nan"), 1)], "similarity double, label int"))
    assert one.x == pytest.approx((0.5, 0.5001)) and one.y == (0.5, 0.5)
    with pytest.raises(ValueError):
        calibration.fit(spark.createDataFrame([], "similarity double, label int"))
