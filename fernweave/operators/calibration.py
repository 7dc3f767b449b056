"""Calibration of similarities to scores in 0..1 by isotonic regression."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import importable
from ..sources.shared import kept


@dataclass(frozen=True)
class Calibrator:
    """A rising curve through knots; constant beyond the first and the last."""

    x: tuple[float, ...]
    y: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.x) != len(self.y) or len(self.x) < 2:
            raise ValueError("a calibrator needs two knots or more")
        if any(b < a for a, b in zip(self.x, self.x[1:])) or any(b < a for a, b in zip(self.y, self.y[1:])):
            raise ValueError("knots must rise")

    def transform(self, similarity: Column) -> Column:
        """The curve's value, in JVM expressions."""
        x = similarity.cast("double")
        out = F.lit(float(self.y[-1]))
        for x0, y0, x1, y1 in reversed(list(zip(self.x, self.y, self.x[1:], self.y[1:]))):
            if x1 > x0:
                out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
        out = F.when(x <= self.x[0], float(self.y[0])).otherwise(out)
        return F.when(x.isNotNull(), F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))

    def values(self, similarities: np.ndarray) -> np.ndarray:
        """The curve's values, within a task."""
        return np.clip(np.interp(similarities, self.x, self.y), 0.0, 1.0)

    def up_to(self, values: np.ndarray) -> np.ndarray:
        """Similarities up to which the curve isn't above the values, or a little less: infinite where it never is, or always."""
        x, y = np.array(self.x), np.clip(self.y, 0.0, 1.0)
        at = np.searchsorted(y, values, side="right")
        low, high = np.clip(at - 1, 0, None), np.clip(at, None, len(y) - 1)
        rise = y[high] - y[low]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.clip((values - y[low]) / rise - 1e-9 - 1e-15 / rise, 0.0, 1.0)  # less what rounding may take
        between = x[low] + share * (x[high] - x[low])
        return np.where(at == 0, -np.inf, np.where(at == len(y), np.inf, between - 1e-12 * (1 + np.abs(between))))

    def dumps(self) -> str:
        return json.dumps({"x": self.x, "y": self.y})

    @staticmethod
    def loads(text: str) -> Calibrator:
        data = json.loads(text)
        return Calibrator(tuple(map(float, data["x"])), tuple(map(float, data["y"])))


def thin(x: list[float], y: list[float]) -> tuple[list[float], list[float]]:
    """Of each plateau the first knot, and the last knot of all: a plateau becomes a ramp to the next one."""
    keep = [0]
    for i in range(1, len(x)):
        if i == len(x) - 1 or y[i] - y[keep[-1]] > 1e-5:
            keep.append(i)
    return [x[i] for i in keep], [y[i] for i in keep]


#: Knots nearer than these in both are one, and so are knots at one place.
NEAR_Y, NEAR_X, SAME_X = 1e-6, 1e-4, 1e-12

Block = tuple[float, float, float, float, float]
BLOCK = "slot long, first double, run double, last double, total double, weight double"


def _joined(a: Block, b: Block) -> Block:
    """Neighbouring blocks as one. A block: its first x, the end of its first run of near x, its last x, sum of labels, weight."""
    run = b[1] if a[1] == a[2] and b[0] - a[2] < NEAR_X else a[1]
    return a[0], run, b[2], a[3] + b[3], a[4] + b[4]


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Adjacent violators pooled: blocks by rising x become blocks of rising means."""
    out: list[Block] = []
    for block in blocks:
        while out and out[-1][3] * block[4] >= block[3] * out[-1][4]:
            block = _joined(out.pop(), block)
        out.append(block)
    return out


def isotonic_blocks(weighed: DataFrame, together: int = 8) -> list[Block]:
    """The pooled blocks of s, label and weight, one row for each s, by rising s.

    Ranges of s are pooled in parallel, then the blocks of `together` neighbouring ranges, level by level: pooling
    the blocks of two ranges gives what pooling all their rows would. What the driver gets are the curve's own steps.
    """
    importable(weighed.sparkSession)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in zip(*(pdf[c].tolist() for c in ("s", "s", "s", "total", "weight"))))
        yield pd.DataFrame([(0, *b) for b in pooled(rows)], columns=NAMES)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        return pd.DataFrame([(int(pdf["to"].iat[0]), *b) for b in pooled(zip(*(pdf[c].tolist() for c in NAMES[1:])))], columns=NAMES)

    rows = weighed.select("s", (F.col("label") * F.col("weight")).alias("total"), "weight").repartitionByRange("s").sortWithinPartitions("s")
    level = kept(rows.mapInPandas(first, BLOCK).withColumn("slot", F.spark_partition_id().cast("long")))
    top = level.agg(F.max("slot")).first()[0] or 0
    while top > 0:
        top //= together
        level = level.withColumn("to", F.floor(F.col("slot") / together)).groupBy("to").applyInPandas(merge, BLOCK)
    return sorted((r["first"], r["run"], r["last"], r["total"], r["weight"]) for r in level.collect())


NAMES = [f.split()[0] for f in BLOCK.split(", ")]


def knots(blocks: Iterable[Block]) -> tuple[list[float], list[float]]:
    """The knots of a curve through rows of blocks, before thinning. Near rows are one knot, at the last of them.

    Of a block's knots the first and the last are given: those between them are of equal height, and go when thinned.
    """
    x: list[float] = []
    y: list[float] = []
    for first, run, last, total, weight in blocks:
        height = max(min(1.0, max(0.0, total / weight)), y[-1] if y else 0.0)
        if x and first - x[-1] < SAME_X:
            y[-1] = height
        elif x and height - y[-1] < NEAR_Y and first - x[-1] < NEAR_X:
            x[-1], y[-1] = run, height
        else:
            x.append(run)
            y.append(height)
        if last > x[-1]:
            x.append(last)
            y.append(height)
    return x, y


def fit(pairs: DataFrame, similarity: str = "similarity", label: str = "label") -> Calibrator:
    """From similarities and 0/1 labels, as they are: the rising least-squares fit, with near knots merged and plateaus thinned.

    Equal similarities are pre-aggregated to one weighted row; NaN and null ones are passed over. Without pairs there is nothing to fit: a ValueError.
    """
    plain = pairs.select(F.col(similarity).cast("double").alias("s"), F.col(label).cast("double").alias("label"))
    plain = plain.filter(F.col("s").isNotNull() & ~F.isnan("s") & F.col("label").isNotNull())
    blocks = isotonic_blocks(plain.groupBy("s").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight")))
    if not blocks:
        raise ValueError("no calibration pairs")
    x, y = thin(*knots(blocks))
    if len(x) == 1:
        x, y = [x[0], x[0] + 1e-4], [y[0], y[0]]
    return Calibrator(tuple(x), tuple(y))


PARTS = 256  # hash ranges of the catalog


def negative_sample(examples: DataFrame, catalog: DataFrame, n: int = 8, seed: int = 42) -> DataFrame:
    """example_id, target, negative: n models of the catalog other than the target for each example, by seeded hashes.

    The catalog is numbered by hash ranges. An example's draws are a progression modulo the catalog's size from a hashed
    start, with a hashed step that shares no factor with the size: n + 1 draws differ, so n other models are left, or
    all others of a smaller catalog. No pair of example and model is formed that isn't drawn.
    """
    hashed = catalog.select("model").distinct().withColumn("h", F.xxhash64("model")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # PARTS rows at most
    before = hashed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("h", "model")) - 1
    numbered = hashed.withColumn("place", inside).join(F.broadcast(before), "part").select("model", (F.col("before") + F.col("place")).alias("number"))
    size = max(1, hashed.count())
    random = np.random.default_rng(seed)
    tried = [1, *random.integers(1, max(2, size), 400).tolist()]
    steps = F.array(*[F.lit(s).cast("long") for s in dict.fromkeys(tried) if math.gcd(s, size) == 1])
    start = F.pmod(F.xxhash64("example_id", F.lit(seed)), F.lit(size))
    step = F.element_at(steps, F.pmod(F.xxhash64(F.lit(seed), "example_id"), F.size(steps)).cast("int") + 1)
    turns = F.sequence(F.lit(0), F.lit(min(n, size - 1)))
    asked = examples.select("example_id", "target", start.alias("start"), step.alias("step"))
    draw = F.transform(turns, lambda j: F.struct(F.pmod(F.col("start") + j * F.col("step"), F.lit(size)).alias("number"), j.alias("j")))
    drawn = asked.select("example_id", "target", F.inline(draw)).join(numbered, "number").filter("model != target")
    turn = F.row_number().over(W.partitionBy("example_id").orderBy("j"))
    return drawn.withColumn("turn", turn).filter(F.col("turn") <= n).select("example_id", "target", F.col("model").alias("negative"))
