"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, label: each linked vertex with the least vertex of its component, written to the shared folder.

    Each round takes the least label among the neighbours and then the label's own label, so that a path of n links
    takes about log n rounds. Vertices may be of any type that can be ordered. Nothing but a count reaches the driver.
    """
    both = written(links.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("u"))).filter("v != u").distinct())
    held = written(both.groupBy("v").agg(F.min("u").alias("least")).select("v", F.least("v", "least").alias("label")))
    while True:
        labels = held.select("v", "label")
        theirs = labels.select(F.col("v").alias("u"), F.col("label").alias("theirs"))
        near = both.join(theirs, "u").groupBy("v").agg(F.min("theirs").alias("near"))
        # written, so that the join below meets two plain scans and can split a hot label
        moved = written(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        discard(held)
        far = moved.select(F.col("v").alias("label"), F.col("label").alias("far"))
        held = written(moved.join(far, "label").select("v", "old", F.least("label", "far").alias("label")))
        discard(moved)
        if held.filter("label != old").isEmpty():
            discard(both)
            return held.select("v", "label")
