"""Connected components by alternating stars: each step is a few aggregations and joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); the component is its smallest node.

    Every step links each node to the smallest of its neighbours, first for the larger and then for the smaller
    ones, so paths shorten by more than half; it ends when a step changes nothing. Nothing is collected but counts.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "edges")
    before = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct(), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        old, now = now, staged(small.distinct(), "small")
        discard(old, large)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    out = staged(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct(), "components")
    discard(now)
    return out
