"""Connected components by alternating large and small stars.

Every step is a minimum by node (combined before the shuffle) and a join with that
minimum's written table, in which a hub's row is broadcast: its links need not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, join_counted, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node that has a link; label is the smallest node of its component."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    e = materialize(e, "cc-edges")
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        n = F.count(F.lit(1)).alias("n")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), n).select("u", F.least("u", "m").alias("m"), "n"), "cc-min")
        up = join_counted(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        up = materialize(up, "cc-large")
        least2 = materialize(up.groupBy("hi").agg(F.min("lo").alias("m"), n), "cc-min")
        down = join_counted(up, least2, "hi", "n").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = materialize(down.unionByName(least2.select("hi", F.col("m").alias("lo"))).distinct(), "cc-edges")
        for old in (e, least, up, least2):
            drop(old)
        e, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )
