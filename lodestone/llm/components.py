"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, any direction and repetition -> (node, component): the smallest node that each linked node reaches.

    Each step groups by node, so hubs are pre-aggregated before a shuffle; the number of steps grows with the logarithm of
    the longest chain. Steps are written to the shared folder; the driver sees only a count and a checksum of each.
    Nodes without a link do not appear. No edges: no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = after
