"""Connected components by alternating large and small stars.

Each round links every node to the smallest node it can see, first among its larger, then
among its smaller neighbours; the edges end as one star per component. Nodes meet their
neighbours only through a minimum, which combines before it is shuffled, and a join with
one row per node on the other side, so a node with very many links is no bottleneck. The
edges of every round are written to shared storage; nothing is collected. The rounds end when
the edges no longer change, after a number in proportion to the logarithm of the nodes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v: every neighbour of u that is larger than u is linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.filter("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The same for smaller neighbours: they and u are linked to the smallest of them. ``edges`` has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (u, v); loops are ignored."""
    edges = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    mark = None
    for n in itertools.count(1):
        large = scratch.table(_large_star(edges), f"{name}-{n}-large")
        edges = scratch.table(_small_star(large), f"{name}-{n}")
        scratch.drop(f"{name}-{n}-large")
        scratch.drop(f"{name}-{n - 1}")
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.table(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), f"{name}-end")
