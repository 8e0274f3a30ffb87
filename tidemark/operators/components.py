"""Connected components of a graph given as edges: stars are contracted until each node hangs on the smallest of its component.

A round hangs each node's larger neighbours on its smallest one, and then the smaller ones; the number of rounds grows with
the logarithm of the largest distance. Minima are combined before the shuffle, so a node with very many neighbours costs no more
than its edges. Each round is stored, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), numbers of nodes. (node, component): a row for each node with a smaller one in its component, whose number is the smallest."""
    now = _down(edges.select(F.col("a").alias("node"), F.col("b").alias("component"))).checkpoint()
    if now.isEmpty():
        return now
    before = _mark(now)
    while True:
        now = _down(_hang_smaller(_hang_larger(now))).checkpoint()
        if (after := _mark(now)) == before:
            return now
        before = after


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node, without loops."""
    return edges.select(F.greatest("node", "component").alias("node"), F.least("node", "component").alias("component")).filter("node <> component").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "component"))).first())


def _hang_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("component").alias("node"), F.col("node").alias("component")))
    least = both.groupBy("node").agg(F.least("node", F.min("component")).alias("least"))
    return both.filter("component > node").join(least, "node").select(F.col("component").alias("node"), F.col("least").alias("component"))


def _hang_smaller(edges: DataFrame) -> DataFrame:
    edges = _down(edges)
    least = edges.groupBy("node").agg(F.min("component").alias("least"))
    others = edges.join(least, "node").select(F.col("component").alias("node"), F.col("least").alias("component"))
    return others.unionByName(least.withColumnRenamed("least", "component"))
