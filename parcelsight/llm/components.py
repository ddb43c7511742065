"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import written


#: Edges (two longs each, 4 MB together) up to which a round is one task, without a shuffle.
FEW = 1 << 18


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table of longs.

    ``component`` is the smallest node reachable. Loops and null ends are ignored, repeated
    edges count once; nodes without an edge aren't returned. Every round replaces an edge by one
    to the smallest neighbour, from the larger ends (large star) and then the smaller ends (small
    star), until nothing changes: a few rounds, logarithmic in the longest path. Minima are taken
    before rows are joined, and written, so that a node with very many edges is a skewed join
    side, which Spark splits. Rounds are written to the shared folder. Rounds of at most ``FEW``
    edges are not dealt over tasks: moving so few costs more than the work.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    current = written(
        edges.where((F.col(a) != F.col(b))).select(hi.alias("hi"), lo.alias("lo")).distinct(),
        "components")
    before = _signature(current)

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if before[0] <= FEW else rows

    while before[0]:
        both = gathered(current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
        smallest = written(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components")
        large = gathered(written(
            both.where("v > u").join(gathered(smallest), "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "components"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        others = (
            large.join(least, "hi").where("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        current = written(
            gathered(least.select("hi", F.col("m").alias("lo")).union(others)).distinct(),
            "components")
        after = _signature(current)
        if after == before:
            break
        before = after
    found = gathered(current).groupBy("hi").agg(F.min("lo").alias("component"))
    roots = gathered(current.select(F.col("lo").alias("node"))).distinct().select(
        "node", F.col("node").alias("component"))
    return found.select(F.col("hi").alias("node"), "component").union(roots)
