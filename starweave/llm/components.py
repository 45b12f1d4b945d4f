"""Connected components of a link table by alternating star contraction, all state in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. edges: (u, v), u > v, distinct. large: neighbours above a node move to its least neighbour;
    small: a node and its lower neighbours move to the least of them. Minima are pre-aggregated before the shuffle."""
    if large:
        ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = ends.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        moved = ends.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; component is the least node reachable. Self links and repeats are ignored."""
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    before = _state(edges)
    while before[0]:
        # both contractions in one plan: the state is written once a round
        new = materialize(_star(_star(edges, True), False), "links")
        after = _state(new)
        drop(edges)
        edges = new
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
