"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pplscope import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node near. Large star: each node's larger neighbours; small star:
    its smaller ones and itself. Sums are partial; a node with very many neighbours is one row after them,
    and the join back lets Spark split it."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = edges.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:  # edges run from the larger node a to the smaller b
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    moved = moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return moved if large else moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node with an edge. `edges` has two
    long columns, a and b. Each round is a written table; their number grows with the logarithm of a
    component's size."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = scratch.materialize(edges, "edges"), None
    while True:
        edges = scratch.materialize(_star(_star(edges, large=True), large=False), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
