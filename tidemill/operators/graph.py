"""Bipartite graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint


def normalized_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, w = (deg(u) deg(i))^-1/2; nodes are "u<id>" and "i<id>"."""
    e = edges.select("u", "i").distinct()
    du, di = e.groupBy("u").agg(F.count("*").alias("du")), e.groupBy("i").agg(F.count("*").alias("di"))
    w = e.join(du, "u").join(di, "i").select(F.concat(F.lit("u"), "u").alias("src"), F.concat(F.lit("i"), "i").alias("dst"), (1 / F.sqrt(F.col("du") * F.col("di"))).alias("w"))
    return w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def propagate(edges: DataFrame, features: DataFrame, layers: int) -> DataFrame:
    """(node, dim, x): features (node, dim, x) plus their images under 1..layers multiplications, summed.

    Each layer is checkpointed, so the plan doesn't grow with the layers.
    """
    shared_checkpoint(edges.sparkSession)
    total = now = features.select("node", "dim", "x")
    for _ in range(layers):
        step = edges.join(now, edges["src"] == now["node"]).groupBy("dst", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        now = step.select(F.col("dst").alias("node"), "dim", "x").checkpoint()
        total = total.unionByName(now)
    return total.groupBy("node", "dim").agg(F.sum("x").alias("x"))
