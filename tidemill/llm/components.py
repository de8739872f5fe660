"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """left join-ed to right's one row per key, where right[count] is the key's rows in left.

    Keys of over a thousandth of `total` left rows are at most a thousand: that bounded part of
    right is broadcast, so such a key's rows stay where they are. All others are shuffled.
    """
    most = max(10_000, total // 1000)
    hot, rest = right.where(F.col(count) > most), right.where(F.col(count) <= most)
    return left.join(F.broadcast(hot), key).unionByName(left.join(rest, key)).drop(count)


def components(edges: DataFrame, rounds: int = 60, few: int = 100_000) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node links its
    larger neighbours, then its smaller ones, to the smallest it knows. Minima are aggregated
    before they are shuffled, and a hub's links are joined where they are. Each round ends in a
    checkpoint in the shared folder. Up to `few` edges are one partition, whose rounds need no
    shuffle. Null ends are left out; nodes without a link to another node have no row.
    """
    shared_dir(edges.sparkSession)  # sets the checkpoint folder where there is none
    links = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    last, most = None, links.count()
    if most <= few:
        links = links.coalesce(1)
    joined = (lambda x, y, n: x.join(y.drop("n"), "u")) if most <= few else (lambda x, y, n: hot_join(x, y, "u", n))
    for _ in range(rounds):
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        last = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if most <= few:
            both = both.coalesce(1)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = joined(both.where("v > u"), low, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined(large, low, now[0])
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = small.select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct().checkpoint()
    raise RuntimeError("components did not settle")
