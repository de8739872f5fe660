"""Ranks: within groups, and over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint


def rank_within(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based rank in each group; order must end in a unique column, since Spark has no input order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top_within(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The k first of each group; the limit applies on both sides of the shuffle."""
    return rank_within(df, keys, order, name).where(F.col(name) <= k)


def global_rank(df: DataFrame, order: list, name: str = "rank", start: int = 1) -> DataFrame:
    """Rank over the whole table: ranges are sorted apart, and each adds the sizes of those before it.

    The ranges are written to a checkpoint before they are counted, so both reads see the same
    ranges. What is broadcast has one row per partition.
    """
    shared_checkpoint(df.sparkSession)
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = parts.join(F.broadcast(first), "_part")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranked.withColumn(name, (F.col("_first") + local + (start - 1)).cast("long")).drop("_part", "_first")


def global_running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Sum of `value` over all rows before each one in the whole table's order, by ranges as in global_rank()."""
    shared_checkpoint(df.sparkSession)
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_first"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.coalesce(local, F.lit(0))).drop("_part", "_first")


def linear_quantiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of quantiles interpolated between the ranks floor and ceil of q (n - 1); nulls take no part.

    Rows are ranked by ranges, and only the ranks asked for are picked, so no task holds all values.
    """
    ranked = global_rank(df.select(F.col(value).cast("double").alias("_v")).where("_v is not null"), ["_v"], "_r")
    n = ranked.agg(F.count("*").alias("_n"))
    at = lambda q: F.lit(q) * (F.col("_n") - 1)
    ends = [F.struct(F.lit(k).alias("k"), (f(at(q)) + 1).cast("long").alias("_r"), w.alias("w")) for k, q in quantiles.items() for f, w in ((F.floor, 1 - (at(q) - F.floor(at(q)))), (F.ceil, at(q) - F.floor(at(q))))]
    points = n.select(F.explode(F.array(*ends)).alias("p")).select("p.*")  # two rows a quantile
    found = ranked.join(F.broadcast(points), "_r")
    return found.agg(*[F.sum(F.when(F.col("k") == k, F.col("w") * F.col("_v"))).alias(k) for k in quantiles])


def equal_frequency_bin(rank: Column, n: Column, k: int = 3) -> Column:
    """Bin 1..k of rank 1..n: the smallest j with k (rank - 1) <= j (n - 1); differs from ntile in sizes."""
    out = F.lit(k)
    for j in range(k - 1, 0, -1):
        out = F.when(k * (rank - 1) <= j * (n - 1), j).otherwise(out)
    return out.cast("long")


def right_closed_bin(value: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[i] where edges[i] < value <= edges[i + 1]; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def quantile_at(values: Column, q: float, rule: str) -> Column:
    """Quantile of an array: "nearest" (half to even index) or "higher" of q (n - 1)."""
    at = F.lit(q) * (F.size(values) - 1)
    index = F.bround(at) if rule == "nearest" else F.ceil(at)
    return F.try_element_at(F.array_sort(values), index.cast("int") + 1)


def budget_size(n: Column, share: float) -> Column:
    """max(1, round half to even of n * share)."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(share))).cast("long")
