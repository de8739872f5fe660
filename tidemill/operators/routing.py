"""Budgeted routing between a cheap and a dear model, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import budget_size, global_rank


def linear_gate(rows: DataFrame, manifest: dict) -> DataFrame:
    """probability and use_large of a logistic gate given as {"features": [(name, mean, scale, weight)], "bias", "threshold"}."""
    z = F.lit(float(manifest["bias"]))
    for name, mean, scale, weight in manifest["features"]:
        z = z + weight * (F.col(name) - mean) / scale
    return rows.withColumn("probability", 1 / (1 + F.exp(-z))).withColumn("use_large", F.col("probability") >= manifest["threshold"])


def top_budget(rows: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """use_large for the max(1, bround(n * share)) highest scores; ties to the smaller key."""
    n = rows.agg(budget_size(F.count("*"), share).alias("_k"))
    ranked = global_rank(rows, [F.desc(score), F.asc(key)], "_at")
    return ranked.crossJoin(F.broadcast(n)).withColumn("use_large", F.col("_at") <= F.col("_k")).drop("_at", "_k")


def tail_floor(rows: DataFrame, score: str, key: str, bucket: str, share: float, floor: float, name: str = "tail") -> DataFrame:
    """Routes bround(floor * rows of the bucket) of the bucket first (within the budget), then the best of the rest."""
    sizes = rows.agg(
        budget_size(F.count("*"), share).alias("_k"), F.bround(F.count(F.when(F.col(bucket) == name, 1)) * F.lit(floor)).cast("long").alias("_f")
    ).withColumn("_f", F.least("_f", "_k"))
    base = rows.crossJoin(F.broadcast(sizes))
    special = global_rank(base.where(F.col(bucket) == name), [F.desc(score), F.asc(key)], "_at").withColumn("_kept", F.col("_at") <= F.col("_f"))
    every = special.unionByName(base.where((F.col(bucket) != name) | F.col(bucket).isNull()).withColumn("_at", F.lit(0).cast("long")).withColumn("_kept", F.lit(False)))
    ranked = global_rank(every, [F.desc("_kept"), F.desc(score), F.asc(key)], "_all")
    return ranked.withColumn("use_large", F.col("_all") <= F.col("_k")).drop("_at", "_kept", "_k", "_f", "_all")


def policy(rows: DataFrame, bucket: str | None = None) -> DataFrame:
    """Quality, gain, call rate and latency of a routed table (use_large, small_quality, large_quality, small_ms, large_ms).

    With a bucket also a row for each of its values; bucket "overall" is all rows.
    """
    q = F.when(F.col("use_large"), F.col("large_quality")).otherwise(F.col("small_quality"))
    ms = F.when(F.col("use_large"), F.col("large_ms")).otherwise(F.col("small_ms"))
    aggs = [
        F.count("*").alias("n"),
        F.avg(q).alias("quality"),
        F.avg(q - F.col("small_quality")).alias("gain"),
        F.avg(F.col("use_large").cast("double")).alias("call_rate"),
        F.avg(ms).alias("mean_ms"),
    ]
    if not bucket:
        return rows.agg(*aggs)
    sets = rows.withColumn("_bucket", F.col(bucket)).rollup("_bucket").agg(*aggs, F.grouping("_bucket").alias("_all"))
    return sets.withColumn("bucket", F.when(F.col("_all") == 1, "overall").otherwise(F.col("_bucket"))).drop("_all", "_bucket")


def threshold_grid(rows: DataFrame, score: str, grid: list[float], most_calls: float) -> DataFrame:
    """The threshold of the grid with the best quality whose call rate is feasible; ties to fewer calls, then the higher."""
    points = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold")
    use = F.col(score) >= F.col("threshold")
    found = rows.select("*", points).groupBy("threshold").agg(
        F.avg(use.cast("double")).alias("call_rate"), F.avg(F.when(use, F.col("large_quality")).otherwise(F.col("small_quality"))).alias("quality")
    )
    return found.where(F.col("call_rate") <= most_calls).orderBy(F.desc(F.round("quality", 9)), "call_rate", F.desc("threshold")).limit(1)


def oracle_curve(rows: DataFrame, key: str, budgets: list[float]) -> DataFrame:
    """(budget, quality) if the calls went to the largest gains."""
    gain = F.col("large_quality") - F.col("small_quality")
    n = rows.count()
    ranked = global_rank(rows.withColumn("_g", gain), [F.desc("_g"), F.asc(key)], "_at")
    ranked = ranked.withColumn("_n", F.lit(n))
    points = ranked.select("*", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"))
    use = F.col("_at") <= F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("budget")))
    return points.groupBy("budget").agg(F.avg(F.when(use, F.col("large_quality")).otherwise(F.col("small_quality"))).alias("quality"))


def cost_adjusted(rows: DataFrame, models: list[tuple[str, str]], weight: float) -> DataFrame:
    """choice: the model with the largest prediction - weight * latency, first of equals."""
    values = [F.struct((F.col(p) - weight * F.col(ms)).alias("v"), F.lit(-i).alias("o"), F.lit(p).alias("m")) for i, (p, ms) in enumerate(models)]
    return rows.withColumn("choice", F.array_max(F.array(*values))["m"])


def circuit_breaker_runs(rows: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """Consecutive failures up to each row of a key: the length of the current run of failed rows."""
    w = Window.partitionBy(key).orderBy(order)
    run = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).withColumn("consecutive_failures", F.sum(F.col(failed).cast("long")).over(Window.partitionBy(key, "_run").orderBy(order))).drop("_run")


def fallback_rule(rows: DataFrame, words: str, thresholds: list[int]) -> DataFrame:
    """(threshold, quality, fallback_queries, selected): rows of fewer words than the threshold take the small model.

    Threshold 0 never does. Selected is the best quality, then the smallest threshold.
    """
    points = rows.select("*", F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds])).alias("threshold"))
    short = F.col(words) < F.col("threshold")
    out = points.groupBy("threshold").agg(F.avg(F.when(short, F.col("small_quality")).otherwise(F.col("large_quality"))).alias("quality"), F.count(F.when(short, 1)).alias("fallback_queries"))
    best = out.agg(F.max(F.struct(F.round("quality", 9), -F.col("threshold")))["col2"].alias("_b"))  # a row a threshold
    return out.crossJoin(F.broadcast(best)).withColumn("selected", -F.col("threshold") == F.col("_b")).drop("_b")


def tail_priority_curve(rows: DataFrame, key: str, bucket: str, budgets: list[float], name: str = "tail") -> DataFrame:
    """(budget, quality, tail_quality, calls) if calls went to the bucket's largest gains first, then to the others'."""
    gain = F.col("large_quality") - F.col("small_quality")
    first = F.when(F.col(bucket) == name, 1).otherwise(0)
    ranked = global_rank(rows.withColumn("_p", first).withColumn("_g", gain), [F.desc("_p"), F.desc("_g"), F.asc(key)], "_at")
    n = rows.agg(F.count("*").alias("_n"))
    points = ranked.crossJoin(F.broadcast(n)).select("*", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"))
    use = F.col("_at") <= F.bround(F.col("_n") * F.col("budget"))
    got = F.when(use, F.col("large_quality")).otherwise(F.col("small_quality"))
    return points.groupBy("budget").agg(F.avg(got).alias("quality"), F.avg(F.when(F.col("_p") == 1, got)).alias("tail_quality"), F.count(F.when(use, 1)).alias("calls"))
