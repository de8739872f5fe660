"""Inference on paired and independent samples, and correlations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from .ordering import global_running_sum, linear_quantiles, rank_within


def hash_bootstrap(rows: DataFrame, key: str, values: list[str], replicates: int, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, replicate, n, mean_<value>...): Poisson(1) weights drawn from a hash of (seed, replicate, key).

    Weights depend on the key alone, so replicates need no order of rows and survive lost
    executors; any engine with md5 gives the same draws. Rows times replicates are aggregated
    where they are made.
    """
    reps = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    weight, below = F.lit(0), 0.0
    for k in range(8):  # the distribution function of Poisson(1)
        below += math.exp(-1) / math.factorial(k)
        weight = F.when(u >= below, k + 1).otherwise(weight) if k else F.when(u >= below, 1).otherwise(0)
    w = reps.withColumn("w", weight)
    means = [(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(f"mean_{v}") for v in values]
    return w.groupBy(*by, "replicate").agg(F.sum("w").alias("n"), *means)


def two_sample_bootstrap(rows: DataFrame, key: str, value: str, treated: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(low, high, p_positive, p_two_sided) of mean(treated) - mean(others), both arms resampled apart."""
    reps = hash_bootstrap(rows, key, [value], replicates, seed, (treated,))
    arm = lambda t: F.max(F.when(F.col(treated) == t, F.col(f"mean_{value}")))
    return interval(reps.groupBy("replicate").agg((arm(True) - arm(False)).alias("difference")), "difference")


def bucket_intervals(rows: DataFrame, key: str, value: str, bucket: str, replicates: int = 1000, seed: int = 7, tail: float = 0.025) -> DataFrame:
    """(bucket, n, mean, positive, low, high): order statistics of each bucket's replicates, without interpolation.

    low is the replicate with tail * replicates smaller ones, high the one with as many larger ones.
    """
    reps = hash_bootstrap(rows, key, [value], replicates, seed, (bucket,))
    ranked = rank_within(reps, [bucket], [f"mean_{value}", "replicate"], "_at")  # at most `replicates` rows a bucket
    cut = int(replicates * tail)
    at = lambda r: F.max(F.when(F.col("_at") == r, F.col(f"mean_{value}")))
    ends = ranked.groupBy(bucket).agg(at(cut + 1).alias("low"), at(replicates - cut).alias("high"))
    seen = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))
    return seen.join(ends, bucket)


def statistics(rows: DataFrame, value: str) -> DataFrame:
    """(n, mean, std, min, p01, median, p99, max) of a column; quantiles by rank, so nothing meets in one task."""
    shape = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = linear_quantiles(rows, value, {"p01": 0.01, "median": 0.5, "p99": 0.99})
    return shape.crossJoin(F.broadcast(q))  # one row each


def embedding_drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(metric, n, mean, std, min, p01, median, p99, max, below_0p9, below_0p5) of tables (key, v) with the same keys.

    Metrics: cosine, l2 and relative_l2 of each vector's change; 0 where a norm is at most 1e-12.
    """
    j = before.select(key, F.col("v").alias("a")).join(after.select(key, F.col("v").alias("b")), key)
    change = F.zip_with("a", "b", lambda x, y: y.cast("double") - x.cast("double"))
    na, nb, moved = norm(F.col("a")), norm(F.col("b")), norm(change)
    share = lambda x, y: F.when(y > 1e-12, x / y).otherwise(0.0)
    made = {"cosine": share(dot(F.col("a"), F.col("b")), na * nb), "l2": moved, "relative_l2": share(moved, na)}
    m = j.select(*[c.alias(n) for n, c in made.items()])
    out = None
    for name in made:
        below = m.agg(*[F.avg((F.col(name) < t).cast("double")).alias(f"below_{str(t).replace('.', 'p')}") for t in (0.9, 0.5)])
        row = statistics(m, name).crossJoin(F.broadcast(below)).withColumn("metric", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def interval(replicates: DataFrame, value: str) -> DataFrame:
    """(low, high, p_positive, p_two_sided): percentile interval, with one added to both tails of p."""
    r = replicates.agg(
        F.percentile(value, F.lit(0.025)).alias("low"),
        F.percentile(value, F.lit(0.975)).alias("high"),
        F.avg((F.col(value) > 0).cast("double")).alias("p_positive"),
        F.count(F.when(F.col(value) <= 0, 1)).alias("_le"),
        F.count(F.when(F.col(value) >= 0, 1)).alias("_ge"),
        F.count("*").alias("_n"),
    )
    p = F.least(F.lit(1.0), 2 * (F.least("_le", "_ge") + 1) / (F.col("_n") + 1))
    return r.select("low", "high", "p_positive", p.alias("p_two_sided"))


def paired_bootstrap(differences: DataFrame, values: list[str], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(metric, mean, low, high, se, p_positive, p_two_sided) by multinomial resampling of one bounded table.

    The per-query differences of one experiment (thousands of rows) meet in one task; for tables
    without such a bound use hash_bootstrap().
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(values)[values].to_numpy(float)
        n = len(x)
        rng = np.random.default_rng(seed)
        means = np.vstack([rng.multinomial(n, np.full(n, 1 / n), size=min(256, replicates - i)) @ x / n for i in range(0, replicates, 256)])
        low, high = np.percentile(means, [2.5, 97.5], axis=0)
        le, ge = (means <= 0).sum(axis=0), (means >= 0).sum(axis=0)
        p = np.minimum(1, 2 * (np.minimum(le, ge) + 1) / (replicates + 1))
        return pd.DataFrame({"metric": values, "mean": x.mean(axis=0), "low": low, "high": high, "se": means.std(axis=0, ddof=1), "p_positive": (means > 0).mean(axis=0), "p_two_sided": p})

    schema = "metric string, mean double, low double, high double, se double, p_positive double, p_two_sided double"
    return differences.select(*values, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, schema)


def erfc(x):
    """Complementary error function of a column (Abramowitz and Stegun 7.1.26 is too coarse; this is the continued form of Numerical Recipes, 1.2e-7)."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = poly * t + c
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2 - r)


def sample_ratio(rows: DataFrame, treated, share: float = 0.5) -> DataFrame:
    """(n, treatment, z, p_value) of the number of treated rows against a binomial share."""
    a = rows.agg(F.count("*").alias("n"), F.count(F.when(treated, 1)).alias("treatment"))
    z = (F.col("treatment") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    return a.withColumn("z", z).withColumn("p_value", erfc(F.abs(F.col("z")) / math.sqrt(2)))


def average_rank(df: DataFrame, value: str, name: str, keys: list[str] = ()) -> DataFrame:
    """Mean rank of ties, by counts of distinct values; without keys, ranges are summed apart."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    else:
        counts = global_running_sum(counts, [value], "_c", "_before")
    ranks = counts.withColumn(name, F.col("_before") + (F.col("_c") + 1) / 2).drop("_c", "_before")
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    from .calibration import correlation

    r = average_rank(average_rank(df.select(x, y), x, "_x"), y, "_y")
    return r.agg(correlation("_x", "_y").alias("spearman"))
