"""Probability calibration and uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit_clip(x: Column, most: float = 20.0) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long")


def reliability(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, confidence, accuracy) of every bin of rows (probability, label); empty bins have zeros."""
    spark = rows.sparkSession
    got = rows.groupBy(bin_of(F.col("probability"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("probability").alias("confidence"), F.avg((F.col("label") > 0).cast("double")).alias("accuracy")
    )
    return spark.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(got), "bin", "left").na.fill(0)  # at most `bins` rows


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(ece): gaps between confidence and accuracy weighted by bin sizes."""
    r = reliability(rows, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def proper_scores(rows: DataFrame, clip: float = 1e-7) -> DataFrame:
    """(log_loss, brier) of rows (probability, label)."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("probability")))
    y = (F.col("label") > 0).cast("double")
    return rows.agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg(F.pow(F.col("probability") - y, F.lit(2))).alias("brier"))


def softmax(rows: DataFrame, group: str, score: str = "score", temperature: float = 1.0, name: str = "share", clip: float | None = None) -> DataFrame:
    """Share of exp(score / temperature) within the group, shifted by its maximum (and clipped below by -clip)."""
    w = Window.partitionBy(group)
    z = F.col(score) / temperature
    shifted = z - F.max(z).over(w)
    e = F.exp(F.greatest(shifted, F.lit(-clip)) if clip else shifted)
    return rows.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def entropy(rows: DataFrame, group: str, score: str = "score", temperature: float = 1.0) -> DataFrame:
    """(group, entropy, normalized): of the softmax; a single row has normalized entropy 0."""
    s = softmax(rows, group, score, temperature).groupBy(group).agg(
        F.sum(F.when(F.col("share") > 0, -F.col("share") * F.log("share")).otherwise(0.0)).alias("entropy"), F.count("*").alias("n")
    )
    return s.select(group, "entropy", F.when(F.col("n") > 1, F.col("entropy") / F.log("n")).otherwise(0.0).alias("normalized"))


def z_scores(rows: DataFrame, group: str, score: str, name: str, least: float = 1e-12) -> DataFrame:
    """Population z-score within the group; 0 where the spread is at most `least`."""
    w = Window.partitionBy(group)
    mean, sd = F.avg(score).over(w), F.stddev_pop(score).over(w)
    return rows.withColumn(name, F.when(sd > least, (F.col(score) - mean) / sd).otherwise(0.0))


def correlation(x: str, y: str) -> Column:
    """Pearson's; 0 where either side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop(x, y), sx * sy)).otherwise(0.0)
