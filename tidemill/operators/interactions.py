"""From an interaction log to splits, dimensions, buckets and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .ordering import global_rank


def support_filter(log: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """One pass: both counts on the same rows, then a recount of users; items aren't filtered again."""
    by_user, by_item = Window.partitionBy("user_id"), Window.partitionBy("item_id")
    counted = log.withColumn("_i", F.count("*").over(by_item)).withColumn("_u", F.count("*").over(by_user))
    first = counted.where((F.col("_u") >= min_user) & (F.col("_i") >= min_item)).drop("_u", "_i")
    return first.withColumn("_u", F.count("*").over(by_user)).where(F.col("_u") >= min_user).drop("_u")


def leave_two_out(log: DataFrame, short_to_train: bool = False) -> DataFrame:
    """history_position, history_length and split: each user's last row is test, the one before valid.

    short_to_train: users of under three rows keep all of them in train.
    """
    by_user = Window.partitionBy("user_id")
    rows = log.withColumn("history_position", F.row_number().over(by_user.orderBy("event_time", "review_id")).cast("long"))
    rows = rows.withColumn("history_length", F.count("*").over(by_user))
    position, length = F.col("history_position"), F.col("history_length")
    split = F.when(position == length, "test").when(position == length - 1, "valid").otherwise("train")
    return rows.withColumn("split", F.when(length < 3, "train").otherwise(split) if short_to_train else split)


def quantile_bucket(count: Column, low: Column, high: Column) -> Column:
    """cold_start for no count; torso if the thresholds meet; else tail, head or torso by them."""
    return F.when(count == 0, "cold_start").when(low >= high, "torso").when(count <= low, "tail").when(count >= high, "head").otherwise("torso")


def entity_dimension(split: DataFrame, key: str, index: str, head_share: float = 0.2) -> DataFrame:
    """One row per entity: dense index, counts, first and last time, and two bucket systems.

    frequency_bucket uses the discrete 20 % and 80 % quantiles of positive train counts;
    paper_bucket calls the top head_share of all entities by train count head, entities without a
    train row included in their number.
    """
    base = split.groupBy(key).agg(
        F.count("*").alias("interactions"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train_interactions"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )
    shared_checkpoint(split.sparkSession)
    base = base.checkpoint()  # a row per entity, read three times below
    positive = base.where("train_interactions > 0")
    cuts = positive.selectExpr(
        "cast(percentile_disc(0.2) within group (order by train_interactions) as bigint) as tail_max",
        "cast(percentile_disc(0.8) within group (order by train_interactions) as bigint) as head_min",
    ).crossJoin(F.broadcast(base.agg(F.count("*").alias("entities"))))  # two one-row sides
    ranked = global_rank(base, [F.desc("train_interactions"), key], "frequency_rank")
    ranked = global_rank(ranked, [key], index, start=0)
    joined = ranked.crossJoin(F.broadcast(cuts))  # one row
    count = F.col("train_interactions")
    paper = F.when(count == 0, "cold_start").when(F.col("frequency_rank") <= F.ceil(F.col("entities") * F.lit(head_share)), "head").otherwise("tail")
    return joined.withColumn("frequency_bucket", quantile_bucket(count, F.col("tail_max"), F.col("head_min"))).withColumn("paper_bucket", paper).drop("entities")


def enrich(split: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Both dimensions' indexes and buckets on each interaction, and whether its item has no train row."""
    u = users.select("user_id", "user_idx", F.col("frequency_bucket").alias("user_bucket"))
    i = items.select("item_id", "item_idx", F.col("frequency_bucket").alias("item_bucket"), (F.col("train_interactions") == 0).alias("item_is_cold_start"))
    return split.join(u, "user_id").join(i, "item_id")


def sequences(split: DataFrame) -> DataFrame:
    """One row per user: train items and their epoch seconds (a half to the even one) in order, and the two held-out targets (null if absent)."""
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    rows = split.withColumn("seconds", F.bround(micros / F.lit(1e6)).cast("long"))
    train = F.when(F.col("split") == "train", F.struct("history_position", "item_id", "seconds"))
    out = rows.groupBy("user_id").agg(
        F.array_sort(F.collect_list(train)).alias("_train"),
        F.max(F.when(F.col("split") == "valid", F.col("item_id"))).alias("valid_item_id"),
        F.max(F.when(F.col("split") == "test", F.col("item_id"))).alias("test_item_id"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train_length"),
    )
    return out.select(
        "user_id",
        F.col("_train.item_id").alias("train_item_ids"),
        F.col("_train.seconds").alias("train_seconds"),
        "valid_item_id",
        "test_item_id",
        "train_length",
    )


def split_violations(split: DataFrame) -> DataFrame:
    """Users whose split breaks an invariant, counted by kind; and repeated (user, position) pairs."""
    n = lambda s: F.count(F.when(F.col("split") == s, 1))
    users = split.groupBy("user_id").agg(
        n("train").alias("train"), n("valid").alias("valid"), n("test").alias("test"), F.count("*").alias("n"), F.max("history_position").alias("last"), F.countDistinct("history_position").alias("positions")
    )
    return users.agg(
        F.count("*").alias("users"),
        F.count(F.when((F.col("valid") != 1) | (F.col("test") != 1), 1)).alias("wrong_holdout"),
        F.count(F.when(F.col("train") != F.col("n") - 2, 1)).alias("wrong_train"),
        F.count(F.when((F.col("last") != F.col("n")) | (F.col("positions") != F.col("n")), 1)).alias("wrong_positions"),
    )


def left_pad(items: Column, length: int) -> Column:
    """The last `length` items, padded with 0 on the left."""
    tail = F.slice(items, F.greatest(F.size(items) - F.lit(length) + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(tail)), tail)
