"""Ranking metrics of rows (group, item, score, label). Every NDCG names its gain and its ideal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import rank_within


def gain(label: Column, kind: str) -> Column:
    """"linear": the grade; "exponential": 2^grade - 1."""
    if kind not in ("linear", "exponential"):
        raise ValueError(kind)
    return label if kind == "linear" else F.pow(F.lit(2.0), label) - 1


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ranked(rows: DataFrame, group: str, item: str, score: str = "score") -> DataFrame:
    return rank_within(rows, [group], [F.desc(score), F.asc(item)])


def per_group(rows: DataFrame, group: str, item: str, k: int, kind: str = "exponential", relevant: float = 0.0) -> DataFrame:
    """(group, n, relevant, mrr, recall, hit, ndcg): NDCG's ideal is the group's own rows; 0 without relevant rows."""
    both = ranked(rows, group, item).withColumn("ideal", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("label"), item)))
    rel, top = F.col("label") > relevant, F.col("rank") <= k
    g = gain(F.col("label"), kind)
    out = both.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count(F.when(rel, 1)).alias("relevant"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.count(F.when(rel & top, 1)).alias("hits"),
        F.sum(F.when(top, g * discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, g * discount(F.col("ideal"))).otherwise(0.0)).alias("idcg"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(
        group,
        "n",
        "relevant",
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        ratio("hits", "relevant").alias("recall"),
        (F.col("hits") > 0).cast("double").alias("hit"),
        ratio("dcg", "idcg").alias("ndcg"),
    )


def ndcg_against_judgements(rows: DataFrame, judged: DataFrame, group: str, item: str, k: int, kind: str = "linear") -> DataFrame:
    """(group, ndcg): unjudged rows count 0; the ideal comes from all judgements (group, item, grade), retrieved or not."""
    graded = ranked(rows.select(group, item, "score"), group, item).where(F.col("rank") <= k).join(judged, [group, item], "left")
    dcg = graded.groupBy(group).agg(F.sum(gain(F.coalesce("grade", F.lit(0)).cast("double"), kind) * discount(F.col("rank"))).alias("dcg"))
    ideal = rank_within(judged.where("grade > 0"), [group], [F.desc("grade"), F.asc(item)]).where(F.col("rank") <= k)
    idcg = ideal.groupBy(group).agg(F.sum(gain(F.col("grade").cast("double"), kind) * discount(F.col("rank"))).alias("idcg"))
    joined = dcg.join(idcg, group, "left")
    return joined.select(group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, auc): Mann-Whitney with average ranks of ties; null with one class only.

    Counts by score come first, so ranks are running sums over distinct scores.
    """
    hits = rows.groupBy(*keys, "score").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("p"), F.count("*").alias("c"))
    before = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    at = hits.withColumn("rank", F.coalesce(F.sum("c").over(before), F.lit(0)) + (F.col("c") + 1) / 2)
    out = at.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("p").alias("pos"), F.sum(F.col("p") * F.col("rank")).alias("s"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return out.select(*keys, "n", F.when((pos > 0) & (neg > 0), (F.col("s") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def group_auc(rows: DataFrame, group: str) -> DataFrame:
    """(gauc, groups): AUC of groups with both classes, weighted by their sizes."""
    a = auc(rows, [group]).where("auc is not null")
    return a.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("gauc"), F.count("*").alias("groups"))


def pair_agreement(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """(group, pairs, agreement, tau): two rankings (group, item, rank) over their common items.

    Lists are bounded by their cut-off; the pairs of one list meet in one row's arrays.
    """
    both = a.select(group, item, F.col("rank").alias("x")).join(b.select(group, item, F.col("rank").alias("y")), [group, item])
    lists = both.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("r"))
    same = F.aggregate(
        "r",
        F.lit(0).cast("long"),
        lambda s, p: s + F.size(F.filter("r", lambda o: (o["x"] > p["x"]) & (o["y"] > p["y"]))),
    )
    n = F.size("r").cast("long")
    out = lists.select(group, (n * (n - 1) / 2).cast("long").alias("pairs"), same.alias("same"))
    share = F.when(F.col("pairs") > 0, F.col("same") / F.col("pairs"))
    return out.select(group, "pairs", share.alias("agreement"), (2 * share - 1).alias("tau"))


def position_stability(a: DataFrame, b: DataFrame, group: str, item: str, within: int = 2) -> DataFrame:
    """(group, stable, order_changed, max_shift) of common items in two rankings."""
    both = a.select(group, item, F.col("rank").alias("x")).join(b.select(group, item, F.col("rank").alias("y")), [group, item])
    shift = F.abs(F.col("x") - F.col("y"))
    return both.groupBy(group).agg(F.avg((shift <= within).cast("double")).alias("stable"), (F.max(shift) > 0).alias("order_changed"), F.max(shift).cast("long").alias("max_shift"))
