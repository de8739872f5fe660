"""Pairwise preferences: consensus, Borda, cycles, sliding passes, pair losses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit
from .ordering import rank_within


def all_pairs(rows: DataFrame, group: str, item: str, position: str, both_ways: bool = False) -> DataFrame:
    """Pairs of a group's candidates (bounded lists): first before second, or both orders."""
    a = rows.select(group, F.col(item).alias("first"), F.col(position).alias("_p"))
    b = rows.select(group, F.col(item).alias("second"), F.col(position).alias("_q"))
    return a.join(b, group).where(F.col("_p") != F.col("_q") if both_ways else F.col("_p") < F.col("_q")).drop("_p", "_q")


def consensus(responses: DataFrame, group: str, ties_agree: bool = True) -> DataFrame:
    """(group, left, right, winner, swap_agree) of responses (group, first, second, choice) in both orders.

    winner is null unless both orders pick the same item. ties_agree: whether two ties count as agreement.
    """
    pick = F.when(F.col("choice") == "first", F.col("first")).when(F.col("choice") == "second", F.col("second"))
    named = responses.withColumn("pick", pick)
    ahead = named.where("first < second").select(group, F.col("first").alias("left"), F.col("second").alias("right"), F.col("pick").alias("x"))
    back = named.where("first > second").select(group, F.col("second").alias("left"), F.col("first").alias("right"), F.col("pick").alias("y"))
    both = ahead.join(back, [group, "left", "right"])
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    agree = (same | (F.col("x").isNull() & F.col("y").isNull())) if ties_agree else same
    return both.select(group, "left", "right", F.when(same, F.col("x")).alias("winner"), agree.alias("swap_agree"))


def borda(pairs: DataFrame, group: str) -> DataFrame:
    """(group, item, points): 1 for a win, a half for a tie."""
    points = lambda side: F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col(side), 1.0).otherwise(0.0)
    left = pairs.select(group, F.col("left").alias("item"), points("left").alias("p"))
    right = pairs.select(group, F.col("right").alias("item"), points("right").alias("p"))
    return left.unionByName(right).groupBy(group, "item").agg(F.sum("p").alias("points"))


def cycles(pairs: DataFrame, group: str) -> DataFrame:
    """(group, triples, cycles): triples all of whose pairs have a winner, and those that go round."""
    won = pairs.where("winner is not null").select(group, "left", "right", (F.col("winner") == F.col("left")).alias("w"))
    ab = won.select(group, F.col("left").alias("a"), F.col("right").alias("b"), F.col("w").alias("ab"))
    bc = won.select(group, F.col("left").alias("b"), F.col("right").alias("c"), F.col("w").alias("bc"))
    ac = won.select(group, F.col("left").alias("a"), F.col("right").alias("c"), F.col("w").alias("ac"))
    t = ab.join(bc, [group, "b"]).join(ac, [group, "a", "c"])
    round_ = (F.col("ab") == F.col("bc")) & (F.col("ab") != F.col("ac"))
    return t.groupBy(group).agg(F.count("*").alias("triples"), F.count(F.when(round_, 1)).alias("cycles"))


def diagnostics(pairs: DataFrame, relevance: DataFrame, group: str) -> DataFrame:
    """(group, pairs, agree, ties, accuracy, credit) against relevance (group, item, relevance).

    accuracy counts decided pairs of unequal relevance; credit gives undecided ones a half.
    """
    left = relevance.select(group, F.col("item").alias("left"), F.col("relevance").alias("l"))
    right = relevance.select(group, F.col("item").alias("right"), F.col("relevance").alias("r"))
    j = pairs.join(left, [group, "left"]).join(right, [group, "right"])
    better = F.when(F.col("l") > F.col("r"), F.col("left")).when(F.col("l") < F.col("r"), F.col("right"))
    j = j.withColumn("better", better)
    known, decided = F.col("better").isNotNull(), F.col("winner").isNotNull()
    right_ = F.col("winner") == F.col("better")
    return j.groupBy(group).agg(
        F.count("*").alias("pairs"),
        F.avg(F.col("swap_agree").cast("double")).alias("agree"),
        F.avg((~decided).cast("double")).alias("ties"),
        F.avg(F.when(known & decided, right_.cast("double"))).alias("accuracy"),
        F.avg(F.when(known, F.when(decided, right_.cast("double")).otherwise(0.5))).alias("credit"),
    )


def sliding(candidates: DataFrame, pairs: DataFrame, group: str, passes: int) -> DataFrame:
    """(group, item, rank) after backward passes that swap neighbours where the lower one wins.

    candidates (group, item, position); pairs (group, left, right, winner). Each pass depends on
    the one before, so a group's bounded list is one task's work.
    """
    kind = dict(candidates.dtypes)[group]
    of_item = dict(candidates.dtypes)["item"]

    def run(key, c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        won = {(a, b): w for a, b, w in zip(p["left"], p["right"], p["winner"])}
        items = c.sort_values("position")["item"].tolist()
        for _ in range(passes):
            for i in range(len(items) - 1, 0, -1):
                a, b = items[i - 1], items[i]
                if won.get((min(a, b), max(a, b))) == b:
                    items[i - 1], items[i] = b, a
        return pd.DataFrame({group: [key[0]] * len(items), "item": items, "rank": range(1, len(items) + 1)})

    return candidates.groupBy(group).cogroup(pairs.groupBy(group)).applyInPandas(run, f"`{group}` {kind}, item {of_item}, rank long")


def window_plan(n, size: int = 20, step: int = 10):
    """Bottom-up windows of n places as an array of (start, end): the last window first."""
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")), lambda i: F.greatest(n - size - i * step, F.lit(0)).cast("long"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n.cast("long")).alias("end")))


def letters(place):
    """A..Z, then AA, AB...: a name for each 1-based place (up to 702)."""
    p = (place - 1).cast("int")
    low = F.char(F.lit(65) + p % 26)
    return F.when(place <= 26, low).otherwise(F.concat(F.char(F.lit(64) + F.floor(p / 26).cast("int")), low))


def prompt_entries(candidates: DataFrame, group: str, item: str, place: str, seed: int = 42) -> DataFrame:
    """(group, variant, item, position, identifier): four ways to show a list (group, item, place from 1).

    baseline; reverse; random_permutation, items in hash order; identifier_remap, the items in
    place under permuted names.
    """
    digest = lambda kind, x: F.sha2(F.concat_ws(":", F.lit(kind), F.lit(str(seed)), F.col(group).cast("string"), F.col(x).cast("string")), 256)
    c = rank_within(candidates.select(group, item, place), [group], [digest("order", item), item], "_shuffled")
    c = rank_within(c, [group], [digest("name", place), place], "_named")
    n = F.count("*").over(Window.partitionBy(group))
    made = {"baseline": (F.col(place), F.col(place)), "reverse": (F.col("_n") + 1 - F.col(place),) * 2, "random_permutation": (F.col("_shuffled"),) * 2, "identifier_remap": (F.col(place), F.col("_named"))}
    entries = [F.struct(F.lit(v).alias("variant"), p.cast("long").alias("position"), letters(i).alias("identifier")) for v, (p, i) in made.items()]
    return c.withColumn("_n", n).select(group, item, F.explode(F.array(*entries)).alias("e")).select(group, item, "e.*")


def compare(pairs: DataFrame, group: str, bias: float, noise: float, margin: float, seed: int = 0) -> DataFrame:
    """difference and choice of a deterministic comparator over ordered pairs (group, first, second, a, b).

    The difference a - b takes a bias for the first place and a jitter of up to `noise` from a
    hash of the pair; within the margin it is a tie.
    """
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (group, "first", "second")])
    d = F.col("a") - F.col("b") + F.lit(bias) + F.lit(noise) * (2 * unit(key) - 1)
    choice = F.when(F.abs("difference") <= margin, "tie").when(F.col("difference") > 0, "first").otherwise("second")
    return pairs.withColumn("difference", d).withColumn("choice", choice)


def costs(calls: DataFrame, group: str) -> DataFrame:
    """(group, prompts, input_tokens, output_tokens, margin) of calls (input_tokens, output_tokens, score_first, score_second).

    margin: mean absolute difference of the likelihoods where both are known.
    """
    gap = F.abs(F.col("score_first") - F.col("score_second"))
    return calls.groupBy(group).agg(F.count("*").alias("prompts"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg(gap).alias("margin"))


def ranknet(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, pairs, loss): mean softplus of score differences over pairs of unequal labels in a bounded list."""
    a = rows.select(group, F.col("score").alias("s"), F.col("label").alias("l"))
    b = rows.select(group, F.col("score").alias("t"), F.col("label").alias("m"))
    d = F.col("t") - F.col("s")
    softplus = F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))
    return a.join(b, group).where("l > m").groupBy(group).agg(F.count("*").alias("pairs"), F.avg(softplus).alias("loss"))


def bpr(positives: DataFrame, negatives: DataFrame, group: str) -> DataFrame:
    """(group, loss): mean softplus(negative - positive) over positive-negative pairs of bounded lists."""
    d = F.col("neg") - F.col("pos")
    j = positives.select(group, F.col("score").alias("pos")).join(negatives.select(group, F.col("score").alias("neg")), group)
    return j.groupBy(group).agg(F.avg(F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))).alias("loss"))
