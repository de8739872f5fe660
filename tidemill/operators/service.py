"""Requests over bounded candidate lists: overlap, features of a gate, hybrid ranking and the service's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, space_tokens
from .ordering import global_rank, rank_within, top_within

#: The ways of a request.
BACKENDS = ("gate", "student", "first")


def overlap(query: Column, text: Column) -> Column:
    return jaccard(space_tokens(query), space_tokens(text))


def hybrid(rows: DataFrame, group: str, item: str, k: int, lexical: str = "lexical", dense: str = "dense") -> DataFrame:
    """The k best by lexical + dense score; a missing score counts 0, ties go to the smaller item."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = rows.withColumn("score", part(lexical) + part(dense))
    return top_within(scored, [group], [F.desc(F.round("score", 9)), F.asc(item)], k)


def gate_vector(rows: DataFrame, group: str, legacy: bool = False) -> DataFrame:
    """One row of features a group of rows (score, rank, place, query_chars, chars, overlap).

    The 13 features describe the best ranked candidate; legacy's 14 the first candidate of the
    list as it was given (place 1), and hold the variance too. A missing second score equals the
    first, a missing third or fifth the second.
    """
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    picked = F.col("place") == 1 if legacy else F.col("rank") == 1
    of_picked = lambda c: F.coalesce(F.max(F.when(picked, F.col(c))), F.lit(0)).cast("double")
    top, second = at(1), F.coalesce(at(2), at(1))
    features = [
        F.max("query_chars").cast("double").alias("query_chars"),
        F.count("*").cast("double").alias("candidates"),
        (top - second).alias("margin"),
        top.alias("top"),
        (top - F.coalesce(at(3), second)).alias("gap3"),
        (top - F.coalesce(at(5), second)).alias("gap5"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("spread"),
        *([F.var_pop("score").alias("variance")] if legacy else []),
        of_picked("overlap").alias("picked_overlap"),
        F.max("overlap").alias("max_overlap"),
        F.avg("overlap").alias("mean_overlap"),
        of_picked("chars").alias("picked_chars"),
        F.avg("chars").alias("mean_chars"),
    ]
    return rows.groupBy(group).agg(*features)


def serve(requests: DataFrame, candidates: DataFrame, close: float, most: int = 100, per_batch: int = 32, k: int = 10) -> DataFrame:
    """(g, batch, status, backend, fallback, item, rank): answers of requests (g, query, backend, failing).

    candidates (g, item, student, first) hold the scores of both rankers. A request needs a query
    and 1 to `most` candidates (else "invalid") and a known backend (else "unknown backend");
    such requests have one row without item. "gate" takes the dear ranker where the student's two
    best are closer than `close`; where it fails, the student answers. Batches hold up to
    per_batch requests in order of g.
    """
    c = rank_within(candidates, ["g"], [F.desc("student"), "item"], "by_student")
    c = rank_within(c, ["g"], [F.desc("first"), "item"], "by_first")
    at = lambda r: F.max(F.when(F.col("by_student") == r, F.col("student")))
    shape = c.groupBy("g").agg(F.count("*").alias("n"), (at(1) - F.coalesce(at(2), at(1))).alias("margin"))
    r = global_rank(requests, ["g"], "at").join(shape, "g", "left")
    sound = F.coalesce((F.length("query") > 0) & F.col("n").between(1, most), F.lit(False))
    known = F.coalesce(F.col("backend").isin(*BACKENDS), F.lit(False))
    wanted = F.when(F.col("backend") != "gate", F.col("backend")).when(F.col("margin") < close, "first").otherwise("student")
    r = r.select(
        "g",
        F.floor((F.col("at") - 1) / per_batch).alias("batch"),
        F.when(~sound, "invalid").when(~known, "unknown backend").otherwise("ok").alias("status"),
        wanted.alias("wanted"),
        F.coalesce(F.col("failing"), F.lit(False)).alias("failing"),
    )
    r = r.withColumn("fallback", (F.col("status") == "ok") & (F.col("wanted") == "first") & F.col("failing"))
    r = r.withColumn("backend", F.when(F.col("status") == "ok", F.when(F.col("fallback"), "student").otherwise(F.col("wanted"))))
    rank = F.when(F.col("backend") == "student", F.col("by_student")).otherwise(F.col("by_first"))
    head = ["g", "batch", "status", "backend", "fallback"]
    answered = r.where("status = 'ok'").join(c, "g").withColumn("rank", rank).where(F.col("rank") <= k).select(*head, "item", "rank")
    return answered.unionByName(r.where("status <> 'ok'").select(*head), allowMissingColumns=True)
