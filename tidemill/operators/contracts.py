"""Checks as tables of violation counts, and joins whose cardinality is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column names that would leak judgements into a model's input.
FORBIDDEN = ("label", "labels", "relevance", "graded_relevance", "binary_relevance", "trec_relevance", "qrels", "judged", "score")


class ContractError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """join() that raises ContractError where a side that must be unique isn't."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(validate)
    for side, name in ((right, "right"), *(((left, "left"),) if validate == "one_to_one" else ())):
        if not duplicate_keys(side, keys).isEmpty():
            raise ContractError(f"{name} repeats a key of {keys}")
    return left.join(right, keys, how)


def leaking_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in FORBIDDEN]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if df.columns != columns:
        raise ContractError(f"expected columns {columns}, got {df.columns}")
    return df


def prediction_violations(rows: DataFrame, group: str, item: str, size: int | None = None) -> DataFrame:
    """One row of counts: repeated pairs, non-finite scores, probabilities out of range, broken ranks, wrong group sizes."""
    bad = lambda c: F.isnan(c) | c.isNull() | (F.abs(c) == float("inf"))
    groups = rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.countDistinct(item).alias("items"),
        F.countDistinct("rank").alias("ranks"),
        F.min("rank").alias("low"),
        F.max("rank").alias("high"),
        F.count(F.when(bad(F.col("score")), 1)).alias("bad_score"),
        F.count(F.when(bad(F.col("probability")) | (F.col("probability") < 0) | (F.col("probability") > 1), 1)).alias("bad_probability"),
    )
    broken = (F.col("ranks") != F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))
    return groups.agg(
        F.count("*").alias("groups"),
        F.sum(F.col("n") - F.col("items")).alias("repeated_items"),
        F.sum("bad_score").alias("bad_scores"),
        F.sum("bad_probability").alias("bad_probabilities"),
        F.count(F.when(broken, 1)).alias("broken_ranks"),
        F.count(F.when(F.col("n") != size, 1) if size else F.lit(None)).alias("wrong_sizes"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): independent of row order and partitioning."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): the sum of the first 32 bits of each row's MD5, columns as text joined by |; other engines can make it too."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")).alias("digest"))


def merge_shards(shards: list[DataFrame], keys: list[str], group: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of the shards, and one row (rows, repeated, missing, extra, complete) that proves their coverage.

    expected (group) holds each group once; complete: no key repeats, no group is missing or extra.
    """
    rows = shards[0]
    for other in shards[1:]:
        rows = rows.unionByName(other)
    keyed = rows.groupBy(group, *[k for k in keys if k != group]).agg(F.count("*").alias("_n"))
    groups = keyed.groupBy(group).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_more")).withColumn("_got", F.lit(True))
    j = groups.join(expected.select(group).withColumn("_due", F.lit(True)), group, "full")
    proof = j.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_more"), F.lit(0)).alias("repeated"),
        F.count(F.when(F.col("_got").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_due").isNull(), 1)).alias("extra"),
    )
    return rows, proof.withColumn("complete", (F.col("repeated") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0))


def unlocked(guards: DataFrame) -> DataFrame:
    """may_run: an evaluation may run once, while its guard is locked and nothing has been counted."""
    may = (F.col("status") == "locked_unaccessed") & (F.col("evaluation_count") == 0)
    return guards.withColumn("may_run", F.coalesce(may, F.lit(False)))


def source_faults(lines: DataFrame, fields: int, id_field: int = 0, sep: str = "\t") -> DataFrame:
    """(lines, malformed, repeated_ids, blank_text) of text lines (value): field counts, ids and texts that aren't sound."""
    parts = lines.where("value <> ''").select(F.split("value", sep, -1).alias("p"))
    row = parts.select(F.try_element_at("p", F.lit(id_field + 1)).alias("id"), (F.size("p") != fields).alias("bad"), (F.trim(F.element_at("p", -1)) == "").alias("blank"))
    ids = row.groupBy("id").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count(F.when(F.col("blank"), 1)).alias("blank"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ids.agg(total("n").alias("lines"), total("bad").alias("malformed"), total(F.col("n") - 1).alias("repeated_ids"), total("blank").alias("blank_text"))
