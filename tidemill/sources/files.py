"""File sources and sinks."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, date timestamp_ntz"
BUSINESS = (
    "business_id string, name string, city string, state string, postal_code string, latitude double, longitude double, stars double, "
    "review_count bigint, is_open int, categories string, attributes string, hours string"
)
TEACHER = "request_id string, year int, query_id string, query string, candidates array<struct<passage_id: string, bm25_rank: int, passage: string>>"


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON reviews under an explicit schema; rows without keys or date are dropped."""
    rows = spark.read.schema(REVIEW).json(path)
    rows = rows.select("review_id", "user_id", F.col("business_id").alias("item_id"), "stars", "useful", "funny", "cool", F.col("date").alias("event_time"))
    return rows.where("review_id is not null and user_id is not null and item_id is not null and event_time is not null")


def businesses(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON items; nested objects stay JSON text."""
    rows = spark.read.schema(BUSINESS).json(path)
    return rows.withColumnsRenamed({"business_id": "item_id", "attributes": "attributes_json", "hours": "hours_json"}).where("item_id is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): text lines with their place in the file, from 0."""
    schema = T.StructType([T.StructField("line", T.LongType()), T.StructField("value", T.StringType())])
    return spark.createDataFrame(spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])), schema)


def ordered_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless "user item" lines whose order is the order in time."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return rows.select((F.col("line") + 1).alias("source_order"), parts[0].cast("long").alias("user_id"), parts[1].cast("long").alias("item_id"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, passage_id, grade, valid) of four-field lines; valid: four fields and a grade of 0 to 3."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    grade = F.try_to_number(F.try_element_at(parts, F.lit(4)), F.lit("9")).cast("int")
    return rows.select(parts[0].alias("query_id"), F.try_element_at(parts, F.lit(3)).alias("passage_id"), grade.alias("grade"), F.coalesce((F.size(parts) == 4) & grade.between(0, 3), F.lit(False)).alias("valid"))


def id_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of tab-separated lines, white space squeezed; gz files are read as they are."""
    from ..functions.text import squeeze

    return spark.read.csv(path, sep="\t", schema="id string, text string", quote="").select("id", squeeze(F.col("text")).alias("text"))


def first_ranked(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(query_id, passage_id, query, passage, rank) of TSV lines; rank is the order of appearance within the query."""
    from .. operators.ordering import top_within

    parts = F.split("value", "\t")
    rows = numbered_lines(spark, path).select("line", parts[0].alias("query_id"), parts[1].alias("passage_id"), parts[2].alias("query"), parts[3].alias("passage"))
    return top_within(rows, ["query_id"], ["line"], k).drop("line")


def teacher_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per candidate of nested request lines."""
    rows = spark.read.schema(TEACHER).json(path)
    return rows.select("request_id", "year", "query_id", "query", F.posexplode("candidates").alias("position", "c")).select("request_id", "year", "query_id", "query", "position", "c.*")


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One file, shards or a glob; only the named columns are read."""
    rows = spark.read.parquet(*paths)
    return rows.select(*columns) if columns else rows


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, schema=schema)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): title and text of JSON lines joined by a space."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("id"), F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of 2-d NPY files, read without unpickling; one row per matrix row."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"row": range(len(a)), "values": [r.astype(np.float64).tolist() for r in a]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row long, values array<double>")


def pending(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that the append-only cache doesn't answer yet."""
    return requests.join(cache.select(*keys), keys, "left_anti")


def write_ordered(df: DataFrame, path: str, order: list) -> None:
    """Globally ordered Parquet, ZSTD."""
    df.orderBy(*order).write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_sharded(df: DataFrame, path: str, key: str, shards: int, order: list) -> None:
    """One folder per hash shard of the key, ordered within."""
    marked = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    marked.repartition(shards, "shard").sortWithinPartitions("shard", *order).write.partitionBy("shard").option("compression", "zstd").mode("overwrite").parquet(path)


def write_requests(df: DataFrame, path: str) -> None:
    """Nested NDJSON by request; refuses columns that leak judgements."""
    from ..operators.contracts import ContractError, leaking_columns

    if bad := leaking_columns(df):
        raise ContractError(f"columns would leak: {bad}")
    grouped = df.groupBy("request_id", "query_id", "query").agg(F.array_sort(F.collect_list(F.struct("bm25_rank", "passage_id", "passage"))).alias("candidates"))
    grouped.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A metric table as CSV with header, and as JSON lines."""
    df.write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.write.mode("overwrite").json(f"{path}/json")


def manifest(tables: dict[str, DataFrame], config: dict) -> dict:
    """Row counts and order-free fingerprints of named tables, and a fingerprint of all."""
    import hashlib

    from ..operators.contracts import fingerprint

    parts = {}
    for name, df in sorted(tables.items()):
        r = fingerprint(df).first()
        parts[name] = {"rows": r["rows"], "digest": r["digest"], "columns": df.dtypes}
    text = json.dumps({"tables": parts, "config": config}, sort_keys=True, default=str)
    return {"tables": parts, "config": config, "fingerprint": hashlib.sha256(text.encode()).hexdigest()}




def exposition(counters: DataFrame, prefix: str) -> DataFrame:
    """(metric, line): one text line "<prefix>_<name> <value>" a column of a one-row table, as scrapers of counters read it.

    Whole numbers are written as such, others with six decimals.
    """
    kinds = dict(counters.dtypes)
    value = lambda c: F.format_string("%.6f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    lines = [F.struct(F.lit(c).alias("metric"), F.concat(F.lit(f"{prefix}_{c} "), F.coalesce(value(c), F.lit("NaN"))).alias("line")) for c in counters.columns]
    return counters.select(F.explode(F.array(*lines)).alias("l")).select("l.*")
