"""Deterministic made-up candidate lists: values come from hashes of ids, so any partition makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit


def candidate_lists(spark: SparkSession, queries: int, size: int, seed: int = 0) -> DataFrame:
    """(query_id, item_id, student, teacher, relevance): `size` candidates for each of `queries` queries.

    student is uniform on [0, 1); teacher mixes it with draws of its own; relevance is 0 to 3 by
    quarters of the teacher.
    """
    ids = spark.range(queries * size)
    q, i = F.floor(F.col("id") / size).cast("long"), (F.col("id") % size).cast("long")
    draw = lambda kind: unit(F.concat_ws(":", F.lit(kind), F.lit(str(seed)), F.col("query_id").cast("string"), F.col("item_id").cast("string")))
    rows = ids.select(q.alias("query_id"), i.alias("item_id")).withColumn("student", draw("student"))
    rows = rows.withColumn("teacher", 0.6 * F.col("student") + 0.4 * draw("teacher"))
    return rows.withColumn("relevance", F.floor(F.col("teacher") * 4).cast("long"))
