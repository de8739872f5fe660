"""Queries on requests with candidate lists, gates' feature vectors and the service's answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators import ordering, retrieval, service
from ..session import table
from .search import _BM, _LEX, _r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def requests(spark, sf_dir) -> DataFrame:
    """(g, item, query, score, rank, place, overlap, query_chars, chars, dense): each query's 20 documents that share most terms.

    place is the order of ids, as candidates may come unranked.
    """
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    lists = ordering.rank_within(retrieval.contained_terms(b, d, 20), ["query_id"], ["doc_id"], "place")
    j = lists.join(b.withColumnRenamed("text", "query"), "query_id").join(d, "doc_id")
    j = j.select(
        F.col("query_id").alias("g"), F.col("doc_id").alias("item"), "query", "score", "rank", "place",
        service.overlap(F.col("query"), F.col("text")).alias("overlap"), F.length("query").alias("query_chars"), F.length("text").alias("chars"),
    )
    j = j.join(e.select(F.col("vec_id").alias("g"), F.col("embedding").alias("v")), "g", "left")
    j = j.join(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("w")), "item", "left")
    return j.withColumn("dense", dot(F.col("v"), F.col("w"))).drop("v", "w")


_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda t: t <> ''))"
_RQ = f"""{_BM}{_LEX}, c AS (SELECT l.query_id AS g, l.doc_id AS item, l.score, l.rank, b.text AS query, d.text,
  {_SET.format('b.text')} AS qt, {_SET.format('d.text')} AS dt, row_number() OVER (PARTITION BY l.query_id ORDER BY l.doc_id) AS place
  FROM lex l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.doc_id),
rq AS (SELECT g, item, query, score, rank, place, len(list_intersect(qt, dt)) / greatest(len(list_distinct(list_concat(qt, dt))), 1) AS overlap,
  length(query) AS query_chars, length(text) AS chars,
  list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)) AS dense
  FROM c LEFT JOIN embeddings x ON x.vec_id = g LEFT JOIN embeddings y ON y.vec_id = item)"""


@query(
    f"""WITH {_RQ}, s AS (SELECT g, item, coalesce(overlap, 0) + coalesce(dense, 0) AS score FROM rq)
SELECT g, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, item) AS rank FROM s) WHERE rank <= 10"""
)
def hybrid_retrieval(spark, sf_dir):
    """Lexical overlap plus inner product; documents without a vector have the lexical part only."""
    rows = requests(spark, sf_dir).select("g", "item", F.col("overlap").alias("lexical"), "dense")
    return _r(service.hybrid(rows, "g", "item", 10).select("g", "item", "score", "rank"), "score", digits=6)


_AT = "max(score) FILTER (WHERE rank = {})"
_TOP, _SECOND = _AT.format(1), f"coalesce({_AT.format(2)}, {_AT.format(1)})"


def _vector_sql(picked: str, legacy: bool) -> str:
    parts = {
        "query_chars": "max(query_chars)", "candidates": "count(*)", "margin": f"{_TOP} - {_SECOND}", "top": _TOP,
        "gap3": f"{_TOP} - coalesce({_AT.format(3)}, {_SECOND})", "gap5": f"{_TOP} - coalesce({_AT.format(5)}, {_SECOND})",
        "mean": "avg(score)", "spread": "stddev_pop(score)", **({"variance": "var_pop(score)"} if legacy else {}),
        "picked_overlap": f"max(overlap) FILTER (WHERE {picked})", "max_overlap": "max(overlap)", "mean_overlap": "avg(overlap)",
        "picked_chars": f"max(chars) FILTER (WHERE {picked})", "mean_chars": "avg(chars)",
    }
    return f"WITH {_RQ} SELECT g, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for n, x in parts.items()) + " FROM rq GROUP BY g"


def _vector(spark, sf_dir, legacy: bool) -> DataFrame:
    v = service.gate_vector(requests(spark, sf_dir), "g", legacy)
    return _r(v, *[c for c in v.columns if c != "g"], digits=6)


@query(_vector_sql("rank = 1", False))
def gate_vectors(spark, sf_dir):
    """The 13 features of a gate that runs after the student."""
    return _vector(spark, sf_dir, False)


@query(_vector_sql("place = 1", True))
def gate_vectors_legacy(spark, sf_dir):
    """The 14 features of the older gate, which looks at the first candidate given."""
    return _vector(spark, sf_dir, True)


@query(
    f"""WITH {_RQ}, cd AS (SELECT g, item, round(overlap, 9) AS student, round(overlap + coalesce(dense, 0), 9) AS dear FROM rq),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY student DESC, item) AS rs, row_number() OVER (PARTITION BY g ORDER BY dear DESC, item) AS rf FROM cd),
h AS (SELECT g, count(*) AS n, max(student) FILTER (WHERE rs = 1) - coalesce(max(student) FILTER (WHERE rs = 2), max(student)) AS margin FROM k GROUP BY g),
r AS (SELECT item_id AS g, CASE WHEN item_id % 11 = 3 THEN '' ELSE text END AS query, CASE item_id % 7 WHEN 0 THEN 'student' WHEN 1 THEN 'first' WHEN 2 THEN 'other' ELSE 'gate' END AS asked,
  item_id % 5 = 4 AS failing, (row_number() OVER (ORDER BY item_id) - 1) // 32 AS batch FROM benchmark),
s AS (SELECT r.*, CASE WHEN NOT coalesce(length(query) > 0 AND n BETWEEN 1 AND 100, false) THEN 'invalid' WHEN asked = 'other' THEN 'unknown backend' ELSE 'ok' END AS status,
  CASE WHEN asked <> 'gate' THEN asked WHEN margin < 0.002 THEN 'first' ELSE 'student' END AS wanted FROM r LEFT JOIN h USING (g)),
u AS (SELECT *, status = 'ok' AND wanted = 'first' AND failing AS fallback, CASE WHEN status = 'ok' THEN CASE WHEN wanted = 'first' AND NOT failing THEN 'first' ELSE 'student' END END AS backend FROM s)
SELECT g, batch::BIGINT AS batch, status, backend, fallback, item, CASE backend WHEN 'student' THEN rs ELSE rf END AS rank FROM u JOIN k USING (g) WHERE status = 'ok' AND CASE backend WHEN 'student' THEN rs ELSE rf END <= 10
UNION ALL SELECT g, batch::BIGINT, status, backend, fallback, NULL, NULL FROM u WHERE status <> 'ok'"""
)
def search_service(spark, sf_dir):
    """Requests of all kinds: gated, explicit, unknown and empty ones, and a ranker that fails for some."""
    score = F.round(F.col("overlap"), 9)
    both = F.round(F.col("overlap") + F.coalesce("dense", F.lit(0.0)), 9)
    c = requests(spark, sf_dir).select("g", "item", score.alias("student"), both.alias("first"))
    g = F.col("item_id")
    asked = F.when(g % 7 == 0, "student").when(g % 7 == 1, "first").when(g % 7 == 2, "other").otherwise("gate")
    r = table(spark, sf_dir, "benchmark").select(g.alias("g"), F.when(g % 11 == 3, "").otherwise(F.col("text")).alias("query"), asked.alias("backend"), (g % 5 == 4).alias("failing"))
    return service.serve(r, c, 0.002)
