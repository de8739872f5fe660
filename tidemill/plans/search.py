"""Queries on text functions, retrieval, fusion, routing and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import calibration, graph, ordering, pairwise, retrieval, routing
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(df: DataFrame, *names: str, digits: int = 7) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


@query(
    r"""SELECT conv_id, turn, lower(text) AS low, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, length(text)::BIGINT AS n_chars,
len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> ''))::BIGINT AS n_words, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens, text[1:20] || '...' || role AS label FROM conversations"""
)
def text_shapes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lower(t).alias("low"), text.squeeze(t).alias("squeezed"), F.length(t).cast("long").alias("n_chars"), text.word_count(t).alias("n_words"),
        F.size(text.alnum_tokens(t)).cast("long").alias("n_tokens"), F.concat(F.substring(t, 1, 20), F.lit("..."), "role").alias("label"),
    )


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS bare, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)
SELECT doc_id, round(length(regexp_replace(bare, '[^A-Za-z]', '', 'g')) / greatest(length(bare), 1), 7) AS latin,
round(len(list_filter(w, lambda x: x IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with'))) / greatest(len(w), 1), 7) AS stop FROM t"""
)
def language_gate(spark, sf_dir):
    return _r(table(spark, sf_dir, "documents").select("doc_id", text.latin_ratio(F.col("text")).alias("latin"), text.stop_ratio(F.col("text")).alias("stop")), "latin", "stop")


@query(
    r"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS a FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS b FROM conversations WHERE role = 'user')
SELECT item_id, conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 7) AS jaccard, round(len(list_intersect(a, b)) / greatest(len(a), 1), 7) AS containment,
array_to_string(list_sort(list_intersect(a, b))[1:5], ' ') AS evidence FROM q, c WHERE item_id % 50 = 0 AND len(list_intersect(a, b)) > 0"""
)
def lexical_overlap(spark, sf_dir):
    """Rows whose id 50 divides are the stated query set, against all user turns that share a token."""
    q = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0 and text is not null").select("item_id", text.space_tokens(F.col("text")).alias("a"))
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.space_tokens(F.col("text")).alias("b"))
    a, b = F.col("a"), F.col("b")
    met = retrieval.sharing(q.select("item_id", "a"), "a", c.select("conv_id", "turn", "b"), "b", ["item_id", "conv_id", "turn"])
    evidence = F.array_join(F.slice(F.array_sort(F.array_intersect(a, b)), 1, 5), " ")
    return _r(met.join(q, "item_id").join(c, ["conv_id", "turn"]).select("item_id", "conv_id", "turn", text.jaccard(a, b).alias("jaccard"), text.containment(a, b).alias("containment"), evidence.alias("evidence")), "jaccard", "containment")


@query(
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'best|recommend|推荐|适合') THEN 'recommendation' WHEN regexp_matches(lower(text), 'compare|vs|比较|区别') THEN 'comparison' ELSE 'informational-search' END AS intent,
array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: lower(w) IN ('near', 'cheap', 'best', 'budget', '附近', '便宜')), ' ') AS limits,
array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:8], ' ') AS head,
'Query: ' || array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:8], ' ') || chr(10) || '[' || chr((65 + turn % 20)::INT) || ']' AS prompt FROM conversations"""
)
def query_understanding(spark, sf_dir):
    head = text.first_words(F.col("text"), 8)
    prompt = F.concat(F.lit("Query: "), head, F.lit("\n["), F.char(65 + F.col("turn") % 20), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"), F.array_join(text.constraints(F.col("text")), " ").alias("limits"), head.alias("head"), prompt.alias("prompt"))


@query(
    r"""WITH g AS (SELECT user_id, '[' || array_to_string(list(chr((65 + event_id % 3)::INT) ORDER BY event_id), '] > [') || ']' AS answer, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id)
SELECT user_id, answer, regexp_replace(answer, '\[([A-z]+)\]', '(\1)', 'g') AS cleaned, list_sort(regexp_extract_all(answer, '\[([A-Z])\]', 1)) = ['A', 'B', 'C'][1:n] AS valid FROM g"""
)
def ranking_parser(spark, sf_dir):
    e = ordering.top_within(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 3, "k")
    letters = F.transform(F.array_sort(F.collect_list("event_id")), lambda i: F.char(65 + i % 3))
    g = e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(letters, "] > ["), F.lit("]")).alias("answer"), F.count("*").cast("int").alias("n"))
    a = F.col("answer")
    return g.select("user_id", "answer", text.clean_identifiers(a).alias("cleaned"), text.is_permutation(text.identifiers(a), F.col("n")).alias("valid"))


_BM = r"""q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
p AS (SELECT doc_id, len(any_value(t)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM t) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.0 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 20)"""
_LEX = """, ql AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id), cs AS (SELECT query_id, doc_id, count(*) / terms AS score FROM q JOIN p USING (term) JOIN ql USING (query_id) GROUP BY query_id, doc_id, terms),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cs) WHERE rank <= 20)"""


def _bm25(spark, sf_dir, k: int = 20) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(q, table(spark, sf_dir, "documents"), k)


@query(f"WITH {_BM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_top(spark, sf_dir):
    return _r(_bm25(spark, sf_dir), "score", digits=6)


_DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_DN = f"""dn AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_DOT} AS score, a.label = b.label AS relevant,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 10)"""


def _dense(spark, sf_dir, k: int = 10) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return retrieval.dense(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("w")), k)


@query(f"WITH {_DN} SELECT query_id, item_id, round(score, 6) AS score, rank FROM dn")
def dense_top(spark, sf_dir):
    """Rows whose id is divisible by 50 are the stated query set, against all rows."""
    return _r(_dense(spark, sf_dir), "score", digits=6)


@query(
    f"""WITH {_BM}{_LEX},
f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM lex) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
)
def rank_fusion(spark, sf_dir):
    """BM25 and the share of a query's terms a document has, two retrievers over all documents."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    a = _bm25(spark, sf_dir)
    b = retrieval.contained_terms(q, table(spark, sf_dir, "documents"), 20)
    return _r(retrieval.reciprocal_rank_fusion([a, b], "query_id", "doc_id", 10), "score", digits=9)


def branches(spark, sf_dir) -> DataFrame:
    """Two score branches over each customer's orders."""
    bucket = F.when(F.col("o_orderkey") % 3 == 0, "head").when(F.col("o_orderkey") % 3 == 1, "torso").otherwise("tail")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 1000).alias("a"), (F.col("o_orderkey") % 97).cast("double").alias("b"), bucket.alias("bucket"))


_BR = """br AS (SELECT o_custkey AS g, o_orderkey AS item, o_totalprice / 1000 AS a, (o_orderkey % 97)::DOUBLE AS b, CASE o_orderkey % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'torso' ELSE 'tail' END AS bucket FROM orders),
z AS (SELECT *, CASE WHEN stddev_pop(a) OVER w > 1e-12 THEN (a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE 0 END AS za, CASE WHEN stddev_pop(b) OVER w > 1e-12 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END AS zb FROM br WINDOW w AS (PARTITION BY g))"""


@query(f"WITH {_BR} SELECT g, item, round(za + 0.25 * zb, 6) AS score FROM z")
def late_fusion(spark, sf_dir):
    return _r(retrieval.late_fusion(branches(spark, sf_dir), "g", "a", "b", 0.25).select("g", "item", "score"), "score", digits=6)


@query(
    f"""WITH {_BR}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY za DESC, item) AS r FROM z),
m AS (SELECT *, coalesce(max(za) FILTER (WHERE r = 1) OVER w - max(za) FILTER (WHERE r = 2) OVER w, 0) AS margin FROM k WINDOW w AS (PARTITION BY g))
SELECT g, item, round(1 / (1 + greatest(margin, 0)), 6) AS uncertainty, round(za + 0.25 * zb + 0.5 / (1 + greatest(margin, 0)) * CASE bucket WHEN 'head' THEN 0 WHEN 'torso' THEN 0.5 ELSE 1 END * zb, 6) AS score FROM m"""
)
def confidence_fusion(spark, sf_dir):
    return _r(retrieval.confidence_fusion(branches(spark, sf_dir), "g", "item", "a", "b", "bucket").select("g", "item", "uncertainty", "score"), "uncertainty", "score", digits=6)


@query(
    f"""WITH {_BR}, x AS (SELECT g, item, row_number() OVER (PARTITION BY g ORDER BY a DESC, item) AS ra, row_number() OVER (PARTITION BY g ORDER BY b DESC, item) AS rb FROM br)
SELECT g, item FROM x WHERE rb <= 2 UNION ALL SELECT g, item FROM (SELECT g, item, row_number() OVER (PARTITION BY g ORDER BY ra) AS k FROM x WHERE rb > 2) WHERE k <= 4"""
)
def fixed_budget_mix(spark, sf_dir):
    b = branches(spark, sf_dir)
    first, second = ordering.rank_within(b, ["g"], [F.desc("a"), "item"]), ordering.top_within(b, ["g"], [F.desc("b"), "item"], 2)
    return retrieval.fixed_budget(first, second, "g", "item", 2, 6)


@query(
    f"""WITH h AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events WHERE user_id % 50 = 0),
e AS (SELECT user_id, i, avg(embedding[i]::DOUBLE) AS x FROM h JOIN embeddings ON vec_id = item_id, range(1, 65) t(i) GROUP BY user_id, i), p AS (SELECT user_id, list(x ORDER BY i) AS v FROM e GROUP BY user_id),
s AS (SELECT user_id AS query_id, vec_id AS item_id, list_sum(list_transform(range(1, 65), lambda i: v[i] * embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS score FROM p, embeddings)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 10"""
)
def profile_retrieval(spark, sf_dir):
    """Users whose id 50 divides are the stated query set, each with the whole history, against all items."""
    item = F.get_json_object("props", "$.k").cast("long")
    h = table(spark, sf_dir, "events").select("user_id", item.alias("item_id")).where("user_id % 50 = 0").distinct()
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("w"))
    return _r(retrieval.profile_scores(h, e, e, 10), "score", digits=6)


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean,
len(embedding)::BIGINT AS dim FROM embeddings"""
)
def vector_profile(spark, sf_dir):
    v = F.col("embedding")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    return _r(table(spark, sf_dir, "embeddings").select("vec_id", vectors.norm(v).alias("norm"), mean.alias("mean"), F.size(v).cast("long").alias("dim")), "norm", "mean", digits=6)


def routed(spark, sf_dir) -> DataFrame:
    """Per-customer quality and latency of two models, made from order totals."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.round(F.avg("o_totalprice") / 500000, 9).alias("small_quality"), F.round(F.max("o_totalprice") / 500000, 9).alias("large_quality"), F.count("*").alias("n"))
    bucket = F.when(F.col("n") <= 8, "tail").when(F.col("n") <= 12, "torso").otherwise("head")
    return o.select("q", "small_quality", "large_quality", "n", bucket.alias("bucket"), (F.col("q") * 7919 % 1009 / 1009).alias("score"), F.lit(2.0).alias("small_ms"), (F.lit(60.0) + F.col("n")).alias("large_ms"))


_RT = """rt AS (SELECT o_custkey AS q, round(avg(o_totalprice) / 500000, 9) AS small_quality, round(max(o_totalprice) / 500000, 9) AS large_quality, count(*) AS n,
 CASE WHEN count(*) <= 8 THEN 'tail' WHEN count(*) <= 12 THEN 'torso' ELSE 'head' END AS bucket, o_custkey * 7919 % 1009 / 1009 AS score, 2.0::DOUBLE AS small_ms, 60.0::DOUBLE + count(*) AS large_ms FROM orders GROUP BY o_custkey),
tb AS (SELECT *, row_number() OVER (ORDER BY score DESC, q) <= greatest(1, round_even(count(*) OVER () * 0.4, 0)) AS use_large FROM rt)"""
_POLICY = """count(*) AS n, round(avg(CASE WHEN use_large THEN large_quality ELSE small_quality END), 7) AS quality, round(avg(CASE WHEN use_large THEN large_quality - small_quality ELSE 0 END), 7) AS gain,
round(avg(use_large::INT), 7) AS call_rate, round(avg(CASE WHEN use_large THEN large_ms ELSE small_ms END), 6) AS mean_ms"""


@query(f"WITH {_RT} SELECT q, use_large FROM tb")
def budget_route(spark, sf_dir):
    return routing.top_budget(routed(spark, sf_dir), "score", "q", 0.4).select("q", "use_large")


@query(f"WITH {_RT} SELECT coalesce(bucket, 'overall') AS bucket, {_POLICY} FROM tb GROUP BY GROUPING SETS ((bucket), ())")
def policy_report(spark, sf_dir):
    out = routing.policy(routing.top_budget(routed(spark, sf_dir), "score", "q", 0.4), "bucket")
    return _r(_r(out, "quality", "gain", "call_rate"), "mean_ms", digits=6)


@query(
    f"""WITH {_RT}, k AS (SELECT greatest(1, round_even(count(*) * 0.3, 0)) AS k, least(round_even(count(*) FILTER (WHERE bucket = 'tail') * 0.5, 0), greatest(1, round_even(count(*) * 0.3, 0))) AS f FROM rt),
a AS (SELECT rt.*, bucket = 'tail' AND row_number() OVER (PARTITION BY bucket = 'tail' ORDER BY score DESC, q) <= f AS kept, k FROM rt, k)
SELECT q, bucket, row_number() OVER (ORDER BY kept DESC, score DESC, q) <= k AS use_large FROM a"""
)
def tail_floor_route(spark, sf_dir):
    return routing.tail_floor(routed(spark, sf_dir), "score", "q", "bucket", 0.3, 0.5).select("q", "bucket", "use_large")


@query(
    f"""WITH {_RT}, g AS (SELECT t, avg((score >= t)::INT) AS c, avg(CASE WHEN score >= t THEN large_quality ELSE small_quality END) AS y FROM rt, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t) GROUP BY t)
SELECT t::DOUBLE AS threshold, round(c, 7) AS call_rate, round(y, 7) AS quality FROM g WHERE c <= 0.6 ORDER BY round(y, 9) DESC, c, t DESC LIMIT 1"""
)
def threshold_search(spark, sf_dir):
    return _r(routing.threshold_grid(routed(spark, sf_dir), "score", [0.1, 0.3, 0.5, 0.7, 0.9], 0.6), "call_rate", "quality")


@query(
    f"""WITH {_RT}, r AS (SELECT *, row_number() OVER (ORDER BY large_quality - small_quality DESC, q) AS k, count(*) OVER () AS t FROM rt)
SELECT b::DOUBLE AS budget, round(avg(CASE WHEN k <= greatest(1, round_even(t * b, 0)) THEN large_quality ELSE small_quality END), 7) AS quality FROM r, (SELECT unnest([0.1, 0.25, 0.5]) AS b) GROUP BY b"""
)
def oracle_curve(spark, sf_dir):
    return _r(routing.oracle_curve(routed(spark, sf_dir), "q", [0.1, 0.25, 0.5]), "quality")


@query(
    f"""WITH {_RT} SELECT q, round(1 / (1 + exp(-(-0.5 + 1.5 * (score - 0.5) / 0.3 + -0.8 * (n - 10) / 4.0))), 7) AS probability, 1 / (1 + exp(-(-0.5 + 1.5 * (score - 0.5) / 0.3 + -0.8 * (n - 10) / 4.0))) >= 0.4 AS use_large,
CASE WHEN small_quality - 0.002 * small_ms >= large_quality - 0.002 * large_ms THEN 'small_quality' ELSE 'large_quality' END AS choice FROM rt"""
)
def gates(spark, sf_dir):
    rows = routing.linear_gate(routed(spark, sf_dir), {"features": [("score", 0.5, 0.3, 1.5), ("n", 10, 4.0, -0.8)], "bias": -0.5, "threshold": 0.4})
    rows = routing.cost_adjusted(rows, [("small_quality", "small_ms"), ("large_quality", "large_ms")], 0.002)
    return _r(rows.select("q", "probability", "use_large", "choice"), "probability")


@query(
    """WITH f AS (SELECT *, event_type = 'error' AS bad FROM events), r AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT event_id, user_id, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS consecutive_failures FROM r"""
)
def failure_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error").withColumn("at", F.struct("ts", "event_id"))
    return routing.circuit_breaker_runs(rows, "user_id", "at", "bad").select("event_id", "user_id", "consecutive_failures")


@query(
    """WITH r AS (SELECT o_custkey AS q, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, length(o_orderpriority) AS len, o_orderstatus FROM orders)
SELECT q, count(*) AS n, round(max(s), 6) AS top1, round(max(s) FILTER (WHERE r = 1) - coalesce(max(s) FILTER (WHERE r = 2), min(s)), 6) AS gap12, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS spread, max(len)::BIGINT AS max_len, round(avg((len < 8)::INT), 7) AS short_rate,
count(DISTINCT o_orderstatus) AS kinds FROM r GROUP BY q"""
)
def gate_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_totalprice").alias("s"), "o_orderkey", F.length("o_orderpriority").alias("len"), "o_orderstatus")
    r = ordering.rank_within(o, ["q"], [F.desc("s"), "o_orderkey"], "r")
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("s")))
    out = r.groupBy("q").agg(
        F.count("*").alias("n"), F.max("s").alias("top1"), (at(1) - F.coalesce(at(2), F.min("s"))).alias("gap12"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("spread"), F.max("len").cast("long").alias("max_len"),
        F.round(F.avg((F.col("len") < 8).cast("double")), 7).alias("short_rate"), F.countDistinct("o_orderstatus").alias("kinds"),
    )
    return _r(out, "top1", "gap12", "mean", "spread", digits=6)


_G = """e AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i FROM events), du AS (SELECT u, count(*) AS du FROM e GROUP BY u), di AS (SELECT i, count(*) AS di FROM e GROUP BY i),
w AS (SELECT 'u' || u AS src, 'i' || i AS dst, 1 / sqrt(du * di) AS w FROM e JOIN du USING (u) JOIN di USING (i)), adj AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w)"""


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("i"))


@query(f"WITH {_G} SELECT src, dst, round(w, 7) AS w FROM adj")
def normalized_adjacency(spark, sf_dir):
    return _r(graph.normalized_edges(_edges(spark, sf_dir)), "w")


@query(
    f"""WITH {_G}, x0 AS (SELECT DISTINCT src AS node, CASE WHEN src[1] = 'u' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS x FROM adj),
x1 AS (SELECT dst AS node, sum(w * x) AS x FROM adj JOIN x0 ON src = node GROUP BY dst), x2 AS (SELECT dst AS node, sum(w * x) AS x FROM adj JOIN x1 ON src = node GROUP BY dst)
SELECT node, round(sum(x), 6) AS x FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY node"""
)
def graph_propagation(spark, sf_dir):
    e = graph.normalized_edges(_edges(spark, sf_dir))
    x = e.select(F.col("src").alias("node")).distinct().select("node", F.lit(0).alias("dim"), F.when(F.col("node").startswith("u"), 1.0).otherwise(0.5).alias("x"))
    return _r(graph.propagate(e, x, 2).select("node", "x"), "x", digits=6)


@query(
    """WITH n AS (SELECT o_custkey AS q, count(*) AS n FROM orders GROUP BY 1) SELECT q, n, CASE WHEN n <= 6 THEN [{'start': 0::BIGINT, 'end': n}] ELSE
list_transform(range(ceil((n - 6) / 3)::BIGINT + 1), lambda i: {'start': greatest(n - 6 - i * 3, 0), 'end': greatest(n - 6 - i * 3, 0) + 6}) END::VARCHAR AS plan FROM n"""
)
def window_plans(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.count("*").alias("n"))
    plan = F.transform(pairwise.window_plan(F.col("n"), 6, 3), lambda w: F.format_string("{'start': %d, 'end': %d}", w["start"], w["end"]))
    return n.select("q", "n", F.concat(F.lit("["), F.array_join(plan, ", "), F.lit("]")).alias("plan"))


@query(
    f"""WITH {_BR}, x AS (SELECT g, item, row_number() OVER (PARTITION BY g ORDER BY za DESC, item) AS ra, row_number() OVER (PARTITION BY g ORDER BY zb DESC, item) AS rb, za, zb FROM z)
SELECT g, count(*) AS n, round(CASE WHEN stddev_pop(za) > 1e-12 AND stddev_pop(zb) > 1e-12 THEN covar_pop(za, zb) / (stddev_pop(za) * stddev_pop(zb)) ELSE 0 END, 6) AS score_correlation,
round(CASE WHEN stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) ELSE 0 END, 6) AS rank_correlation FROM x GROUP BY g"""
)
def branch_correlation(spark, sf_dir):
    z = calibration.z_scores(calibration.z_scores(branches(spark, sf_dir), "g", "a", "za"), "g", "b", "zb")
    x = ordering.rank_within(ordering.rank_within(z, ["g"], [F.desc("za"), "item"], "ra"), ["g"], [F.desc("zb"), "item"], "rb")
    out = x.groupBy("g").agg(F.count("*").alias("n"), calibration.correlation("za", "zb").alias("score_correlation"), calibration.correlation("ra", "rb").alias("rank_correlation"))
    return _r(out, "score_correlation", "rank_correlation", digits=6)


@query(f"WITH {_DN} SELECT query_id, rank, count(*) FILTER (WHERE NOT relevant) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS misses FROM dn")
def running_misses(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels = e.select("vec_id", "label")
    d = _dense(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("b")), "item_id")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("query_id", "rank", F.count(F.when(F.col("a") != F.col("b"), 1)).over(w).alias("misses"))
