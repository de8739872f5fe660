"""Queries on joins, aggregates, set operations, sources, sinks and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_tokens
from ..operators import contracts, interactions, ordering
from ..session import shared_folder, table
from ..sources import files
from ..streaming import events as streams
from . import preparation

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def scratch(spark) -> str:
    """A new folder that driver and executors share."""
    return shared_folder(spark, "scratch")


@query(
    """SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"""
)
def star_join(spark, sf_dir):
    """The fact table is joined to orders by key; small dimensions are left to be broadcast by their size."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    rows = t("lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice", "l_discount")
    j = rows.join(t("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query(
    """SELECT c_custkey, o.n IS NOT NULL AS has_orders, coalesce(o.n, 0) AS orders, coalesce(o.s, 0) AS urgent FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS s FROM orders WHERE o_totalprice > 300000 GROUP BY 1) o ON o_custkey = c_custkey"""
)
def left_join_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderpriority").startswith("1"), 1)).alias("s"))
    j = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.col("n").isNotNull().alias("has_orders"), F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("s", F.lit(0)).alias("urgent"))


@query(
    """SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) UNION ALL
SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION ALL
SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)"""
)
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    parts = {
        "semi": c.join(dear, "c_custkey", "left_semi"),
        "anti": c.join(dear, "c_custkey", "left_anti"),
        "intersect": c.select("c_custkey").intersect(s.select("s_suppkey")),
        "except": c.select("c_custkey").exceptAll(s.select("s_suppkey")).distinct(),
        "union": c.select("c_nationkey").union(s.select("s_nationkey")).distinct(),
    }
    out = None
    for kind, df in parts.items():
        one = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT doc_id, quality, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id)"""
)
def checked_join(spark, sf_dir):
    """A many-to-one join that fails on a repeated key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return contracts.checked_join(table(spark, sf_dir, "labels"), docs, ["doc_id"], validate="one_to_one").select("doc_id", "quality", "toxic", "lang", "n_chars")


_LISTS = """l AS (SELECT user_id AS query_id, list(event_id ORDER BY value DESC, event_id)[1:12] AS ids, CASE WHEN user_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM events GROUP BY user_id),
u AS (SELECT query_id, split, unnest(ids) AS doc, unnest(range(1, len(ids) + 1)) AS source_rank FROM l)"""


def candidate_lists(spark, sf_dir) -> DataFrame:
    """Nested lists of the twelve best of each user; the place in a list is its rank."""
    top = ordering.top_within(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 12)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"])
    return top.groupBy(F.col("user_id").alias("query_id")).agg(ids.alias("ids")).withColumn("split", F.when(F.col("query_id") % 5 == 0, "dev").otherwise("train"))


@query(f"WITH {_LISTS} SELECT query_id, ids, split FROM l")
def nested_candidates(spark, sf_dir):
    return candidate_lists(spark, sf_dir)


@query(
    f"""WITH {_LISTS}, lab AS (SELECT event_id AS doc, (event_type = 'purchase')::INT AS label, length(props) AS len FROM events), f AS (SELECT doc % 100 AS k, count(*) AS freq FROM u GROUP BY 1)
SELECT query_id, split, doc, source_rank, coalesce(label, 0) AS label, sum(label) OVER (PARTITION BY query_id)::BIGINT AS positives, count(*) OVER (PARTITION BY query_id) AS n, len::BIGINT AS n_chars, round(source_rank / count(*) OVER (PARTITION BY query_id), 7)::DOUBLE AS place, freq
FROM u LEFT JOIN lab USING (doc) LEFT JOIN f ON k = doc % 100 WHERE source_rank <= 10"""
)
def listwise_table(spark, sf_dir):
    u = candidate_lists(spark, sf_dir).select("query_id", "split", F.posexplode("ids").alias("p", "doc")).select("query_id", "split", "doc", (F.col("p") + 1).cast("long").alias("source_rank"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.length("props").cast("long").alias("n_chars"))
    freq = u.groupBy((F.col("doc") % 100).alias("k")).agg(F.count("*").alias("freq"))
    w = Window.partitionBy("query_id")
    j = u.where("source_rank <= 10").join(e, "doc", "left").join(F.broadcast(freq), F.col("doc") % 100 == F.col("k"), "left")  # at most 100 rows
    j = j.withColumn("label", F.coalesce("label", F.lit(0)))
    return j.select("query_id", "split", "doc", "source_rank", "label", F.sum("label").over(w).alias("positives"), F.count("*").over(w).alias("n"), "n_chars", F.round(F.col("source_rank") / F.count("*").over(w), 7).alias("place"), "freq")


@query(
    f"WITH {_LISTS} SELECT split, count(*) AS lists, sum(len(ids))::BIGINT AS candidates, sum(len(ids) - len(list_distinct(ids)))::BIGINT AS repeated, count(DISTINCT query_id) FILTER (WHERE len(ids) >= 10) AS long_lists FROM l GROUP BY split"
)
def list_audit(spark, sf_dir):
    n, d = F.size("ids"), F.size(F.array_distinct("ids"))
    return candidate_lists(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("lists"), F.sum(n).alias("candidates"), F.sum(n - d).alias("repeated"), F.countDistinct(F.when(n >= 10, F.col("query_id"))).alias("long_lists")
    )


@query(
    """WITH m AS (SELECT user_id AS g, map_from_entries(list({'k': chr((65 + r)::INT), 'v': value} ORDER BY r)) AS logits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) WHERE r < 5 GROUP BY user_id)
SELECT g, k AS identifier, logits[k] AS logit, k = list_reduce(map_keys(logits), lambda a, b: CASE WHEN logits[b] > logits[a] THEN b ELSE a END) AS best FROM (SELECT g, logits, unnest(map_keys(logits)) AS k FROM m)"""
)
def logit_maps(spark, sf_dir):
    """Maps identifier -> logit, exploded, with the argmax of each map."""
    e = ordering.top_within(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 5, "r")
    entries = F.array_sort(F.collect_list(F.struct(F.char(64 + F.col("r")).alias("k"), F.col("value").alias("v"))))
    m = e.groupBy(F.col("user_id").alias("g")).agg(F.map_from_entries(entries).alias("logits"))
    best = F.aggregate(F.map_keys("logits"), F.lit("A"), lambda a, b: F.when(F.element_at("logits", b) > F.element_at("logits", a), b).otherwise(a))
    return m.select("g", best.alias("b"), F.explode("logits").alias("identifier", "logit")).select("g", "identifier", "logit", (F.col("identifier") == F.col("b")).alias("best"))


@query(
    """SELECT event_type, to_json({'kind': event_type, 'n': count(*), 'top': max(event_id)})::VARCHAR AS summary, any_value(json_extract_string(props, '$.k')) IS NOT NULL AS has_k,
arg_min(event_id, value) AS cheapest, max(event_id) FILTER (WHERE value > 50) AS last_dear, sum((value > 50)::INT)::BIGINT AS dear FROM events GROUP BY event_type"""
)
def json_and_picks(spark, sf_dir):
    """Null values and ids are never picked; of equal values the smallest event_id is, where the SQL leaves the choice open."""
    e = table(spark, sf_dir, "events")
    dear, known = F.col("value") > 50, F.col("value").isNotNull() & F.col("event_id").isNotNull()
    out = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.max("event_id").alias("top"), F.any_value(F.get_json_object("props", "$.k"), True).isNotNull().alias("has_k"),
        F.min_by("event_id", F.when(known, F.struct("value", "event_id"))).alias("cheapest"),
        F.max(F.when(dear, F.col("event_id"))).alias("last_dear"), F.sum(dear.cast("int")).alias("dear"),
    )
    summary = F.to_json(F.struct(F.col("event_type").alias("kind"), "n", "top"), {"ignoreNullFields": "false"})
    return out.select("event_type", summary.alias("summary"), "has_k", "cheapest", "last_dear", "dear")


@query(
    """WITH l AS (SELECT user_id, count(*) AS requests, 0 AS z FROM events GROUP BY user_id), one AS (SELECT user_id, min(value) AS ms FROM events GROUP BY user_id)
SELECT count(*) AS requests, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(1000 / avg(ms), 6) AS qps, round(sum(requests) * 1000.0 / sum(ms), 6) AS candidates_per_second
FROM one JOIN l USING (user_id)"""
)
def latency_summary(spark, sf_dir):
    one = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("ms"), F.count("*").alias("requests"))
    shape = one.agg(
        F.count("*").alias("requests"), F.round(F.avg("ms"), 6).alias("mean"), F.round(1000 / F.avg("ms"), 6).alias("qps"),
        F.round(F.sum("requests") * 1000.0 / F.sum("ms"), 6).alias("candidates_per_second"),
    )
    q = ordering.linear_quantiles(one, "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return shape.crossJoin(F.broadcast(q.select(*[F.round(c, 6).alias(c) for c in q.columns])))  # one row each


@query(
    """SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE value END AS clean, round(CASE WHEN user_id % 3 > 0 THEN value / (user_id % 3) ELSE 0 END, 7) AS guarded, event_type IN ('view', 'click') AS light,
CASE WHEN value - 50 > 1e-9 THEN 'gain' WHEN abs(value - 50) <= 1e-9 THEN 'tie' ELSE 'loss' END AS outcome FROM events"""
)
def guarded_expressions(spark, sf_dir):
    v, k = F.col("value"), F.col("user_id") % 3
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias("clean"), F.round(F.when(k > 0, v / k).otherwise(0.0), 7).alias("guarded"),
        F.col("event_type").isin("view", "click").alias("light"), F.when(v - 50 > 1e-9, "gain").when(F.abs(v - 50) <= 1e-9, "tie").otherwise("loss").alias("outcome"),
    )


@query(
    """SELECT r.doc_id, coalesce(n.lang, r.lang) AS lang, coalesce(n.n_chars, r.n_chars) AS n_chars FROM documents r LEFT JOIN (SELECT doc_id, upper(lang) AS lang, -n_chars AS n_chars FROM documents WHERE doc_id % 9 = 0) n USING (doc_id)"""
)
def overlay(spark, sf_dir):
    """Rows of a replacement table win."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    new = d.where("doc_id % 9 = 0").select("doc_id", F.upper("lang").alias("l"), (-F.col("n_chars")).alias("n"))
    return d.join(new, "doc_id", "left").select("doc_id", F.coalesce("l", "lang").alias("lang"), F.coalesce("n", "n_chars").alias("n_chars"))


@query(
    """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, doc_id FROM documents), c AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term)
SELECT term, tf, df FROM c ORDER BY tf DESC, term LIMIT 50"""
)
def top_terms(spark, sf_dir):
    """The fifty most frequent terms: the limit is the feature."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(alnum_tokens(F.col("text"))).alias("term"))
    per_doc = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.desc("tf"), "term").limit(50)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def sharded_round_trip(spark, sf_dir):
    """Written as hash shards ordered within, read back as one table."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    files.write_sharded(rows, path, "o_custkey", 8, ["o_custkey", "o_orderkey"])
    return files.parquet(spark, path, columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def report_round_trip(spark, sf_dir):
    """A metric table as CSV, read under an explicit schema."""
    path = scratch(spark)
    files.write_report(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return files.delimited(spark, f"{path}/csv", "c_custkey long, c_name string, c_acctbal double")


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT 'r' || user_id AS request_id, user_id::VARCHAR AS query_id, event_id::VARCHAR AS passage_id, rank::INT AS bm25_rank FROM r WHERE rank <= 5"""
)
def request_round_trip(spark, sf_dir):
    """Nested request lines without judgements, written and read back as one row per candidate."""
    path = scratch(spark)
    top = ordering.top_within(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 5)
    user = F.col("user_id").cast("string")
    rows = top.select(F.concat(F.lit("r"), user).alias("request_id"), user.alias("query_id"), F.lit("q").alias("query"), F.col("rank").cast("int").alias("bm25_rank"), F.col("event_id").cast("string").alias("passage_id"), F.col("props").alias("passage"))
    files.write_requests(rows, path)
    return files.teacher_requests(spark, path).select("request_id", "query_id", "passage_id", "bm25_rank")


@query(
    """SELECT count(*) AS rows, sum(CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT),
CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_quantity) AS BIGINT), l_returnflag, l_linestatus)), 1, 8) AS BIGINT))::BIGINT AS digest FROM lineitem"""
)
def table_fingerprint(spark, sf_dir):
    """Rows and a digest that doesn't depend on their order, over keys, amounts and flags."""
    whole = lambda c, by=1: F.round(F.col(c) * by).cast("bigint")
    rows = table(spark, sf_dir, "lineitem")
    return contracts.portable_fingerprint(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole("l_extendedprice", 100).alias("price"), whole("l_discount", 100).alias("discount"), whole("l_quantity").alias("quantity"), "l_returnflag", "l_linestatus"))


@query(
    """WITH f AS (SELECT event_id FROM events WHERE event_id % 4 <> 0) SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM f)"""
)
def resume_pending(spark, sf_dir):
    """Requests that an append-only cache doesn't answer yet."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return files.pending(e, e.where("event_id % 4 <> 0"), ["event_id"])


def _stream(spark, sf_dir) -> DataFrame:
    return streams.read_events(spark, f"{sf_dir}/events.parquet*")


def _name() -> str:
    return f"t{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(value), 4) AS sum_value FROM events GROUP BY event_type")
def stream_counters(spark, sf_dir):
    out = streams.drain(streams.running_summary(_stream(spark, sf_dir)), _name(), "complete")
    return out.select("event_type", "n", F.round("mean_value", 6).alias("mean_value"), F.round("sum_value", 4).alias("sum_value"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    out = streams.drain(streams.windowed(_stream(spark, sf_dir), "1 day", late="60 days"), _name(), "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("n").alias("n"))


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, t AS s, 1 AS c FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.t - w.s >= 86400 THEN o.t ELSE w.s END, CASE WHEN o.t - w.s >= 86400 THEN 1 ELSE w.c + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, c <= 2 AS allowed FROM w"""
)
def stream_rate_limit(spark, sf_dir):
    """Windows of a day that start at a user's first request, two requests each."""
    return streams.drain(streams.rate_limited(_stream(spark, sf_dir), 2, 86400.0), _name())


@query()
def stream_circuit_breaker(spark, sf_dir):
    return streams.drain(streams.circuit_breaker(_stream(spark, sf_dir), 2, 86400.0), _name())


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, t + 43200 AS e, 1 AS c FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, o.t + 43200, CASE WHEN o.t >= w.e THEN 1 ELSE w.c + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, c::BIGINT AS count FROM w"""
)
def stream_ttl_counter(spark, sf_dir):
    """Half a day of life that each call renews."""
    return streams.drain(streams.ttl_counter(_stream(spark, sf_dir), 43200.0, True), _name())


@query(
    """WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    """Sessions of the batch table by the same function that a stream uses; an extension."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    f"WITH {preparation._SPLIT} SELECT split, count(*) AS n, count(DISTINCT item_id) AS items, round(avg(history_length), 6) AS mean_length FROM split GROUP BY ROLLUP (split)"
)
def split_rollup(spark, sf_dir):
    s = interactions.leave_two_out(interactions.support_filter(preparation.log(spark, sf_dir), 3, 2))
    return s.rollup("split").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.round(F.avg("history_length"), 6).alias("mean_length"))
