"""Queries on intervals of arms and buckets, drift, prompt variants, costs, contracts and budget curves, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import calibration, contracts, ordering, pairwise, ranking, retrieval, routing, stats
from ..session import table
from ..sources import files, synthetic
from .evaluation import _L, _P, _TWO, _two, listed, probabilities
from .relational import scratch
from .search import _RT, _r, routed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def customers(spark, sf_dir) -> DataFrame:
    """(key, diff, n, arm, bucket) of customers: a difference that varies around 0, two arms, buckets by orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg((F.avg("o_totalprice") / 1000 - 250).alias("diff"), F.count("*").alias("n"))
    bucket = F.when(F.col("n") <= 8, "few").when(F.col("n") <= 12, "some").otherwise("many")
    return o.withColumns({"arm": F.col("key") % 2 == 0, "bucket": bucket})


def _weight() -> str:
    """Poisson(1) by the distribution function, as SQL."""
    below = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    return "CASE " + " ".join(f"WHEN u >= {below[k]!r} THEN {k + 1}" for k in range(7, -1, -1)) + " ELSE 0 END"


_W = f"""d AS (SELECT o_custkey AS key, avg(o_totalprice) / 1000 - 250 AS diff, o_custkey % 2 = 0 AS arm,
  CASE WHEN count(*) <= 8 THEN 'few' WHEN count(*) <= 12 THEN 'some' ELSE 'many' END AS bucket FROM orders GROUP BY o_custkey),
x AS (SELECT *, ('0x' || substr(md5('7:' || r || ':' || key), 1, 12))::BIGINT / 281474976710656.0 AS u FROM d, range(200) t(r)), w AS (SELECT *, {_weight()} AS w FROM x)"""


@query(
    f"""WITH {_W}, m AS (SELECT r, sum(w * diff) FILTER (WHERE arm) / sum(w) FILTER (WHERE arm) - sum(w * diff) FILTER (WHERE NOT arm) / sum(w) FILTER (WHERE NOT arm) AS v FROM w GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg((v > 0)::INT), 7) AS p_positive,
round(least(1.0, 2 * (least(count(*) FILTER (WHERE v <= 0), count(*) FILTER (WHERE v >= 0)) + 1) / (count(*) + 1)), 7) AS p_two_sided FROM m"""
)
def arm_difference_interval(spark, sf_dir):
    out = stats.two_sample_bootstrap(customers(spark, sf_dir), "key", "diff", "arm", 200)
    return _r(_r(out, "p_positive", "p_two_sided"), "low", "high", digits=6)


@query(
    f"""WITH {_W}, m AS (SELECT bucket, r, sum(w * diff) / sum(w) AS v FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY v, r) AS pos FROM m),
e AS (SELECT bucket, max(v) FILTER (WHERE pos = 6) AS low, max(v) FILTER (WHERE pos = 195) AS high FROM k GROUP BY bucket)
SELECT bucket, count(*) AS n, round(avg(diff), 6) AS mean, round(avg((diff > 0)::INT), 7) AS positive, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM d JOIN e USING (bucket) GROUP BY bucket"""
)
def bucket_difference_intervals(spark, sf_dir):
    out = stats.bucket_intervals(customers(spark, sf_dir), "key", "diff", "bucket", 200)
    return _r(_r(out, "positive"), "mean", "low", "high", digits=6)


_DRIFT = """v AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE + 0.5 * coalesce(b.embedding[i]::DOUBLE, 0)) AS b
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb, list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) AS ab,
  sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (b[i] - a[i]) * (b[i] - a[i])))) AS moved FROM v),
m AS (SELECT 'cosine' AS metric, CASE WHEN na * nb > 1e-12 THEN ab / (na * nb) ELSE 0 END AS x FROM n UNION ALL SELECT 'l2', moved FROM n UNION ALL SELECT 'relative_l2', CASE WHEN na > 1e-12 THEN moved / na ELSE 0 END FROM n)"""


@query(
    f"""WITH {_DRIFT} SELECT metric, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.01), 6) AS p01, round(median(x), 6) AS median,
round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max, round(avg((x < 0.9)::INT), 7) AS below_0p9, round(avg((x < 0.5)::INT), 7) AS below_0p5 FROM m GROUP BY metric"""
)
def embedding_drift(spark, sf_dir):
    """From each vector to one moved half of the way along the next id's vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    next_ = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    moved = F.zip_with("v", F.col("w"), lambda x, y: x.cast("double") + 0.5 * y.cast("double"))
    after = e.join(next_, "vec_id", "left").select("vec_id", F.when(F.col("w").isNull(), F.transform("v", lambda x: x.cast("double"))).otherwise(moved).alias("v"))
    out = stats.embedding_drift(e, after, "vec_id")
    return _r(_r(out, "below_0p9", "below_0p5"), "mean", "std", "min", "p01", "median", "p99", "max", digits=6)


@query(
    """WITH h AS (SELECT vec_id, i, ('0x' || substr(md5('0:' || vec_id || ':' || (i - 1)), 1, 12))::BIGINT AS a, ('0x' || substr(md5('0:' || vec_id || ':' || (i - 1)), 13, 12))::BIGINT AS b, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
z AS (SELECT vec_id, i, x, sqrt(-2 * ln((a + 1)::DOUBLE / 281474976710657::DOUBLE)) * cos(2 * pi() * ((b + 1)::DOUBLE / 281474976710657::DOUBLE)) AS z FROM h),
m AS (SELECT i, avg(x) AS xm, stddev_pop(x) AS xs, avg(z) AS zm, stddev_pop(z) AS zs FROM z GROUP BY i)
SELECT vec_id, i - 1 AS dimension, round((z - zm) / zs * xs + xm, 5) AS value FROM z JOIN m USING (i)"""
)
def matched_random_vectors(spark, sf_dir):
    """Random vectors with the real ones' mean and deviation in each dimension, as a control."""
    v = vectors.moments_matched(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return v.select("vec_id", F.posexplode("v").alias("dimension", "value")).select("vec_id", F.col("dimension").cast("long").alias("dimension"), F.round("value", 5).alias("value"))


@query(
    """WITH h AS (SELECT user_id AS q, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id % 50 = 0),
t AS (SELECT q, item AS target FROM h WHERE r = 1), p AS (SELECT DISTINCT q, item FROM h WHERE r > 1),
e AS (SELECT q, i, avg(embedding[i]::DOUBLE) AS x FROM p JOIN embeddings ON vec_id = item, range(1, 65) s(i) GROUP BY q, i), v AS (SELECT q, list(x ORDER BY i) AS v FROM e GROUP BY q),
s AS (SELECT q, vec_id AS item, round(list_sum(list_transform(range(1, 33), lambda i: v[i] * embedding[i]::DOUBLE)), 9) AS c, round(list_sum(list_transform(range(33, 65), lambda i: v[i] * embedding[i]::DOUBLE)), 9) AS m FROM v, embeddings),
o AS (SELECT s.*, target FROM s JOIN t USING (q) LEFT JOIN p ON p.q = s.q AND p.item = s.item WHERE p.item IS NULL OR s.item = target),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, item) AS rc, row_number() OVER (PARTITION BY q ORDER BY m DESC, item) AS rm FROM o)
SELECT q AS query_id, item AS item_id, CASE WHEN rc <= 20 THEN rc END AS collaborative_rank, CASE WHEN rm <= 20 THEN rm END AS semantic_rank, item = target AS is_target FROM k WHERE rc <= 20 OR rm <= 20"""
)
def catalog_union_retrieval(spark, sf_dir):
    """Users whose id 50 divides against the whole catalog, in two vector spaces (the halves of a vector), histories left out."""
    item = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").where("user_id % 50 = 0").select(F.col("user_id").alias("query_id"), item.alias("item_id"), "ts", "event_id")
    r = ordering.rank_within(e, ["query_id"], [F.desc("ts"), F.desc("event_id")], "r")
    history = r.where("r > 1").select("query_id", "item_id").distinct()
    targets = r.where("r = 1").select("query_id", F.col("item_id").alias("target"))
    v = table(spark, sf_dir, "embeddings")
    spaces = {n: v.select(F.col("vec_id").alias("item_id"), F.slice("embedding", a, 32).alias("w")) for n, a in (("collaborative", 1), ("semantic", 33))}
    return retrieval.full_catalog(history, targets, spaces, 20)


@query(
    f"""WITH {_L}, n AS (SELECT g, item, rank, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY sha256('order:42:' || g || ':' || item), item) AS shuffled, row_number() OVER (PARTITION BY g ORDER BY sha256('name:42:' || g || ':' || rank), rank) AS named FROM l),
p AS (SELECT *, CASE v WHEN 'reverse' THEN n + 1 - rank WHEN 'random_permutation' THEN shuffled ELSE rank END AS position FROM n, (SELECT unnest(['baseline', 'reverse', 'random_permutation', 'identifier_remap']) AS v))
SELECT g, v AS variant, item, position, chr((64 + CASE v WHEN 'identifier_remap' THEN named ELSE position END)::INT) AS identifier FROM p"""
)
def prompt_variants(spark, sf_dir):
    """Each list as it is, reversed, permuted and under permuted names."""
    return pairwise.prompt_entries(listed(spark, sf_dir), "g", "item", "rank")


_CMP = f"""{_L}, o AS (SELECT x.g, x.item AS first, y.item AS second, x.score AS a, y.score AS b, x.score - y.score + 1.0::DOUBLE + 4.0::DOUBLE *
 (2 * (CAST(('0x' || substr(sha256('0:' || x.g || ':' || x.item || ':' || y.item), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE) - 1) AS d FROM l x JOIN l y ON x.g = y.g AND x.item <> y.item WHERE x.rank <= 6 AND y.rank <= 6)"""


def compared(spark, sf_dir) -> DataFrame:
    top = listed(spark, sf_dir).where("rank <= 6")
    pairs = pairwise.all_pairs(top, "g", "item", "rank", both_ways=True).select("g", "first", "second")
    s = top.select("g", "item", "score")
    j = pairs.join(s.select("g", F.col("item").alias("first"), F.col("score").alias("a")), ["g", "first"]).join(s.select("g", F.col("item").alias("second"), F.col("score").alias("b")), ["g", "second"])
    return pairwise.compare(j, "g", 1.0, 4.0, 0.5)


@query(f"WITH {_CMP} SELECT g, first, second, round(d, 6) AS difference, CASE WHEN abs(d) <= 0.5 THEN 'tie' WHEN d > 0 THEN 'first' ELSE 'second' END AS choice FROM o")
def comparator_choices(spark, sf_dir):
    """Ordered pairs of each list's six best under place bias, jitter and a tie margin."""
    return _r(compared(spark, sf_dir).select("g", "first", "second", "difference", "choice"), "difference", digits=6)


@query(
    rf"""WITH {_CMP}, w AS (SELECT event_id, len(list_filter(regexp_split_to_array(props, '\s+'), lambda t: t <> '')) AS n FROM events)
SELECT g, count(*) AS prompts, sum(6 + p.n + q.n)::BIGINT AS input_tokens, count(*) AS output_tokens, round(avg(abs(a - b)) FILTER (WHERE first % 10 <> 0 AND second % 10 <> 0), 6) AS margin
FROM o JOIN w p ON p.event_id = first JOIN w q ON q.event_id = second GROUP BY g"""
)
def comparison_costs(spark, sf_dir):
    """Prompts, tokens and likelihood margins of the comparator's calls; every tenth candidate has no likelihood."""
    words = table(spark, sf_dir, "events").select("event_id", text.word_count(F.col("props")).alias("n"))
    c = compared(spark, sf_dir)
    c = c.join(words.select(F.col("event_id").alias("first"), F.col("n").alias("n1")), "first").join(words.select(F.col("event_id").alias("second"), F.col("n").alias("n2")), "second")
    score = lambda item, s: F.when(F.col(item) % 10 != 0, F.col(s))
    calls = c.select("g", (6 + F.col("n1") + F.col("n2")).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), score("first", "a").alias("score_first"), score("second", "b").alias("score_second"))
    return _r(pairwise.costs(calls, "g"), "margin", digits=6)


@query(
    f"""WITH {_L}, a AS (SELECT g, item FROM l UNION ALL SELECT g, item FROM l WHERE item % 100 = 0), x AS (SELECT DISTINCT user_id AS g FROM events WHERE event_type = 'purchase' UNION SELECT max(user_id) + 1 FROM events),
c AS (SELECT (SELECT count(*) FROM a) AS rows, (SELECT count(*) - count(DISTINCT (g, item)) FROM a) AS repeated, (SELECT count(*) FROM x WHERE g NOT IN (SELECT g FROM a)) AS missing,
(SELECT count(DISTINCT g) FROM a WHERE g NOT IN (SELECT g FROM x)) AS extra) SELECT *, repeated + missing + extra = 0 AS complete FROM c"""
)
def shard_coverage(spark, sf_dir):
    """Four shards of predictions, some rows twice, against the groups that are due."""
    l = listed(spark, sf_dir).select("g", "item")  # noqa: E741
    shards = [l.where(F.pmod("g", F.lit(4)) == i) for i in range(4)] + [l.where("item % 100 = 0")]
    e = table(spark, sf_dir, "events")
    due = e.where("event_type = 'purchase'").select(F.col("user_id").alias("g")).unionByName(e.agg((F.max("user_id") + 1).alias("g"))).distinct()
    return contracts.merge_shards(shards, ["g", "item"], "g", due)[1]


@query(
    """WITH u AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 12 THEN 'unlocked' ELSE 'locked_unaccessed' END AS status, count(*) FILTER (WHERE event_type = 'purchase' AND value > 90) AS evaluation_count FROM events GROUP BY user_id)
SELECT *, status = 'locked_unaccessed' AND evaluation_count = 0 AS may_run FROM u"""
)
def evaluation_guards(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(F.count(F.when(kind == "error", 1)) > 12, "unlocked").otherwise("locked_unaccessed")
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(status.alias("status"), F.count(F.when((kind == "purchase") & (F.col("value") > 90), 1)).alias("evaluation_count"))
    return contracts.unlocked(u)


def _unit(kind: str) -> str:
    return f"CAST(('0x' || substr(sha256('{kind}:3:' || q || ':' || i), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(
    f"""WITH s AS (SELECT q, i, {_unit('student')} AS student, {_unit('teacher')} AS draw FROM range(300) a(q), range(20) b(i)), t AS (SELECT q, i, student, 0.6::DOUBLE * student + 0.4::DOUBLE * draw AS teacher FROM s)
SELECT q AS query_id, i AS item_id, round(student, 7) AS student, round(teacher, 7) AS teacher, floor(teacher * 4)::BIGINT AS relevance FROM t"""
)
def synthetic_lists(spark, sf_dir):
    return _r(synthetic.candidate_lists(spark, 300, 20, 3), "student", "teacher")


@query(
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS f, avg(value) AS v FROM events)
SELECT 'requests_total' AS metric, 'engine_requests_total ' || n AS line FROM c UNION ALL SELECT 'calls_total', 'engine_calls_total ' || f FROM c
UNION ALL SELECT 'call_rate', printf('engine_call_rate %.6f', f / n) FROM c UNION ALL SELECT 'mean_value', printf('engine_mean_value %.6f', v) FROM c"""
)
def counter_lines(spark, sf_dir):
    bought = F.count(F.when(F.col("event_type") == "purchase", 1))
    c = table(spark, sf_dir, "events").agg(F.count("*").alias("requests_total"), bought.alias("calls_total"), (bought / F.count("*")).alias("call_rate"), F.avg("value").alias("mean_value"))
    return files.exposition(c, "engine")


@query(
    f"""WITH {_RT}, p AS (SELECT t::BIGINT AS threshold, avg(CASE WHEN n < t THEN small_quality ELSE large_quality END) AS y, count(*) FILTER (WHERE n < t) AS f FROM rt, (SELECT unnest([0, 5, 8, 10, 12]) AS t) GROUP BY t)
SELECT threshold, round(y, 7) AS quality, f AS fallback_queries, row_number() OVER (ORDER BY round(y, 9) DESC, threshold) = 1 AS selected FROM p"""
)
def fallback_thresholds(spark, sf_dir):
    return _r(routing.fallback_rule(routed(spark, sf_dir), "n", [0, 5, 8, 10, 12]), "quality")


@query(
    f"""WITH {_RT}, r AS (SELECT *, row_number() OVER (ORDER BY (bucket = 'tail') DESC, large_quality - small_quality DESC, q) AS pos, count(*) OVER () AS t FROM rt),
p AS (SELECT b, bucket, pos <= round_even(t * b, 0) AS use, CASE WHEN pos <= round_even(t * b, 0) THEN large_quality ELSE small_quality END AS y FROM r, (SELECT unnest([0.3::DOUBLE, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0]) AS b))
SELECT b AS budget, round(avg(y), 7) AS quality, round(avg(y) FILTER (WHERE bucket = 'tail'), 7) AS tail_quality, count(*) FILTER (WHERE use) AS calls FROM p GROUP BY b"""
)
def tail_priority_curve(spark, sf_dir):
    return _r(routing.tail_priority_curve(routed(spark, sf_dir), "q", "bucket", [0.3, 0.4, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0]), "quality", "tail_quality")


@query(
    """WITH p AS (SELECT DISTINCT user_id AS q, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events WHERE event_type = 'purchase'), f AS (SELECT item, count(*) AS n FROM p GROUP BY item),
c AS (SELECT quantile_cont(n, 0.5) AS torso, quantile_cont(n, 0.8) AS head FROM f), m AS (SELECT u.q, coalesce(max(n), 0) AS frequency FROM (SELECT DISTINCT user_id AS q FROM events) u LEFT JOIN p USING (q) LEFT JOIN f USING (item) GROUP BY u.q)
SELECT q, frequency, CASE WHEN frequency >= head THEN 'head' WHEN frequency >= torso THEN 'torso' ELSE 'tail' END AS bucket FROM m, c"""
)
def positive_frequency_buckets(spark, sf_dir):
    """Users by the most frequent of their positives; the cuts are quantiles of the items' frequencies."""
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select(F.col("user_id").alias("q"), F.get_json_object("props", "$.k").cast("long").alias("item")).distinct()
    f = p.groupBy("item").agg(F.count("*").alias("n"))
    cuts = ordering.linear_quantiles(f, "n", {"torso": 0.5, "head": 0.8})
    most = p.join(f, "item").groupBy("q").agg(F.max("n").alias("frequency"))
    every = e.select(F.col("user_id").alias("q")).distinct().join(most, "q", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("long")))
    bucket = F.when(F.col("frequency") >= F.col("head"), "head").when(F.col("frequency") >= F.col("torso"), "torso").otherwise("tail")
    return every.crossJoin(F.broadcast(cuts)).select("q", "frequency", bucket.alias("bucket"))  # one row of cuts


@query(
    f"""WITH {_TWO}, p AS (SELECT g, item, score FROM o WHERE other = 1), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank) AS k FROM o WHERE other > 3)
SELECT g, p.item AS positive, n.item AS negative, n.rank AS rank, n.other AS teacher_rank, round(p.score - n.score, 6) AS margin FROM p JOIN n USING (g) WHERE k <= 3"""
)
def hard_pool(spark, sf_dir):
    """The teacher's first against the three first by the other ranking of what the teacher puts below its third."""
    a, b = _two(spark, sf_dir)
    both = a.join(b.withColumnRenamed("rank", "teacher_rank"), ["g", "item"]).join(listed(spark, sf_dir).select("g", "item", "score"), ["g", "item"])
    positive = both.where("teacher_rank = 1").select("g", F.col("item").alias("positive"), F.col("score").alias("top"))
    negative = ordering.top_within(both.where("teacher_rank > 3"), ["g"], ["rank"], 3, "k")
    out = positive.join(negative, "g").select("g", "positive", F.col("item").alias("negative"), "rank", "teacher_rank", (F.col("top") - F.col("score")).alias("margin"))
    return _r(out, "margin", digits=6)


@query(
    f"""WITH {_P}, y AS (SELECT probability, label >= 2 AS y FROM p), b AS (SELECT least(floor(probability * 15), 14) AS bin, count(*) AS n, avg(probability) AS c, avg(y::INT) AS a FROM y GROUP BY 1)
SELECT round((SELECT sum(n * abs(c - a)) / sum(n) FROM b), 7) AS ece, round(-avg(CASE WHEN y THEN ln(greatest(1e-7, least(1 - 1e-7, probability))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, probability))) END), 7) AS log_loss,
round(avg(pow(probability - y::INT, 2)), 7) AS brier FROM y"""
)
def graded_calibration(spark, sf_dir):
    """Only the highest grade counts as positive; rows without a grade are negative."""
    high = F.when(F.coalesce(F.col("label"), F.lit(0.0)) >= 2, 1.0).otherwise(0.0)
    p = probabilities(spark, sf_dir).withColumn("label", high)
    return _r(calibration.calibration_error(p).crossJoin(calibration.proper_scores(p)), "ece", "log_loss", "brier")


_X3 = "CASE v WHEN 'a' THEN score WHEN 'b' THEN (item % 17)::DOUBLE ELSE (item % 5)::DOUBLE END"


@query(
    f"""WITH {_L}, e AS (SELECT g, item, v, {_X3} AS x FROM l, (SELECT unnest(['a', 'b', 'c']) AS v)),
z AS (SELECT *, CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z, row_number() OVER (PARTITION BY g, v ORDER BY x DESC, item) AS raw FROM e WINDOW w AS (PARTITION BY g, v)),
h AS (SELECT a.g, a.v, a.item, a.raw, row_number() OVER (PARTITION BY a.g, a.v ORDER BY round(avg(b.z), 9) DESC, a.item) AS rest FROM z a JOIN z b ON a.g = b.g AND a.item = b.item AND a.v <> b.v GROUP BY a.g, a.v, a.item, a.raw)
SELECT x.g, x.v AS variant, round(2.0 * count(*) FILTER (WHERE (x.raw < y.raw) = (x.rest < y.rest)) / count(*) - 1, 7) AS tau FROM h x JOIN h y ON x.g = y.g AND x.v = y.v AND x.item < y.item GROUP BY x.g, x.v"""
)
def leave_one_variant_out(spark, sf_dir):
    """Kendall's tau between each variant's order and that of the mean z-score of the other variants."""
    made = (("a", F.col("score")), ("b", (F.col("item") % 17).cast("double")), ("c", (F.col("item") % 5).cast("double")))
    rows = listed(spark, sf_dir).select("g", "item", F.explode(F.array(*[F.struct(F.lit(n).alias("v"), x.alias("x")) for n, x in made])).alias("e")).select(F.struct("g", "e.v").alias("gv"), "item", "e.x")
    z = ordering.rank_within(calibration.z_scores(rows, "gv", "x", "z"), ["gv"], [F.desc("x"), "item"], "rank")
    total = z.groupBy(F.col("gv.g").alias("g"), "item").agg(F.sum("z").alias("total"))
    rest = z.withColumn("g", F.col("gv.g")).join(total, ["g", "item"]).withColumn("rest", F.round((F.col("total") - F.col("z")) / (len(made) - 1), 9))
    held = ordering.rank_within(rest.select("gv", "item", "rest"), ["gv"], [F.desc("rest"), "item"])
    return _r(ranking.pair_agreement(held, z, "gv", "item").where("pairs > 0").select("gv.g", F.col("gv.v").alias("variant"), "tau"), "tau")


@query(
    r"""WITH l AS (SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 13 = 5 THEN 3 ELSE 2 END AS fields, trim(regexp_replace(text, '\s+', ' ', 'g')) = '' AS blank FROM benchmark
UNION ALL SELECT item_id::VARCHAR, 2, false FROM benchmark WHERE item_id % 17 = 0)
SELECT count(*) AS lines, count(*) FILTER (WHERE fields <> 2) AS malformed, count(*) - count(DISTINCT id) AS repeated_ids, count(*) FILTER (WHERE blank AND fields = 2) AS blank_text FROM l"""
)
def query_file_faults(spark, sf_dir):
    """Id and text lines with faults, written as gz text and checked when read: an extra field, a repeated id."""
    path = scratch(spark)
    b = table(spark, sf_dir, "benchmark").select("item_id", text.squeeze(F.col("text")).alias("t"))
    line = F.concat_ws("\t", F.col("item_id").cast("string"), "t", F.when(F.col("item_id") % 13 == 5, F.lit("more")))
    again = b.where("item_id % 17 = 0").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.lit("again")).alias("value"))
    b.select(line.alias("value")).unionByName(again).write.option("compression", "gzip").text(path)
    return contracts.source_faults(spark.read.text(path), 2)


@query("SELECT event_id, 'log' AS origin, NULL::VARCHAR AS note FROM events")
def constant_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.lit("log").alias("origin"), F.lit(None).cast("string").alias("note"))
