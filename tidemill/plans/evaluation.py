"""Queries on ranking metrics, calibration, inference and pairwise preferences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import calibration, contracts, ordering, pairwise, ranking, stats
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


def scored(spark, sf_dir: str) -> DataFrame:
    """Groups of scored rows: a user's events, scored by value; purchases are relevant, clicks half."""
    label = F.when(F.col("event_type") == "purchase", 2.0).when(F.col("event_type") == "click", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("item"), F.col("value").alias("score"), label.alias("label"))


def listed(spark, sf_dir: str) -> DataFrame:
    """The ten best of each group: bounded lists."""
    return ordering.top_within(scored(spark, sf_dir), ["g"], [F.desc("score"), "item"], 10)


def probabilities(spark, sf_dir: str) -> DataFrame:
    p = calibration.sigmoid(calibration.logit_clip((F.col("score") - 50) / 25))
    return scored(spark, sf_dir).withColumn("probability", p)


_S = "s AS (SELECT user_id AS g, event_id AS item, value AS score, CASE event_type WHEN 'purchase' THEN 2.0::DOUBLE WHEN 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM events)"
_R = _S + """,
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, item) AS rank, row_number() OVER (PARTITION BY g ORDER BY label DESC, item) AS ideal FROM s)"""
_L = _S + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 10)"
_P = _S + ", p AS (SELECT *, 1 / (1 + exp(-greatest(-20, least(20, (score - 50) / 25)))) AS probability FROM s)"


def _metrics(k: int, gain: str) -> str:
    return f"""SELECT g, count(*) AS n, count(*) FILTER (WHERE label > 0) AS relevant, coalesce(1.0 / min(rank) FILTER (WHERE label > 0), 0) AS mrr,
 CASE WHEN count(*) FILTER (WHERE label > 0) > 0 THEN count(*) FILTER (WHERE label > 0 AND rank <= {k}) / count(*) FILTER (WHERE label > 0) ELSE 0 END AS recall,
 CASE WHEN count(*) FILTER (WHERE label > 0 AND rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END AS hit,
 coalesce(sum({gain} / log2(rank + 1)) FILTER (WHERE rank <= {k}) / nullif(sum({gain} / log2(ideal + 1)) FILTER (WHERE ideal <= {k}), 0), 0) AS ndcg FROM r GROUP BY g"""


def _rounded(df: DataFrame, *names: str, digits: int = 7) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


@query(f"WITH {_R} SELECT g, n, relevant, round(mrr::DOUBLE, 7) AS mrr, round(recall::DOUBLE, 7) AS recall, hit::DOUBLE AS hit, round(ndcg::DOUBLE, 7) AS ndcg FROM ({_metrics(10, '(pow(2, label) - 1)')})")
def ranking_metrics_exponential(spark, sf_dir):
    return _rounded(ranking.per_group(scored(spark, sf_dir), "g", "item", 10), "mrr", "recall", "ndcg")


@query(f"WITH {_R} SELECT g, round(mrr::DOUBLE, 7) AS mrr, round(recall::DOUBLE, 7) AS recall, round(ndcg::DOUBLE, 7) AS ndcg FROM ({_metrics(5, 'label')})")
def ranking_metrics_linear(spark, sf_dir):
    return _rounded(ranking.per_group(scored(spark, sf_dir), "g", "item", 5, "linear"), "mrr", "recall", "ndcg").select("g", "mrr", "recall", "ndcg")


@query(
    f"WITH {_R}, m AS ({_metrics(10, 'label')}) SELECT count(*) AS groups, round(avg(mrr), 7) AS macro_mrr, round(avg(ndcg), 7) AS macro_ndcg, round(sum(ndcg * n) / sum(n), 7) AS weighted_ndcg, round(avg(hit), 7) AS hit_rate FROM m"
)
def macro_metrics(spark, sf_dir):
    m = ranking.per_group(scored(spark, sf_dir), "g", "item", 10, "linear")
    out = m.agg(F.count("*").alias("groups"), F.avg("mrr").alias("macro_mrr"), F.avg("ndcg").alias("macro_ndcg"), (F.sum(F.col("ndcg") * F.col("n")) / F.sum("n")).alias("weighted_ndcg"), F.avg("hit").alias("hit_rate"))
    return _rounded(out, "macro_mrr", "macro_ndcg", "weighted_ndcg", "hit_rate")


@query(
    f"""WITH {_R}, j AS (SELECT g, item, label AS grade FROM s WHERE item % 3 <> 0), pool AS (SELECT g, item, score FROM s WHERE item % 2 = 0),
pr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, item) AS k FROM pool),
d AS (SELECT pr.g, sum(coalesce(grade, 0) / log2(k + 1)) AS dcg FROM pr LEFT JOIN j USING (g, item) WHERE k <= 10 GROUP BY pr.g),
i AS (SELECT g, sum(grade / log2(k + 1)) AS idcg FROM (SELECT g, grade, row_number() OVER (PARTITION BY g ORDER BY grade DESC, item) AS k FROM j WHERE grade > 0) WHERE k <= 10 GROUP BY g)
SELECT g, round(coalesce(dcg / idcg, 0), 7) AS ndcg FROM d LEFT JOIN i USING (g)"""
)
def ndcg_complete_judgements(spark, sf_dir):
    s = scored(spark, sf_dir)
    judged = s.where("item % 3 <> 0").select("g", "item", F.col("label").alias("grade"))
    return _rounded(ranking.ndcg_against_judgements(s.where("item % 2 = 0"), judged, "g", "item", 10), "ndcg")


@query(
    f"""WITH {_R} SELECT CASE WHEN g % 3 = 0 THEN 'head' WHEN g % 3 = 1 THEN 'torso' ELSE 'tail' END AS bucket, count(*) AS targets,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 7) AS hit, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 7) AS ndcg FROM r WHERE ideal = 1 GROUP BY ALL"""
)
def single_target_by_bucket(spark, sf_dir):
    r = ranking.ranked(scored(spark, sf_dir), "g", "item")
    target = r.withColumn("ideal", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("label"), "item"))).where("ideal = 1")
    bucket = F.when(F.col("g") % 3 == 0, "head").when(F.col("g") % 3 == 1, "torso").otherwise("tail")
    top = F.col("rank") <= 10
    out = target.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("targets"), F.avg(F.when(top, 1.0).otherwise(0.0)).alias("hit"), F.avg(F.when(top, ranking.discount(F.col("rank"))).otherwise(0.0)).alias("ndcg"))
    return _rounded(out, "hit", "ndcg")


@query(
    f"""WITH {_R}, b AS (SELECT *, CASE item % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'torso' ELSE 'tail' END AS bucket FROM r WHERE rank <= 10)
SELECT bucket, round(count(*) / (SELECT count(*) FROM b), 7) AS exposure FROM b GROUP BY bucket"""
)
def popularity_exposure(spark, sf_dir):
    top = listed(spark, sf_dir)
    bucket = F.when(F.col("item") % 3 == 0, "head").when(F.col("item") % 3 == 1, "torso").otherwise("tail")
    counts = top.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("t")))).select("bucket", F.round(F.col("c") / F.col("t"), 7).alias("exposure"))


_AUC = """x AS (SELECT g, label > 0 AS y, score FROM s), k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS rk FROM x),
a AS (SELECT g, count(*) AS n, CASE WHEN sum(y::INT) BETWEEN 1 AND count(*) - 1 THEN (sum(rk) FILTER (WHERE y) - sum(y::INT) * (sum(y::INT) + 1) / 2.0) / (sum(y::INT) * (count(*) - sum(y::INT))) END AS auc FROM k GROUP BY g)"""


@query(f"WITH {_S}, {_AUC} SELECT g, n, round(auc::DOUBLE, 7) AS auc FROM a")
def auc_by_group(spark, sf_dir):
    return _rounded(ranking.auc(scored(spark, sf_dir), ["g"]), "auc")


@query(f"WITH {_S}, {_AUC} SELECT round((sum(auc * n) / sum(n))::DOUBLE, 7) AS gauc, count(*) AS groups FROM a WHERE auc IS NOT NULL")
def grouped_auc(spark, sf_dir):
    return _rounded(ranking.group_auc(scored(spark, sf_dir), "g"), "gauc")


@query(
    f"""WITH {_P}, b AS (SELECT least(floor(probability * 15), 14)::BIGINT AS bin, count(*) AS n, avg(probability) AS c, avg((label > 0)::INT) AS a FROM p GROUP BY 1)
SELECT k AS bin, coalesce(n, 0) AS n, round(coalesce(c, 0), 7) AS confidence, round(coalesce(a, 0), 7) AS accuracy FROM range(15) t(k) LEFT JOIN b ON b.bin = k"""
)
def reliability_bins(spark, sf_dir):
    return _rounded(calibration.reliability(probabilities(spark, sf_dir)), "confidence", "accuracy")


@query(
    f"""WITH {_P}, b AS (SELECT least(floor(probability * 15), 14) AS bin, count(*) AS n, avg(probability) AS c, avg((label > 0)::INT) AS a FROM p GROUP BY 1)
SELECT round((SELECT sum(n * abs(c - a)) / sum(n) FROM b), 7) AS ece, round(-avg(CASE WHEN label > 0 THEN ln(greatest(1e-7, least(1 - 1e-7, probability))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, probability))) END), 7) AS log_loss,
round(avg(pow(probability - (label > 0)::INT, 2)), 7) AS brier FROM p"""
)
def calibration_scores(spark, sf_dir):
    p = probabilities(spark, sf_dir)
    return _rounded(calibration.calibration_error(p).crossJoin(calibration.proper_scores(p)), "ece", "log_loss", "brier")


_E = """m AS (SELECT *, max(score / 10) OVER (PARTITION BY g) AS mx FROM l), e AS (SELECT *, exp(score / 10 - mx) AS ex FROM m), f AS (SELECT *, ex / sum(ex) OVER (PARTITION BY g) AS share FROM e)"""


@query(
    f"WITH {_L}, {_E} SELECT g, round(sum(-share * ln(share)) FILTER (WHERE share > 0), 7) AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-share * ln(share)) FILTER (WHERE share > 0) / ln(count(*)) ELSE 0 END, 7) AS normalized FROM f GROUP BY g"
)
def softmax_entropy(spark, sf_dir):
    return _rounded(calibration.entropy(listed(spark, sf_dir), "g", temperature=10.0), "entropy", "normalized")


@query(
    f"""WITH {_L}, {_E}, t AS (SELECT share, label > 0 AS y FROM f WHERE rank = 1), b AS (SELECT least(floor(share * 10), 9) AS bin, count(*) AS n, avg(share) AS c, avg(y::INT) AS a FROM t GROUP BY 1)
SELECT round((SELECT sum(n * abs(c - a)) / sum(n) FROM b), 7) AS ece, round(avg(pow(share - y::INT, 2)), 7) AS brier FROM t"""
)
def top_confidence_calibration(spark, sf_dir):
    top = calibration.softmax(listed(spark, sf_dir), "g", temperature=10.0).where("rank = 1").withColumn("probability", F.col("share"))
    return _rounded(calibration.calibration_error(top, 10).crossJoin(calibration.proper_scores(top).select("brier")), "ece", "brier")


@query(
    f"""WITH {_S}, z AS (SELECT g, item, CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END AS z,
 row_number() OVER (PARTITION BY g ORDER BY score DESC, item) AS r, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY g))
SELECT g, item, round(z, 6) AS z, round(CASE WHEN n > 1 THEN 1 - (r - 1) / (n - 1) ELSE 1 END::DOUBLE, 7) AS normalized_rank FROM z"""
)
def normalized_scores(spark, sf_dir):
    z = ranking.ranked(calibration.z_scores(scored(spark, sf_dir), "g", "score", "z"), "g", "item").withColumn("n", F.count("*").over(Window.partitionBy("g")))
    return z.select("g", "item", F.round("z", 6).alias("z"), F.round(F.when(F.col("n") > 1, 1 - (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(1.0), 7).alias("normalized_rank"))


@query(
    f"""WITH {_L}, v AS (SELECT g, max(score) FILTER (WHERE rank=1) AS a, max(score) FILTER (WHERE rank=2) AS b, max(score) FILTER (WHERE rank=3) AS c, max(score) FILTER (WHERE rank=5) AS e, min(score) AS lo FROM l GROUP BY g)
SELECT g, round(coalesce(a - b, 0), 7) AS margin, round(a - coalesce(c, b, a), 7) AS gap3, round(a - coalesce(e, lo), 7) AS gap5, round(1 / (1 + greatest(coalesce(a - b, 0), 0)), 7) AS uncertainty FROM v"""
)
def score_margins(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    v = listed(spark, sf_dir).groupBy("g").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"), at(5).alias("e"), F.min("score").alias("lo"))
    margin = F.coalesce(F.col("a") - F.col("b"), F.lit(0.0))
    out = v.select("g", margin.alias("margin"), (F.col("a") - F.coalesce("c", "b", "a")).alias("gap3"), (F.col("a") - F.coalesce("e", "lo")).alias("gap5"), (1 / (1 + F.greatest(margin, F.lit(0.0)))).alias("uncertainty"))
    return _rounded(out, "margin", "gap3", "gap5", "uncertainty")


_TWO = _L + ", o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(item::VARCHAR)) AS other FROM l)"


def _two(spark, sf_dir):
    a = listed(spark, sf_dir)
    b = ordering.rank_within(a.drop("rank"), ["g"], [F.md5(F.col("item").cast("string"))])
    return a.select("g", "item", "rank"), b.select("g", "item", "rank")


@query(
    f"""WITH {_TWO} SELECT g, pairs, round(same / nullif(pairs, 0), 7) AS agreement, round(2 * same / nullif(pairs, 0) - 1, 7) AS tau FROM (
SELECT g, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs, (SELECT count(*) FROM o x JOIN o y ON x.g = y.g AND x.rank < y.rank AND x.other < y.other WHERE x.g = o.g) AS same FROM o GROUP BY g)"""
)
def rank_agreement(spark, sf_dir):
    return _rounded(ranking.pair_agreement(*_two(spark, sf_dir), "g", "item"), "agreement", "tau")


@query(
    f"WITH {_TWO} SELECT g, round(avg((abs(rank - other) <= 2)::INT), 7) AS stable, max(abs(rank - other)) > 0 AS order_changed, max(abs(rank - other))::BIGINT AS max_shift FROM o GROUP BY g"
)
def position_stability(spark, sf_dir):
    return _rounded(ranking.position_stability(*_two(spark, sf_dir), "g", "item"), "stable")


@query(
    f"""WITH {_TWO}, t AS (SELECT g, list(item ORDER BY rank) FILTER (WHERE rank <= 5) AS a, list(item ORDER BY other) FILTER (WHERE other <= 5) AS b FROM o GROUP BY g)
SELECT g, len(list_intersect(a, b))::BIGINT AS overlap, list_sort(a) = list_sort(b) AS same_members, a = b AS same_order, len(list_distinct(list_concat(a, b)))::BIGINT AS union_size FROM t"""
)
def top_overlap(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    top = lambda r: r.where("rank <= 5").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))
    j = top(a).select("g", F.col("x.item").alias("a")).join(top(b).select("g", F.col("x.item").alias("b")), "g")
    return j.select("g", F.size(F.array_intersect("a", "b")).cast("long").alias("overlap"), (F.array_sort("a") == F.array_sort("b")).alias("same_members"), (F.col("a") == F.col("b")).alias("same_order"), F.size(F.array_union("a", "b")).cast("long").alias("union_size"))


_RESP = _L + """,
q AS (SELECT x.g, x.item AS first, y.item AS second, ('0x' || substr(md5(x.item || '>' || y.item), 1, 2))::INT AS h, x.score - y.score AS d FROM l x JOIN l y ON x.g = y.g AND x.item <> y.item WHERE x.rank <= 6 AND y.rank <= 6),
resp AS (SELECT g, first, second, CASE WHEN h < 40 THEN 'tie' WHEN (d > 0) = (h < 220) THEN 'first' ELSE 'second' END AS choice FROM q),
pick AS (SELECT g, first, second, CASE choice WHEN 'first' THEN first WHEN 'second' THEN second END AS p FROM resp),
pairs AS (SELECT a.g, a.first AS left, a.second AS right, CASE WHEN a.p = b.p THEN a.p END AS winner, coalesce(a.p = b.p, a.p IS NULL AND b.p IS NULL) AS swap_agree, coalesce(a.p = b.p, false) AS strict_agree
  FROM pick a JOIN pick b ON a.g = b.g AND a.first = b.second AND a.second = b.first WHERE a.first < a.second)"""


def responses(spark, sf_dir) -> DataFrame:
    """A deterministic comparator over ordered pairs of each group's six best, with ties and position noise by hash."""
    top = listed(spark, sf_dir).where("rank <= 6")
    pairs = pairwise.all_pairs(top, "g", "item", "rank", both_ways=True)
    s = top.select("g", "item", "score")
    j = pairs.join(s.select("g", F.col("item").alias("first"), F.col("score").alias("a")), ["g", "first"]).join(s.select("g", F.col("item").alias("second"), F.col("score").alias("b")), ["g", "second"])
    h = F.conv(F.substring(F.md5(F.concat(F.col("first").cast("string"), F.lit(">"), F.col("second").cast("string"))), 1, 2), 16, 10).cast("int")
    choice = F.when(h < 40, "tie").when((F.col("a") > F.col("b")) == (h < 220), "first").otherwise("second")
    return j.select("g", "first", "second", choice.alias("choice"))


def decided(spark, sf_dir, ties_agree: bool = True) -> DataFrame:
    return pairwise.consensus(responses(spark, sf_dir), "g", ties_agree)


@query(f'WITH {_RESP} SELECT g, "left", "right", winner, swap_agree FROM pairs')
def pair_consensus(spark, sf_dir):
    return decided(spark, sf_dir)


@query(f'WITH {_RESP} SELECT g, "left", "right", winner, strict_agree AS swap_agree FROM pairs')
def pair_consensus_strict(spark, sf_dir):
    return decided(spark, sf_dir, False)


@query(
    f"""WITH {_RESP} SELECT g, item, sum(p)::DOUBLE AS points FROM (SELECT g, "left" AS item, CASE WHEN winner IS NULL THEN 0.5 WHEN winner = "left" THEN 1 ELSE 0 END AS p FROM pairs
UNION ALL SELECT g, "right", CASE WHEN winner IS NULL THEN 0.5 WHEN winner = "right" THEN 1 ELSE 0 END FROM pairs) GROUP BY g, item"""
)
def borda_points(spark, sf_dir):
    return pairwise.borda(decided(spark, sf_dir), "g")


@query(
    f"""WITH {_RESP}, w AS (SELECT g, "left" AS a, "right" AS b, winner = "left" AS l FROM pairs WHERE winner IS NOT NULL)
SELECT x.g, count(*) AS triples, count(*) FILTER (WHERE x.l = y.l AND x.l <> z.l) AS cycles FROM w x JOIN w y ON x.g = y.g AND x.b = y.a JOIN w z ON z.g = x.g AND z.a = x.a AND z.b = y.b GROUP BY x.g"""
)
def preference_cycles(spark, sf_dir):
    return pairwise.cycles(decided(spark, sf_dir), "g")


@query(
    f"""WITH {_RESP}, j AS (SELECT p.*, a.label AS l, b.label AS r FROM pairs p JOIN l a ON a.g = p.g AND a.item = p."left" JOIN l b ON b.g = p.g AND b.item = p."right"),
k AS (SELECT *, CASE WHEN l > r THEN "left" WHEN l < r THEN "right" END AS better FROM j)
SELECT g, count(*) AS pairs, round(avg(swap_agree::INT), 7) AS agree, round(avg((winner IS NULL)::INT), 7) AS ties, round(avg((winner = better)::INT) FILTER (WHERE better IS NOT NULL AND winner IS NOT NULL), 7) AS accuracy,
round(avg(CASE WHEN winner IS NULL THEN 0.5 ELSE (winner = better)::INT END) FILTER (WHERE better IS NOT NULL), 7) AS credit FROM k GROUP BY g"""
)
def pair_diagnostics(spark, sf_dir):
    relevance = listed(spark, sf_dir).select("g", "item", F.col("label").alias("relevance"))
    return _rounded(pairwise.diagnostics(decided(spark, sf_dir), relevance, "g"), "agree", "ties", "accuracy", "credit")


@query()
def sliding_ranking(spark, sf_dir):
    """Order-dependent passes; tests compare with a plain loop."""
    c = listed(spark, sf_dir).where("rank <= 6").select("g", "item", F.col("rank").alias("position"))
    return pairwise.sliding(c, decided(spark, sf_dir), "g", 2)


@query(
    f"""WITH {_L} SELECT a.g, count(*) AS pairs, round(avg(greatest(b.score - a.score, 0) + ln(1 + exp(-abs(b.score - a.score)))), 6) AS loss FROM l a JOIN l b ON a.g = b.g AND a.label > b.label GROUP BY a.g"""
)
def ranknet_loss(spark, sf_dir):
    return _rounded(pairwise.ranknet(listed(spark, sf_dir), "g", "item"), "loss", digits=6)


@query(
    f"""WITH {_L}, z AS (SELECT *, max(score / 10) OVER (PARTITION BY g) AS ms, max(label) OVER (PARTITION BY g) AS ml FROM l),
w AS (SELECT *, exp(score / 10 - ms) / sum(exp(score / 10 - ms)) OVER (PARTITION BY g) AS q, exp(label - ml) / sum(exp(label - ml)) OVER (PARTITION BY g) AS p FROM z)
SELECT g, round(sum(p * (ln(p) - ln(q))), 6) AS divergence FROM w GROUP BY g"""
)
def listwise_divergence(spark, sf_dir):
    both = calibration.softmax(calibration.softmax(listed(spark, sf_dir), "g", "score", 10.0, "q"), "g", "label", 1.0, "p")
    return both.groupBy("g").agg(F.round(F.sum(F.col("p") * (F.log("p") - F.log("q"))), 6).alias("divergence"))


_D = """d AS (SELECT o_custkey AS key, avg(o_totalprice) / 1000 - 250 AS diff, count(*) AS n FROM orders GROUP BY o_custkey)"""


@query(
    f"""WITH {_D}, x AS (SELECT key, diff, r, ('0x' || substr(md5('7:' || r || ':' || key), 1, 12))::BIGINT / 281474976710656.0 AS u FROM d, range(50) t(r)),
w AS (SELECT *, CASE WHEN u >= 0.9999897508033253 THEN 8 WHEN u >= 0.9999167588507119 THEN 7 WHEN u >= 0.9994058151824183 THEN 6 WHEN u >= 0.9963401531726563 THEN 5 WHEN u >= 0.9810118431238462 THEN 4 WHEN u >= 0.9196986029286058 THEN 3
 WHEN u >= 0.7357588823428847 THEN 2 WHEN u >= 0.36787944117144233 THEN 1 ELSE 0 END AS w FROM x)
SELECT r AS replicate, sum(w)::BIGINT AS n, round(sum(w * diff) / sum(w), 6) AS mean_diff FROM w GROUP BY r"""
)
def bootstrap_replicates(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg((F.avg("o_totalprice") / 1000 - 250).alias("diff"))
    return _rounded(stats.hash_bootstrap(d, "key", ["diff"], 50), "mean_diff", digits=6).withColumn("n", F.col("n").cast("long"))


@query()
def paired_bootstrap(spark, sf_dir):
    """Multinomial resampling with a fixed seed; tests compare with the normal interval."""
    m = ranking.per_group(scored(spark, sf_dir), "g", "item", 10, "linear").select((F.col("ndcg") - 0.5).alias("ndcg_gain"), (F.col("mrr") - 0.5).alias("mrr_gain"))
    return stats.paired_bootstrap(m, ["ndcg_gain", "mrr_gain"])


@query(
    """WITH a AS (SELECT count(*) AS n, count(*) FILTER (WHERE ('0x' || substr(sha256('ab:' || o_orderkey), 1, 2))::INT < 128) AS t FROM orders)
SELECT n, t AS treatment, round(z, 6) AS z,
round(1 - 2 / sqrt(2 * pi()) * abs(z) / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(abs(z) * i / 2000, 2) / 2))), 6) AS p_value
FROM (SELECT *, (t - n * 0.5) / sqrt(n * 0.25) AS z FROM a)"""
)
def sample_ratio_mismatch(spark, sf_dir):
    from ..functions.hashing import arm

    rows = table(spark, sf_dir, "orders")
    return _rounded(stats.sample_ratio(rows, arm(F.col("o_orderkey"), "ab:") == "treatment"), "z", "p_value", digits=6)


@query(
    """WITH a AS (SELECT o_orderpriority AS bucket, ('0x' || substr(sha256('ab:' || o_orderkey), 1, 2))::INT < 128 AS t, o_totalprice AS y FROM orders)
SELECT bucket, count(*) AS n, round(avg(t::INT), 6) AS treated, round(avg(y) FILTER (WHERE t) - avg(y) FILTER (WHERE NOT t), 4) AS effect FROM a GROUP BY bucket"""
)
def arm_balance_and_effect(spark, sf_dir):
    from ..functions.hashing import arm

    t = arm(F.col("o_orderkey"), "ab:") == "treatment"
    rows = table(spark, sf_dir, "orders").withColumn("t", t)
    y = F.col("o_totalprice")
    return rows.groupBy(F.col("o_orderpriority").alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("t").cast("double")), 6).alias("treated"), F.round(F.avg(F.when(F.col("t"), y)) - F.avg(F.when(~F.col("t"), y)), 4).alias("effect")
    )


@query(
    """SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(avg(abs(l_quantity - 25)), 6) AS mae,
round(avg((l_discount > l_tax)::INT), 7) AS win, round(avg((abs(l_discount - l_tax) <= 1e-9)::INT), 7) AS tie, round(avg((l_discount < l_tax)::INT), 7) AS any_loss FROM lineitem GROUP BY ALL"""
)
def correlations_and_rates(spark, sf_dir):
    d = F.col("l_discount") - F.col("l_tax")
    rate = lambda c: F.round(F.avg(c.cast("double")), 7)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(calibration.correlation("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.round(F.avg(F.abs(F.col("l_quantity") - 25)), 6).alias("mae"),
        rate(d > 0).alias("win"), rate(F.abs(d) <= 1e-9).alias("tie"), rate(d < 0).alias("any_loss"),
    )


@query(
    """WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS b FROM c)
SELECT round(corr(a, b), 6) AS spearman FROM r"""
)
def spearman_correlation(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return _rounded(stats.spearman(c, "n", "s"), "spearman", digits=6)


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(stddev_samp(value), 6) AS sd_sample, min(value) AS low, round(quantile_cont(value, 0.01), 6) AS p01,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS high FROM events GROUP BY event_type"""
)
def value_profile(spark, sf_dir):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.stddev_samp("value"), 6).alias("sd_sample"), F.min("value").alias("low"),
        p(0.01).alias("p01"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("value").alias("high"),
    )


@query(
    f"""WITH {_P}, r0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, item) AS k FROM p), r AS (SELECT *, CASE WHEN g % 5 = 0 AND k % 3 = 0 THEN k + 1 ELSE k END AS rank FROM r0)
SELECT count(DISTINCT g) AS groups, (count(*) - count(DISTINCT (g, item)))::BIGINT AS repeated_items, count(*) FILTER (WHERE score IS NULL) AS bad_scores, count(*) FILTER (WHERE probability NOT BETWEEN 0 AND 1) AS bad_probabilities,
(SELECT count(*) FROM (SELECT g FROM r GROUP BY g HAVING min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*))) AS broken_ranks,
(SELECT count(*) FROM (SELECT g FROM r GROUP BY g HAVING count(*) <> 10)) AS wrong_sizes FROM r"""
)
def prediction_contract(spark, sf_dir):
    """Groups of other than ten items and every third rank moved by one are found as such."""
    rows = ranking.ranked(probabilities(spark, sf_dir), "g", "item")
    moved = F.when((F.col("g") % 5 == 0) & (F.col("rank") % 3 == 0), F.col("rank") + 1).otherwise(F.col("rank"))
    return contracts.prediction_violations(rows.withColumn("rank", moved), "g", "item", size=10)


@query(
    f"""WITH {_R}, m AS ({_metrics(10, 'label')}), b AS (SELECT *, CASE g % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'torso' ELSE 'tail' END AS bucket FROM m)
SELECT coalesce(bucket, 'overall') AS bucket, count(*) AS n, round(avg(ndcg), 7) AS ndcg, round(avg(mrr), 7) AS mrr FROM b GROUP BY GROUPING SETS ((bucket), ())"""
)
def bucket_report(spark, sf_dir):
    m = ranking.per_group(scored(spark, sf_dir), "g", "item", 10, "linear")
    bucket = F.when(F.col("g") % 3 == 0, "head").when(F.col("g") % 3 == 1, "torso").otherwise("tail")
    out = m.withColumn("bucket", bucket).rollup("bucket").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"))
    return _rounded(out.withColumn("bucket", F.coalesce("bucket", F.lit("overall"))), "ndcg", "mrr")


@query(
    f"""WITH {_R}, m AS ({_metrics(10, 'label')}), b AS (SELECT *, CASE g % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'torso' ELSE 'tail' END AS freq, CASE WHEN g % 5 = 0 THEN 'head' ELSE 'tail' END AS paper FROM m)
SELECT family, bucket, count(*) AS n, round(avg(recall), 7) AS recall FROM (UNPIVOT b ON freq, paper INTO NAME family VALUE bucket) GROUP BY ALL"""
)
def bucket_families(spark, sf_dir):
    m = ranking.per_group(scored(spark, sf_dir), "g", "item", 10, "linear")
    freq = F.when(F.col("g") % 3 == 0, "head").when(F.col("g") % 3 == 1, "torso").otherwise("tail")
    b = m.select("recall", freq.alias("freq"), F.when(F.col("g") % 5 == 0, "head").otherwise("tail").alias("paper"))
    return _rounded(b.unpivot("recall", ["freq", "paper"], "family", "bucket").groupBy("family", "bucket").agg(F.count("*").alias("n"), F.avg("recall").alias("recall")), "recall")
