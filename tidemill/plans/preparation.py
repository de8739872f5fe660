"""Queries on interaction preparation, buckets, splits and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import contracts, interactions, ordering
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


def log(spark, sf_dir: str) -> DataFrame:
    """The event log as interactions: items come from the JSON column."""
    rows = table(spark, sf_dir, "events").where("ts is not null")
    item = F.get_json_object("props", "$.k").cast("long")
    rows = rows.select(F.col("event_id").alias("review_id"), "user_id", item.alias("item_id"), F.col("ts").alias("event_time"), F.col("value").alias("stars"))
    return rows.where("user_id is not null and item_id is not null")


def split(spark, sf_dir: str) -> DataFrame:
    return interactions.leave_two_out(interactions.support_filter(log(spark, sf_dir), 3, 2))


_LOG = """log AS (SELECT event_id AS review_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts AS event_time, value AS stars
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL)"""
_KEPT = _LOG + """,
c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS nu, count(*) OVER (PARTITION BY item_id) AS ni FROM log),
r AS (SELECT * EXCLUDE (nu, ni), count(*) OVER (PARTITION BY user_id) AS nu2 FROM c WHERE nu >= 3 AND ni >= 2),
kept AS (SELECT * EXCLUDE (nu2) FROM r WHERE nu2 >= 3)"""
_SPLIT = _KEPT + """,
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, review_id) AS history_position, count(*) OVER (PARTITION BY user_id) AS history_length FROM kept),
split AS (SELECT *, CASE WHEN history_position = history_length THEN 'test' WHEN history_position = history_length - 1 THEN 'valid' ELSE 'train' END AS split FROM p)"""


def _dimension(key: str, index: str) -> str:
    return f"""b_{key} AS (SELECT {key}, count(*) AS interactions, count(*) FILTER (WHERE split = 'train') AS train_interactions,
  min(event_time) AS first_time, max(event_time) AS last_time FROM split GROUP BY {key}),
t_{key} AS (SELECT CAST(quantile_disc(train_interactions, 0.2) AS BIGINT) AS tail_max, CAST(quantile_disc(train_interactions, 0.8) AS BIGINT) AS head_min
  FROM b_{key} WHERE train_interactions > 0),
d_{key} AS (SELECT b.*, row_number() OVER (ORDER BY train_interactions DESC, {key}) AS frequency_rank, row_number() OVER (ORDER BY {key}) - 1 AS {index}, tail_max, head_min,
  CASE WHEN train_interactions = 0 THEN 'cold_start' WHEN tail_max >= head_min THEN 'torso' WHEN train_interactions <= tail_max THEN 'tail'
    WHEN train_interactions >= head_min THEN 'head' ELSE 'torso' END AS frequency_bucket,
  CASE WHEN train_interactions = 0 THEN 'cold_start' WHEN row_number() OVER (ORDER BY train_interactions DESC, {key}) <= ceil(count(*) OVER () * 0.2) THEN 'head' ELSE 'tail' END AS paper_bucket
  FROM b_{key} b, t_{key})"""


@query(f"WITH {_LOG} SELECT review_id, user_id, item_id, event_time, stars FROM log WHERE event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND stars > 10")
def interaction_log(spark, sf_dir):
    rows = log(spark, sf_dir)
    return rows.where((F.col("event_time") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("event_time") <= F.lit("2024-01-25").cast("timestamp_ntz")) & (F.col("stars") > 10))


@query(f"WITH {_KEPT} SELECT review_id, user_id, item_id, event_time, stars FROM kept")
def support_filter(spark, sf_dir):
    return interactions.support_filter(log(spark, sf_dir), 3, 2)


@query(f"WITH {_SPLIT} SELECT review_id, user_id, item_id, event_time, stars, history_position, history_length, split FROM split")
def leave_two_out(spark, sf_dir):
    return split(spark, sf_dir)


@query(
    f"""WITH {_LOG}, f AS (SELECT * REPLACE (user_id * 1000 + item_id AS user_id) FROM log),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, review_id) AS history_position, count(*) OVER (PARTITION BY user_id) AS history_length FROM f)
SELECT review_id, user_id, history_position, history_length, CASE WHEN history_length < 3 THEN 'train' WHEN history_position = history_length THEN 'test'
  WHEN history_position = history_length - 1 THEN 'valid' ELSE 'train' END AS split FROM p"""
)
def short_history_split(spark, sf_dir):
    """Histories of one user with one item: many are shorter than three."""
    rows = log(spark, sf_dir).withColumn("user_id", F.col("user_id") * 1000 + F.col("item_id"))
    return interactions.leave_two_out(rows, short_to_train=True).select("review_id", "user_id", "history_position", "history_length", "split")


@query(f"WITH {_SPLIT}, {_dimension('user_id', 'user_idx')} SELECT * FROM d_user_id")
def user_dimension(spark, sf_dir):
    return interactions.entity_dimension(split(spark, sf_dir), "user_id", "user_idx")


@query(f"WITH {_SPLIT}, {_dimension('item_id', 'item_idx')} SELECT * FROM d_item_id")
def item_dimension(spark, sf_dir):
    return interactions.entity_dimension(split(spark, sf_dir), "item_id", "item_idx")


@query(
    f"""WITH {_SPLIT}, {_dimension('user_id', 'user_idx')}, {_dimension('item_id', 'item_idx')}
SELECT review_id, s.user_id, s.item_id, split, user_idx, item_idx, u.frequency_bucket AS user_bucket, i.frequency_bucket AS item_bucket, i.train_interactions = 0 AS item_is_cold_start
FROM split s JOIN d_user_id u USING (user_id) JOIN d_item_id i USING (item_id)"""
)
def enriched_interactions(spark, sf_dir):
    s = split(spark, sf_dir)
    out = interactions.enrich(s, interactions.entity_dimension(s, "user_id", "user_idx"), interactions.entity_dimension(s, "item_id", "item_idx"))
    return out.select("review_id", "user_id", "item_id", "split", "user_idx", "item_idx", "user_bucket", "item_bucket", "item_is_cold_start")


@query(
    f"""WITH {_SPLIT} SELECT user_id, list(item_id ORDER BY history_position) FILTER (WHERE split = 'train') AS train_item_ids,
list(CAST(epoch(event_time) AS BIGINT) ORDER BY history_position) FILTER (WHERE split = 'train') AS train_seconds,
max(item_id) FILTER (WHERE split = 'valid') AS valid_item_id, max(item_id) FILTER (WHERE split = 'test') AS test_item_id, count(*) FILTER (WHERE split = 'train') AS train_length
FROM split GROUP BY user_id"""
)
def user_sequences(spark, sf_dir):
    return interactions.sequences(split(spark, sf_dir))


@query(
    f"""WITH {_SPLIT}, l AS (SELECT user_id, list(item_id ORDER BY history_position) FILTER (WHERE split = 'train') AS t, max(item_id) FILTER (WHERE split = 'valid') AS v FROM split GROUP BY user_id),
a AS (SELECT user_id, list_append(t, v) AS h FROM l)
SELECT user_id, list_concat(list_transform(range(greatest(10 - len(h), 0)), lambda x: CAST(0 AS BIGINT)), h[greatest(len(h) - 9, 1):len(h)]) AS padded FROM a"""
)
def padded_histories(spark, sf_dir):
    s = interactions.sequences(split(spark, sf_dir))
    return s.select("user_id", interactions.left_pad(F.array_append("train_item_ids", F.col("valid_item_id")), 10).alias("padded"))


@query(
    f"""WITH {_SPLIT}, u AS (SELECT user_id, count(*) n, count(*) FILTER (WHERE split='train') tr, count(*) FILTER (WHERE split='valid') va, count(*) FILTER (WHERE split='test') te,
 max(history_position) l, count(DISTINCT history_position) ps FROM split GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (WHERE va <> 1 OR te <> 1) AS wrong_holdout, count(*) FILTER (WHERE tr <> n - 2) AS wrong_train, count(*) FILTER (WHERE l <> n OR ps <> n) AS wrong_positions FROM u"""
)
def split_invariants(spark, sf_dir):
    return interactions.split_violations(split(spark, sf_dir))


@query(
    f"""WITH {_SPLIT} SELECT count(*) AS interactions, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) FILTER (WHERE split = 'train') AS train_rows,
count(DISTINCT item_id) FILTER (WHERE split = 'train') AS train_items, min(event_time) AS first_time, max(event_time) AS last_time, round(avg(stars), 6) AS mean_stars,
(SELECT count(*) FROM (SELECT user_id, item_id FROM split GROUP BY ALL HAVING count(*) > 1)) AS repeated_pairs FROM split"""
)
def audit_battery(spark, sf_dir):
    s = split(spark, sf_dir)
    train = F.col("split") == "train"
    repeated = contracts.duplicate_keys(s, ["user_id", "item_id"]).agg(F.count("*").alias("repeated_pairs"))
    return s.agg(
        F.count("*").alias("interactions"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count(F.when(train, 1)).alias("train_rows"),
        F.countDistinct(F.when(train, F.col("item_id"))).alias("train_items"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.round(F.avg("stars"), 6).alias("mean_stars"),
    ).crossJoin(repeated)


_COUNTS = "c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"


@query(
    f"""WITH {_COUNTS}, s AS (SELECT list_sort(list(n)) AS v FROM c),
q AS (SELECT v[CAST(round_even(0.2 * (len(v) - 1), 0) AS INT) + 1] AS lo, v[CAST(round_even(0.8 * (len(v) - 1), 0) AS INT) + 1] AS hi, v[CAST(ceil(0.9 * (len(v) - 1)) AS INT) + 1] AS higher FROM s)
SELECT o_custkey, n, lo AS tail_max, hi AS head_min, higher, CASE WHEN lo >= hi THEN 'torso' WHEN n <= lo THEN 'tail' WHEN n >= hi THEN 'head' ELSE 'torso' END AS bucket FROM c, q"""
)
def fitted_buckets(spark, sf_dir):
    """Nearest-rank thresholds fitted on all counts, frozen and applied; counts are few different values."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    hist = counts.groupBy("n").agg(F.count("*").alias("c"))  # a row per different count
    w = Window.orderBy("n")
    cumulated = hist.withColumn("upto", F.sum("c").over(w))
    total = hist.agg(F.sum("c").alias("t"))
    at = lambda q, rule: (F.bround(F.lit(q) * (F.col("t") - 1)) if rule == "nearest" else F.ceil(F.lit(q) * (F.col("t") - 1)))
    points = cumulated.crossJoin(F.broadcast(total))
    cuts = points.agg(*[F.min(F.when(F.col("upto") > at(q, r), F.col("n"))).alias(name) for q, r, name in ((0.2, "nearest", "tail_max"), (0.8, "nearest", "head_min"), (0.9, "higher", "higher"))])
    low, high = F.col("tail_max"), F.col("head_min")
    bucket = F.when(low >= high, "torso").when(F.col("n") <= low, "tail").when(F.col("n") >= high, "head").otherwise("torso")
    return counts.crossJoin(F.broadcast(cuts)).select("o_custkey", "n", "tail_max", "head_min", "higher", bucket.alias("bucket"))


@query(
    f"""WITH {_COUNTS}, r AS (SELECT *, row_number() OVER (ORDER BY n, o_custkey) AS r, count(*) OVER () AS t FROM c)
SELECT o_custkey, n, CASE WHEN r - 1 < floor(0.2 * t) THEN 'tail' WHEN r - 1 >= ceil(0.8 * t) THEN 'head' ELSE 'torso' END AS bucket,
CAST(CASE WHEN 3 * (r - 1) <= t - 1 THEN 1 WHEN 3 * (r - 1) <= 2 * (t - 1) THEN 2 ELSE 3 END AS BIGINT) AS tercile FROM r"""
)
def rank_share_buckets(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    ranked = ordering.global_rank(counts, ["n", "o_custkey"], "r").crossJoin(F.broadcast(counts.agg(F.count("*").alias("t"))))
    r0, t = F.col("r") - 1, F.col("t")
    bucket = F.when(r0 < F.floor(F.lit(0.2) * t), "tail").when(r0 >= F.ceil(F.lit(0.8) * t), "head").otherwise("torso")
    return ranked.select("o_custkey", "n", bucket.alias("bucket"), ordering.equal_frequency_bin(F.col("r"), t).alias("tercile"))


@query(
    """WITH e AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey), q AS (SELECT quantile_cont(spent, 0.33) AS a, quantile_cont(spent, 0.66) AS b FROM e)
SELECT c_custkey, round(coalesce(spent, 0), 2) AS spent, CASE WHEN spent IS NULL THEN 'tail' WHEN spent <= a THEN 'tail' WHEN spent <= b THEN 'torso' ELSE 'head' END AS bucket
FROM customer LEFT JOIN e ON o_custkey = c_custkey, q"""
)
def linear_quantile_buckets(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    cuts = ordering.linear_quantiles(spent, "spent", {"a": 0.33, "b": 0.66})
    rows = table(spark, sf_dir, "customer").join(spent, F.col("o_custkey") == F.col("c_custkey"), "left").crossJoin(F.broadcast(cuts))
    s = F.col("spent")
    return rows.select("c_custkey", F.round(F.coalesce(s, F.lit(0.0)), 2).alias("spent"), F.when(s.isNull() | (s <= F.col("a")), "tail").when(s <= F.col("b"), "torso").otherwise("head").alias("bucket"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount, 2) AS l_discount, CASE WHEN l_discount > -1 AND l_discount <= 0.02 THEN 'low' WHEN l_discount > 0.02 AND l_discount <= 0.06 THEN 'mid'
WHEN l_discount > 0.06 AND l_discount <= 1 THEN 'high' END AS bin FROM lineitem"""
)
def right_closed_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_discount", 2).alias("l_discount"), ordering.right_closed_bin(F.col("l_discount"), [-1, 0.02, 0.06, 1], ["low", "mid", "high"]).alias("bin"))


_H = "CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16)) AS UBIGINT)"


@query(
    f"""SELECT c_custkey, CAST({_H} % 5 AS BIGINT) AS fold_bytes, CAST(CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS UBIGINT) % 5 AS BIGINT) AS fold_digits,
CASE WHEN CAST(('0x' || substr(sha256('ab:' || c_custkey), 1, 2)) AS INT) < 128 THEN 'treatment' ELSE 'control' END AS arm,
CASE WHEN {_H} % 10000 < 6000 THEN 'train' WHEN {_H} % 10000 < 8000 THEN 'dev' WHEN {_H} % 10000 < 9000 THEN 'calibration' ELSE 'excluded' END AS split,
round(CAST({_H} AS DOUBLE) / 18446744073709551616.0, 9) AS unit FROM customer"""
)
def hash_assignments(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", hashing.fold(key, 5).alias("fold_bytes"), hashing.fold(key, 5, 8).alias("fold_digits"), hashing.arm(key, "ab:").alias("arm"),
        hashing.interval(key, [(6000, "train"), (8000, "dev"), (9000, "calibration")]).alias("split"), F.round(hashing.unit(key), 9).alias("unit"),
    )


@query(
    """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'dev' END AS split, CASE WHEN r <= 50 THEN 'guard_a' WHEN r <= 80 THEN 'guard_b' ELSE 'free' END AS exact FROM r"""
)
def hash_order_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", hashing.hex_digest(F.col("c_custkey")).alias("h"))
    ranked = ordering.global_rank(rows, ["h", "c_custkey"], "r").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    r = F.col("r")
    return ranked.select("c_custkey", F.when(r <= F.floor(F.col("n") * 0.8), "train").otherwise("dev").alias("split"), F.when(r <= 50, "guard_a").when(r <= 80, "guard_b").otherwise("free").alias("exact"))


@query(
    """WITH used AS (SELECT c_custkey FROM customer WHERE c_nationkey < 3 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS digest FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM used) ORDER BY digest LIMIT 100"""
)
def fresh_sample(spark, sf_dir):
    """The 100 smallest digests outside all earlier sets: a limit is the feature."""
    customer = table(spark, sf_dir, "customer")
    used = customer.where("c_nationkey < 3").select("c_custkey").union(table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey")).distinct()
    left = customer.join(used, "c_custkey", "left_anti").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("digest"))
    return left.orderBy("digest").limit(100)


@query(
    """WITH q AS (SELECT conv_id, turn, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM conversations WHERE role = 'user'),
a AS (SELECT q.*, sha256(conv_id || ':' || turn) AS d FROM q WHERE conv_id % 7 <> 0 AND norm NOT IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM benchmark)),
u AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY d) AS k FROM a),
s AS (SELECT conv_id, turn, d, row_number() OVER (ORDER BY d) AS r FROM u WHERE k = 1)
SELECT conv_id, turn, r AS rank, CASE WHEN r <= 10 THEN 'validation' ELSE 'train' END AS part FROM s WHERE r <= 60"""
)
def leakage_safe_sample(spark, sf_dir):
    """Excluded ids and texts go, repeated texts keep their smallest digest, then the 60 smallest digests (a limit is the feature)."""
    from ..functions.text import squeeze

    norm = F.lower(squeeze(F.col("text")))
    q = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 7 <> 0").select("conv_id", "turn", norm.alias("norm"))
    banned = table(spark, sf_dir, "benchmark").select(norm.alias("norm"))
    q = q.join(banned, "norm", "left_anti").withColumn("d", F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256))
    one = q.groupBy("norm").agg(F.min(F.struct("d", "conv_id", "turn")).alias("m")).select("m.*")
    few = one.orderBy("d").limit(60)
    ranked = few.withColumn("rank", F.row_number().over(Window.orderBy("d")).cast("long"))  # 60 rows
    return ranked.select("conv_id", "turn", "rank", F.when(F.col("rank") <= 10, "validation").otherwise("train").alias("part"))


@query(
    f"""WITH {_SPLIT}, h AS (SELECT DISTINCT user_id, item_id FROM split), i AS (SELECT DISTINCT item_id FROM h), t AS (SELECT user_id, item_id FROM split WHERE split = 'test'),
n AS (SELECT u.user_id, i.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY md5(u.user_id || ':' || i.item_id)) AS r
  FROM (SELECT DISTINCT user_id FROM h) u, i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = u.user_id AND h.item_id = i.item_id))
SELECT user_id, item_id, CAST(0 AS BIGINT) AS slot, 1 AS label FROM t UNION ALL SELECT user_id, item_id, r AS slot, 0 AS label FROM n WHERE r <= 5"""
)
def negative_samples(spark, sf_dir):
    """Each user's test item and five items outside the history, by a hash order over the bounded item catalog."""
    s = split(spark, sf_dir)
    seen = s.groupBy("user_id").agg(F.collect_set("item_id").alias("seen"))
    catalog = s.select("item_id").distinct().agg(F.collect_list("item_id").alias("all"))
    digest = lambda i: F.md5(F.concat_ws(":", F.col("user_id").cast("string"), i.cast("string")))
    rest = seen.crossJoin(F.broadcast(catalog)).select("user_id", F.array_except("all", "seen").alias("rest"))
    best = F.slice(F.array_sort(F.transform("rest", lambda i: F.struct(digest(i).alias("d"), i.alias("item_id")))), 1, 5)
    negatives = rest.select("user_id", F.posexplode(best).alias("p", "x")).select("user_id", "x.item_id", (F.col("p") + 1).cast("long").alias("slot"), F.lit(0).alias("label"))
    return s.where("split = 'test'").select("user_id", "item_id", F.lit(0).cast("long").alias("slot"), F.lit(1).alias("label")).unionByName(negatives)


_LIST = """r AS (SELECT user_id AS q, event_id AS doc, event_type = 'purchase' AS pos, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"""


@query(
    f"""WITH {_LIST}, n AS (SELECT q, doc, rank FROM r WHERE NOT pos AND rank <= 20),
hard AS (SELECT q, arg_min(doc, rank) AS doc FROM n GROUP BY q), rnd AS (SELECT q, arg_min(doc, md5(q || ':' || doc)) AS doc FROM n GROUP BY q)
SELECT p.q, p.doc AS positive, x.doc AS negative, kind FROM (SELECT q, doc FROM r WHERE pos AND rank <= 20) p
JOIN (SELECT q, doc, 'rank_hard' AS kind FROM hard UNION ALL SELECT q, doc, 'random' AS kind FROM rnd) x USING (q)"""
)
def training_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("doc"), (F.col("event_type") == "purchase").alias("pos"), "value")
    r = ordering.top_within(e, ["q"], [F.desc("value"), "doc"], 20)
    digest = F.md5(F.concat_ws(":", F.col("q").cast("string"), F.col("doc").cast("string")))
    n = r.where("not pos").groupBy("q").agg(F.min_by("doc", "rank").alias("rank_hard"), F.min_by("doc", digest).alias("random"))
    negatives = n.unpivot("q", ["rank_hard", "random"], "kind", "negative")
    return r.where("pos").select("q", F.col("doc").alias("positive")).join(negatives, "q").select("q", "positive", "negative", "kind")


@query(
    f"""WITH {_LIST}, want AS (SELECT unnest([1, 3, 7, 15, 19]) AS w), n AS (SELECT q, doc, rank, count(*) OVER (PARTITION BY q) AS c, row_number() OVER (PARTITION BY q ORDER BY rank) AS k FROM r WHERE NOT pos)
SELECT DISTINCT q, doc, rank, k AS slot FROM n, want WHERE k = least(w, c)"""
)
def fixed_rank_negatives(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("doc"), (F.col("event_type") == "purchase").alias("pos"), "value")
    r = ordering.rank_within(e, ["q"], [F.desc("value"), "doc"]).where("not pos")
    n = ordering.rank_within(r, ["q"], ["rank"], "slot").withColumn("c", F.count("*").over(Window.partitionBy("q")))
    wanted = F.transform(F.array(*[F.lit(x) for x in (1, 3, 7, 15, 19)]), lambda w: F.least(w.cast("long"), F.col("c")))
    return n.where(F.array_contains(wanted, F.col("slot"))).select("q", "doc", "rank", "slot")
