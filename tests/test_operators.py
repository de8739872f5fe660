"""Hand-calculated values, invariants and refusals."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import hashing, text
from tidemill.operators import calibration, contracts, graph, interactions, ordering, pairwise, ranking, retrieval, routing, stats
from tidemill.sources import files
from tidemill.streaming import events as streams

SCORED = [("q1", 1, 0.9, 1.0), ("q1", 2, 0.2, 0.0), ("q1", 3, 0.1, 0.0), ("q2", 4, 0.9, 0.0), ("q2", 5, 0.8, 1.0)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "g string, item long, score double, label double")


def test_ranking_metrics(scored):
    at = lambda k: ranking.per_group(scored, "g", "item", k).agg(F.avg("mrr"), F.avg("recall"), F.avg("ndcg")).first()
    assert tuple(at(1)) == pytest.approx((0.75, 0.5, 0.5))
    assert tuple(at(2)) == pytest.approx((0.75, 1.0, (1 + 1 / math.log2(3)) / 2))


def test_auc_and_grouped_auc(scored):
    assert ranking.auc(scored, []).first()["auc"] == pytest.approx(0.75)
    assert ranking.group_auc(scored, "g").first()["gauc"] == pytest.approx(0.6)


def test_grouped_auc_skips_single_class(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.5, 0.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0)], "g string, score double, label double")
    assert ranking.group_auc(rows, "g").first()["gauc"] == 1.0


def test_calibration(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1.0, 1.0)], "probability double, label double")
    assert calibration.calibration_error(rows).first()["ece"] == 0
    bins = calibration.reliability(rows).collect()
    assert len(bins) == 15 and sum(b["n"] for b in bins) == 5


def test_bins_and_budgets(spark):
    got = [r[0] for r in spark.range(1, 9).select(ordering.equal_frequency_bin(F.col("id"), F.lit(8))).collect()]
    assert [got.count(b) for b in (1, 2, 3)] == [3, 2, 3]
    v = spark.createDataFrame([([5, 1, 4, 2, 3],)], "v array<int>")
    assert v.select(ordering.quantile_at(F.col("v"), 0.2, "nearest"), ordering.quantile_at(F.col("v"), 0.6, "higher")).first() == (2, 4)
    assert spark.range(1).select(ordering.budget_size(F.lit(5), 0.5), ordering.budget_size(F.lit(7), 0.5), ordering.budget_size(F.lit(1), 0.1)).first() == (2, 4, 1)


def test_global_rank_is_dense(spark):
    rows = ordering.global_rank(spark.range(1000).withColumn("k", F.col("id") % 13), [F.desc("k"), "id"], "r").orderBy("r").collect()
    assert [r["r"] for r in rows] == list(range(1, 1001))
    assert [(-r["k"], r["id"]) for r in rows] == sorted((-(i % 13), i) for i in range(1000))


def test_preparation(spark, tmp_path):
    users = {"u1": "abcd", "u2": "eaf", "u3": "ab", "u4": "ghi"}
    with open(tmp_path / "reviews.json", "w") as f:
        for i, (user, items) in enumerate(users.items()):
            for k, item in enumerate(items):
                f.write(json.dumps({"review_id": f"{user}{k}", "user_id": user, "business_id": item, "stars": 5.0, "date": f"2020-01-{10 * (i % 3) + k + 1:02d} 00:00:00"}) + "\n")
        f.write(json.dumps({"review_id": "x", "user_id": None, "business_id": "a", "date": "2020-01-01 00:00:00"}) + "\n")
    raw = files.reviews(spark, str(tmp_path / "reviews.json"))
    assert raw.count() == 12
    split = interactions.leave_two_out(interactions.support_filter(raw, 3, 1))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 4, "valid": 3, "test": 3}
    assert interactions.split_violations(split).first() == (3, 0, 0, 0)
    assert sorted(r["train_length"] for r in interactions.sequences(split).collect()) == [1, 1, 2]
    items = interactions.entity_dimension(split, "item_id", "item_idx")
    assert items.where("train_interactions = 0").count() == 5
    assert [r["item_idx"] for r in items.orderBy("item_id").collect()] == list(range(items.count()))


def test_short_histories_stay_in_train(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("1 1\n1 2\n1 3\n1 4\n2 2\n2 3\n2 5\n3 1\n")
    rows = files.ordered_pairs(spark, str(tmp_path / "pairs.txt")).withColumnRenamed("source_order", "event_time").withColumn("review_id", F.col("event_time"))
    split = interactions.leave_two_out(rows, short_to_train=True)
    assert [r["split"] for r in split.where("user_id = 1").orderBy("history_position").collect()] == ["train", "train", "valid", "test"]
    assert [r["split"] for r in split.where("user_id = 3").collect()] == ["train"]


def test_ties_of_counts_are_torso(spark):
    rows = spark.createDataFrame([(u, i, "train", i) for u in range(3) for i in range(4)], "user_id long, item_id long, split string, event_time long")
    assert {r["frequency_bucket"] for r in interactions.entity_dimension(rows, "item_id", "item_idx").collect()} == {"torso"}


def test_head_share_counts_entities_without_train_rows(spark):
    rows = [(u, i, "train", u) for i in range(4) for u in range(5 - i)] + [(9, i, "test", 9) for i in range(4, 10)]
    split = spark.createDataFrame(rows, "user_id long, item_id long, split string, event_time long")
    got = {r["item_id"]: r["paper_bucket"] for r in interactions.entity_dimension(split, "item_id", "item_idx").collect()}
    assert [i for i, b in got.items() if b == "head"] == [0, 1]  # a fifth of ten, not of four
    assert {got[i] for i in range(4, 10)} == {"cold_start"}


PAIRS = [("q", "a", "b", "a"), ("q", "a", "c", "a"), ("q", "b", "c", "b")]


def _responses(pairs):
    rows = []
    for q, a, b, w in pairs:
        rows += [(q, a, b, "first" if w == a else "second"), (q, b, a, "first" if w == b else "second")]
    return rows


def test_borda(spark):
    r = spark.createDataFrame(_responses(PAIRS), "g string, first string, second string, choice string")
    points = {x["item"]: x["points"] for x in pairwise.borda(pairwise.consensus(r, "g"), "g").collect()}
    assert points == {"a": 2, "b": 1, "c": 0}


def test_consensus_conventions(spark):
    r = spark.createDataFrame([("q", "a", "b", "tie"), ("q", "b", "a", "tie"), ("q", "a", "c", "first"), ("q", "c", "a", "first")], "g string, first string, second string, choice string")
    loose = {(x["left"], x["right"]): (x["winner"], x["swap_agree"]) for x in pairwise.consensus(r, "g").collect()}
    strict = {(x["left"], x["right"]): x["swap_agree"] for x in pairwise.consensus(r, "g", ties_agree=False).collect()}
    assert loose == {("a", "b"): (None, True), ("a", "c"): (None, False)}
    assert strict == {("a", "b"): False, ("a", "c"): False}


def test_cycle(spark):
    r = spark.createDataFrame([("q", "a", "b", "a", True), ("q", "a", "c", "c", True), ("q", "b", "c", "b", True)], "g string, left string, right string, winner string, swap_agree boolean")
    assert pairwise.cycles(r, "g").first()[1:] == (1, 1)
    relevance = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0)], "g string, item string, relevance double")
    assert pairwise.diagnostics(r, relevance, "g").first()["accuracy"] == pytest.approx(2 / 3)


def test_sliding_pass_brings_the_best_first(spark):
    r = spark.createDataFrame(_responses(PAIRS), "g string, first string, second string, choice string")
    c = spark.createDataFrame([("q", "c", 1), ("q", "b", 2), ("q", "a", 3)], "g string, item string, position int")
    one = pairwise.sliding(c, pairwise.consensus(r, "g"), "g", 1).orderBy("rank").collect()
    assert [x["item"] for x in one] == ["a", "c", "b"]


def test_sliding_query_is_a_permutation(spark, sf):
    from tidemill import catalog

    for r in catalog.QUERIES["sliding_ranking"](spark, sf).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("item").alias("i"), F.max("rank").alias("m")).collect():
        assert r["n"] == r["i"] == r["m"]


def test_paired_bootstrap(spark):
    x = np.stack([np.linspace(0.1, 0.3, 40), np.linspace(-0.2, 0.2, 40)], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    run = lambda: {r["metric"]: r for r in stats.paired_bootstrap(df, ["a", "b"]).collect()}
    one = run()
    assert one["a"]["mean"] == pytest.approx(0.2) and one["a"]["low"] > 0 and one["a"]["p_two_sided"] < 0.02
    assert one["b"]["low"] < 0 < one["b"]["high"]
    assert one == run()


def test_erfc(spark):
    got = spark.createDataFrame([(x,) for x in (-1.5, -0.2, 0.0, 0.4, 1.0, 3.0)], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(math.erfc(r["x"]), abs=3e-7) for r in got)


def test_hash_conventions(spark):
    import hashlib

    r = spark.createDataFrame([("k1",), ("k2",)], "k string").select("k", hashing.fold(F.col("k"), 5).alias("a"), hashing.fold(F.col("k"), 5, 8).alias("b"), hashing.unit(F.col("k")).alias("u")).collect()
    for x in r:
        h = hashlib.sha256(x["k"].encode()).hexdigest()
        assert (x["a"], x["b"]) == (int(h[:16], 16) % 5, int(h[:8], 16) % 5)
        assert x["u"] == pytest.approx(int(h[:16], 16) / 2**64)


def test_text(spark):
    t = spark.createDataFrame([("  Best  a_b [A] > [B]\n",)], "t string").select(
        text.squeeze(F.col("t")), text.word_count(F.col("t")), text.clean_identifiers(F.col("t")), text.identifiers(F.col("t")), text.choice(F.lit(" passage b ")), text.is_permutation(F.array(F.lit("B"), F.lit("A")), F.lit(2))
    )
    assert tuple(t.first()) == ("Best a_b [A] > [B]", 5, "  Best  a_b (A) > (B)\n", ["A", "B"], "second", True)


def test_late_fusion_equals_zero_weight_confidence_fusion(spark):
    rows = spark.createDataFrame([(0, i, a, b, k) for i, (a, b, k) in enumerate([(3.0, 0.0, "head"), (2.9, 2.0, "tail"), (1.0, 1.0, "torso")])] + [(1, i, a, b, k) for i, (a, b, k) in enumerate([(5.0, 0.0, "head"), (0.0, 2.0, "tail"), (-1.0, 1.0, "torso")])], "g int, item int, a double, b double, bucket string")
    plain = {(r["g"], r["item"]): r["score"] for r in retrieval.late_fusion(rows, "g", "a", "b", 0.25).collect()}
    zero = {(r["g"], r["item"]): r["score"] for r in retrieval.confidence_fusion(rows, "g", "item", "a", "b", "bucket", weight=0.0).collect()}
    assert zero == pytest.approx(plain)
    full = {(r["g"], r["item"]): r["score"] for r in retrieval.confidence_fusion(rows, "g", "item", "a", "b", "bucket", weight=1.0).collect()}
    gain = {k: full[k] - plain[k] for k in plain}
    assert gain[0, 0] == gain[1, 0] == 0 and gain[0, 1] > gain[1, 1]


def test_tail_floor(spark):
    rows = spark.createDataFrame([(i, float(-i), "tail" if i >= 8 else "head") for i in range(10)], "q int, s double, bucket string")
    used = {r["q"] for r in routing.tail_floor(rows, "s", "q", "bucket", 0.3, 0.5).where("use_large").collect()}
    assert used == {0, 1, 8}


def test_graph_weights(spark):
    e = graph.normalized_edges(spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "u int, i int"))
    w = {(r["src"], r["dst"]): r["w"] for r in e.collect()}
    assert len(w) == 6 and w["u1", "i1"] == pytest.approx(2**-0.5) and w["i2", "u2"] == pytest.approx(2**-0.5)


def test_contracts(spark):
    left, right = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, v int")
    assert contracts.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(left, right, ["k"], validate="one_to_one")
    assert contracts.leaking_columns(spark.createDataFrame([(1, 1)], "query_id int, Relevance int")) == ["Relevance"]
    bad = spark.createDataFrame([("g", 1, 1, 0.5, 2.0), ("g", 1, 3, float("nan"), 0.5)], "g string, item int, rank int, score double, probability double")
    assert tuple(contracts.prediction_violations(bad, "g", "item", 2).first()) == (1, 1, 1, 1, 1, 0)
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(left, ["x"])


def test_sources(spark, tmp_path):
    (tmp_path / "qrels.txt").write_text("q1 0 p1 3\nq1 0 p2 9\nbad line\n")
    assert [r["valid"] for r in files.judgements(spark, str(tmp_path / "qrels.txt")).collect()] == [True, False, False]
    (tmp_path / "top.tsv").write_text("q1\tp9\tx\ty\nq2\tp1\tx\ty\nq1\tp3\tx\ty\nq1\tp4\tx\ty\n")
    assert sorted((r["query_id"], r["passage_id"], r["rank"]) for r in files.first_ranked(spark, str(tmp_path / "top.tsv"), 2).collect()) == [("q1", "p3", 2), ("q1", "p9", 1), ("q2", "p1", 1)]
    (tmp_path / "items.json").write_text('{"business_id": "a", "attributes": {"x": {"y": 1}}, "hours": null}\n')
    assert json.loads(files.businesses(spark, str(tmp_path / "items.json")).first()["attributes_json"]) == {"x": {"y": 1}}
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    assert [r["values"] for r in files.npy(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(contracts.ContractError):
        files.write_requests(spark.createDataFrame([("r", 1)], "request_id string, label int"), str(tmp_path / "x"))
    one = files.manifest({"t": spark.range(10)}, {"a": 1})
    assert one == files.manifest({"t": spark.range(10).repartition(3)}, {"a": 1})
    assert one["fingerprint"] != files.manifest({"t": spark.range(11)}, {"a": 1})["fingerprint"]


def _events(spark, tmp_path, rows):
    import pandas as pd

    path = str(tmp_path / "events")
    pdf = pd.DataFrame([(i, pd.Timestamp(t, unit="s"), u, k, 1.0, "{}") for i, (t, u, k) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    spark.createDataFrame(pdf, streams.EVENT).coalesce(1).write.parquet(path)
    return streams.read_events(spark, path)


def test_intents_and_limits(spark):
    q = spark.createDataFrame([("Best cheap ramen near me",), ("compare A vs B",), ("history of tea",), ("比较 便宜",)], "t string")
    got = [tuple(r) for r in q.select(text.intent(F.col("t")), F.array_join(text.constraints(F.col("t")), " ")).collect()]
    assert got == [("recommendation", "Best cheap near"), ("comparison", ""), ("informational-search", ""), ("comparison", "便宜")]


def test_rate_limit_window_starts_at_first_request(spark, tmp_path):
    s = _events(spark, tmp_path, [(50, 1, "view"), (55, 1, "view"), (70, 1, "view"), (109, 1, "view"), (110, 1, "view")])
    got = [r["allowed"] for r in streams.drain(streams.rate_limited(s, 2), "limit_test").orderBy("event_id").collect()]
    assert got == [True, True, False, False, True]


def test_circuit_breaker(spark, tmp_path):
    s = _events(spark, tmp_path, [(0, 1, "error"), (1, 1, "error"), (5, 1, "view"), (40, 1, "view"), (41, 1, "error")])
    got = [r["status"] for r in streams.drain(streams.circuit_breaker(s, 2, 30.0), "breaker_test").orderBy("event_id").collect()]
    assert got == ["degraded", "degraded", "circuit_open", "ok", "degraded"]


def test_a_failure_after_the_cooldown_opens_again(spark, tmp_path):
    s = _events(spark, tmp_path, [(0, 1, "error"), (1, 1, "error"), (40, 1, "error"), (45, 1, "view"), (80, 1, "view"), (81, 1, "error"), (82, 1, "view")])
    got = [r["status"] for r in streams.drain(streams.circuit_breaker(s, 2, 30.0), "again_test").orderBy("event_id").collect()]
    assert got == ["degraded", "degraded", "degraded", "circuit_open", "ok", "degraded", "ok"]


def test_ttl_conventions(spark, tmp_path):
    s = _events(spark, tmp_path, [(0, 1, "x"), (8, 1, "x"), (16, 1, "x")])
    assert [r["count"] for r in streams.drain(streams.ttl_counter(s, 10, True), "ttl_renew").orderBy("event_id").collect()] == [1, 2, 3]
    assert [r["count"] for r in streams.drain(streams.ttl_counter(s, 10, False), "ttl_first").orderBy("event_id").collect()] == [1, 2, 1]


def test_feedback_sink_rejects_unknown_kinds(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "click"), (2, "nonsense"), (3, None)], "id int, kind string").write.parquet(src)
    stream = spark.readStream.schema("id int, kind string").parquet(src)
    streams.append_feedback(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 2


def test_sequences_round_half_seconds_to_even(spark):
    from tidemill.plans import preparation

    folder = f"{new_folder()}/events.parquet"
    rows = [(i, f"2024-01-01 00:00:0{i}.500000", 1, "view", 1.0, '{"k": 7}') for i in range(6)] + [(9, "1969-12-31 23:59:56.500000", 1, "view", 1.0, '{"k": 7}')]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(folder)
    got = preparation.user_sequences(spark, folder.rsplit("/", 1)[0]).first()["train_seconds"]
    assert got == [-4, 1704067200, 1704067202, 1704067202, 1704067204]
    assert got == duck_on(folder, preparation.SQL["user_sequences"], "train_seconds")[0]


def test_json_and_picks_pass_over_nulls(spark):
    from tidemill.plans import relational

    folder = f"{new_folder()}/events.parquet"
    rows = [(1, None, 5.0, None), (2, "a", None, None), (3, "a", 60.0, '{"k": 1}'), (None, "a", 1.0, '{"k": 1}'), (9, "b", math.nan, None), (10, "c", None, '{"k": 1}'), (None, "d", 3.0, None)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, props string").coalesce(1).write.parquet(folder)
    names = ["event_type", "summary", "has_k", "cheapest", "last_dear", "dear"]
    got = [tuple(r) for r in relational.json_and_picks(spark, folder.rsplit("/", 1)[0]).select(*names).collect()]
    assert ("a", '{"kind":"a","n":3,"top":3}', True, 3, 3, 1) in got and (None, '{"kind":null,"n":1,"top":1}', False, 1, None, 0) in got
    assert sorted(got, key=repr) == sorted(duck_on(folder, relational.SQL["json_and_picks"], *names), key=repr)


def new_folder():
    """A new local folder for tables that a test writes."""
    import tempfile

    return tempfile.mkdtemp(prefix="tidemill-test-")


def duck_on(folder, sql, *columns):
    """What DuckDB gives for these columns on one written events table."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet'")
    found = c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return [r[0] for r in found] if len(columns) == 1 else found


def test_profile_scores_deal_out_pairs_and_norms(spark):
    history = spark.createDataFrame([(u, i) for u in range(40) for i in (u % 5, 7)], "user_id long, item_id long")
    rng = np.random.default_rng(0)
    v = np.vstack([rng.normal(size=(30, 4)), np.zeros((1, 4))])
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, w array<double>").coalesce(1)
    found = retrieval.profile_scores(history, items, items, 31)
    rows = found.collect()
    for r in rows:
        mean = (v[r["query_id"] % 5] + v[7]) / 2
        norm = np.linalg.norm(mean) * np.linalg.norm(v[r["item_id"]])
        assert r["score"] == pytest.approx(mean @ v[r["item_id"]] / norm if norm else 0.0, abs=1e-12)
    assert len(rows) == 40 * 31
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert last.count("REPARTITION_BY_NUM") == 2  # whichever side is streamed, it is dealt out
    assert last[: last.index("Join")].count("aggregate(zip_with(") == 1  # no norm is made anew for a pair
