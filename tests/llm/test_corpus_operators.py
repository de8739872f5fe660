"""Archives, media, near-duplicates, nearest neighbours and the pipeline against brute force."""

import zlib

from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import components, hnsw, media, simhash, warc
from tidemill.llm.common import shared_dir, stored


def canonical(rows):
    return sorted(map(tuple, rows), key=repr)


def test_warc_equals_sql(spark, duck, sf):
    got = warc.op1_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = duck.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP1_SQL})").fetchall()
    assert canonical(got) == canonical(want)


def test_warc_odd_rows(spark):
    rows = [(1, "http://WWW.a.example/x?y=1", "same"), (2, None, "same"), (3, "not a url\r\nX: y", None), (4, "https://b.example:8080/é", ""), (5, "http://[bad", "ü" * 100_000), (None, "u", "same"), (2, "http://a.example/", "same"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("URL")).select("*", F.lit(2).alias("sha"))
    for least, revisits in ((0, {(1, 2), (None, 2), (3, 4)}), (3, {(1, 2), (None, 2)}), (5, set())):
        got = warc.round_trip(pages, least, shards=3).collect()
        assert len(got) == len(rows)
        assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == revisits
        for page, _, html in rows:
            body = (html or "").encode()
            assert any(r["page_id"] == page and r["payload_bytes"] == len(body) and r["payload_digest"] == warc.base32_sha1(body) for r in got)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_index_lookup_over_blocks_and_shards(spark, monkeypatch):
    n = 3000
    captures = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "com,hot)/").otherwise(F.concat(F.lit("org,x)/"), F.col("id").cast("string"))).alias("key"), (F.col("id") % 1500).alias("page_id"), F.lit("f").alias("archive"), F.col("id").alias("offset"), F.lit(7).cast("long").alias("length")
    )
    folder = shared_dir(spark)
    index = warc.write_index(captures, folder, 4)
    assert index == sorted(index) and 1 < len(index) <= 4
    wanted = captures.select("key", F.col("page_id").alias("page")).distinct()
    found = warc.lookup(wanted, index, folder).collect()
    assert sorted(r["offset"] for r in found) == list(range(n))
    none = spark.createDataFrame([("aaa", 1), ("zzz", 1), ("com,hot)/", 999_999)], "key string, page long")
    assert warc.lookup(none, index, folder).collect() == []


def test_surt():
    assert warc.surt("HTTP://News.Example.com:8080/a b?q=1#f") == "com,example,news:8080)/a%20b?q=1"
    assert warc.surt(None) == "-" and warc.surt("http://x.org") == "org,x)/"


def test_media_formats():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    grey = rng.integers(0, 256, (6, 24), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert media.decode(media.encode_grey_bmp(grey)).shape == grey.shape and (media.decode(media.encode_grey_bmp(grey)) == grey).all()
    assert (media.decode(b"P6\n# a comment\n7 5 255\n" + rgb.tobytes()) == rgb).all()
    assert media.decode(b"P2\n2 2\n9\n1 2\n3 9\n").tolist() == [[1, 2], [3, 9]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]] == media.decode(b"P4\n3 1\n\xa0").tolist()
    for bad in (b"", b"P9\n1 1\n255\n\x00", b"BM\x00"):
        with pytest.raises((ValueError, IndexError, __import__("struct").error)):
            media.decode(bad)


def test_area_resize_is_exact():
    rng = np.random.default_rng(2)
    for shape in ((16, 24), (24, 9), (7, 5), (3, 2)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        h, w = 8, 9
        fine = np.repeat(np.repeat(image.astype(float), h, axis=0), w, axis=1)
        want = fine.reshape(h, shape[0], w, shape[1]).mean(axis=(1, 3))
        assert media.area_resize(image, h, w) == pytest.approx(want)


def test_media_query(spark, tmp_path):
    """Both formats occur, tiles read back are NPY files of the resized image, an empty table gives no rows."""
    texts = ["", None, "short", "x" * 576, "y" * 577, "é" * 700, "z " * 40_000, "short"]
    schema = "doc_id long, text string, tile string"
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media.op2_media_columns(spark, str(tmp_path)).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or 576 * (not raw))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        blocks = len(payload) // 576 % 2
        kinds.add(blocks)
        held = (media.encode_pgm if blocks else media.encode_grey_bmp)(image)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(held))
        assert (r["payload_sha256"], r["media_sha256"]) == (sha256(payload).hexdigest(), sha256(held).hexdigest())
        assert (r["feature"], r["tile_sha256"]) == (media.difference_hash(image), sha256(media.tile(image)).hexdigest())
    assert kinds == {0, 1}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op2_media_columns(spark, f"{tmp_path}/none").collect() == []


def test_media_rows(spark):
    texts = [None, "", "x", "é" * 288, "y" * 577, "x", "long " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", F.lit(0).alias("media"))
    got = {r["doc_id"]: r for r in media.digests(stored(media.media_column(docs))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert got[i]["n_bytes"] == len(raw) and got[i]["payload_bytes"] == len(payload)
        assert got[i]["payload_sha256"] == __import__("hashlib").sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-32:])
    assert got[2][3:] == got[5][3:] and len(got[0]["feature"]) == 16
    import io

    tile = media.tiles(spark.createDataFrame([(1, bytearray(media.encode_pgm(np.full((24, 24), 7, np.uint8)))), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary"))
    rows = {r["doc_id"]: r for r in tile.collect()}
    assert (np.load(io.BytesIO(bytes(rows[1]["tile"]))) == 7).all() and rows[1]["dhash"] == "0" * 16
    assert rows[2]["tile"] is None and rows[3]["dhash"] is None


def brute(ids, fps, near):
    parent = dict.fromkeys(ids)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and near(fps[a], fps[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def plain_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_near_duplicates_equal_brute_force(spark, hot):
    rng = np.random.default_rng(hot)
    base = [f"w{i}" for i in rng.integers(0, 1000, 150)]
    texts = [None, "", "  \t", "One", "one", "one TWO", "ünï ÜNÏ x y"]
    for _ in range(90):  # one large family, a word or two apart
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 4)):
            t[k] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 1000, 30)) for _ in range(40)] + texts[-5:]
    docs = spark.createDataFrame([(7 * i % 1009, t) for i, t in enumerate(texts)], "doc_id long, text string").select("*", F.lit("clash").alias("fp"))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, hot=hot).collect()}
    ids = [7 * i % 1009 for i in range(len(texts))]
    fps = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute(ids, fps, lambda a, b: (a ^ b).bit_count() <= 3)


def test_near_duplicates_of_nothing_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "only me here")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_majority_of_many_equals_few():
    h = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
    assert int(simhash.majority(h.reshape(-1, 1))[0]) == want
    assert (simhash.majority(simhash.spread(h, 3))[:1] == simhash.majority(h.reshape(-1, 1))).all()


def test_keep_one(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    near = words(300)
    copies = [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (10, 60, 200)]
    clean = [" ".join(words(n)) for n in (1, 6, 40, 200, 2000)]
    texts = [" ".join(near), *copies, *clean, clean[3].upper(), None, "", clean[0]]
    docs = spark.createDataFrame([(100 - i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").select("*", F.lit(1).alias("node"))
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {97, 95, 94, 92, 91, 89, 88}
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).collect() == []


def kept_by_jaccard(texts):
    """Ids kept by comparing the sets of five-word shingles of every pair; doc_id is the place."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    ids = range(len(texts))
    groups = brute(list(ids), {i: i for i in ids}, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return set(groups.values())


@pytest.mark.parametrize("seed", [2])
def test_keep_one_equals_brute_force_jaccard(spark, seed):
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    line, texts = words(12), []
    for k in range(150):  # groups of two: 0.80 exactly, then 0.70 to 0.95
        a = words(104) if k < 75 else words(40 + k) + line
        b = a + words(25) if k < 75 else [w if rng.random() > 0.02 else "changed" for w in a]
        texts += [" ".join(a), " ".join(b)]
    base = words(200)
    for _ in range(25):  # one large group
        t = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 9)):
            t[at] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept_by_jaccard(texts)


def test_keep_one_of_short_texts(spark):
    """One word added or changed at an end: links by the similarity itself, not by an estimate."""
    texts = []
    for k in range(20):
        w = [f"t{k}x{i}" for i in range(20)]
        for n in (8, 9, 10):  # 4 of 5, 5 of 6, 6 of 7 shingles: near-duplicates
            texts += [" ".join([f"a{n}"] + w[:n - 1]), " ".join([f"a{n}"] + w[:n - 1] + [f"more{n}"])]
        for n in (10, 11, 12):  # 5 of 7, 6 of 8, 7 of 9: not
            texts += [" ".join([f"{v}{i}c{n}" for i in w[: n - 1]] + [end]) for v, end in (("v", "one"), ("v", "two"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == kept_by_jaccard(texts) and len(kept) == 20 * (3 + 6)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    link = {tuple(sorted(e)) for e in edges}
    ids = sorted({i for e in edges if e[0] != e[1] for i in e})
    want = brute(ids, {i: i for i in ids}, lambda a, b: (a, b) in link)
    assert got == want


def test_hot_join_keeps_every_row(spark):
    left = spark.range(30_000).select(F.when(F.col("id") < 20_000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = components.hot_join(left, right, "k", 30_000)
    assert got.columns == ["k", "id", "m"] and got.count() == 30_000
    assert got.where("k = 1").agg(F.min("m"), F.max("m")).first() == (19_999, 19_999)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:160] = v[100]
    return v


def exact(v, ids, q, k):
    s = (v.astype(float) * v[q].astype(float)).sum(axis=1)
    return [(int(ids[j]), s[j]) for j in np.lexsort((ids, -np.round(s, 9))) if j != q][:k]


def test_nearest(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [1.0] * 15 + [float("nan")]), (5060, [1.0] * 15 + [float("inf")]), (5080, [1.0] * 15 + [None]), (None, [1.0] * 16), (5100, [])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").select("*", F.lit(1).alias("V")).select("*", F.lit(1).alias("rank"))
    found = hnsw.nearest(df, shard_size=300, block=16).collect()
    by: dict = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, got in by.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        for _, i, s in got:
            assert i != q and s == pytest.approx(float((vectors[i].astype(float) * vectors[q].astype(float)).sum()), abs=1e-12)
        hits += len({i for _, i, _ in got} & {i for i, _ in exact(vectors, np.arange(900), q, 20)})
    assert hits >= 0.9 * 20 * len(by)
    copies = [i for _, i, _ in by[100]][:19]
    assert copies == list(range(101, 120))  # ties to the smaller id


def test_nearest_in_double_precision(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.00000001, 0.0]), (2, [1.00000002, 0.0]), (3, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in hnsw.nearest(df).orderBy("rank").collect()]
    assert got == [(3, 1e200), (2, 1.00000002), (1, 1.00000001)]


@pytest.mark.parametrize("kind", ["gauss", "norms", "clusters"])
def test_recall_of_a_large_shard(kind):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4096, 64))
    if kind == "norms":
        v *= np.exp(0.5 * rng.normal(size=(4096, 1)))
    if kind == "clusters":
        v = rng.normal(size=(64, 64))[rng.integers(0, 64, 4096)] + 0.3 * v
    found = hnsw.Hnsw.build(hnsw.Hnsw.augmented(v)).search(v[::40], 20)
    true = np.argsort(-(v[::40] @ v.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), true.tolist())]) >= 0.9


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters"])
def test_lists_are_as_long_as_the_shards_need(kind):
    rng = np.random.default_rng(0)
    v, q = np.split(rng.normal(size=(8400, 64)), [8192])
    if kind == "sphere":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "norms":
        v *= np.exp(0.5 * rng.normal(size=(8192, 1)))
    if kind == "clusters":
        middle = rng.normal(size=(64, 64))
        v, q = middle[rng.integers(0, 64, 8192)] + 0.3 * v, middle[rng.integers(0, 64, 208)] + 0.3 * q
    pairs = []
    for part in range(4):
        mine = np.arange(part, 8192, 4)
        graph = hnsw.Hnsw.build(hnsw.Hnsw.augmented(v[mine]), most=8)
        pairs.append(mine[graph.search(q, 20, graph.ef)])
        assert graph.ef <= {"sphere": 192, "norms": 384, "clusters": 64}[kind]  # 512 before, whatever the data
    found = np.hstack(pairs)
    best = np.take_along_axis(found, np.argsort(-np.einsum("qd,qcd->qc", q, v[found]), axis=1)[:, :20], 1)
    true = np.argsort(-(q @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best.tolist(), true.tolist())]) >= 0.93


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0]), (40, [3.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert hnsw.nearest(df.limit(0)).collect() == []
    assert hnsw.nearest(df.where("vec_id = 0")).collect() == []


def test_graph_survives_storage(vectors):
    v = np.unique(vectors, axis=0)
    g = hnsw.Hnsw.build(hnsw.Hnsw.augmented(v))
    again = hnsw.Hnsw.unpack(hnsw.Hnsw.augmented(v), **g.pack())
    assert (g.search(v[:20], 5) == again.search(v[:20], 5)).all()
    assert all(((x >= -1) & (x < len(v))).all() for x in g.layers)


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.6 * kept[0]
    texts = [r[0] for r in docs.select(F.lower("text")).collect()]
    assert len(texts) == len(set(texts))
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == kept[-1]


def test_registry():
    from tidemill.llm import registry

    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_pipeline_gives_heap_back(spark, sf):
    """Each stage collects garbage as it begins and before its result is written, so a heap grown by one stage doesn't stay beside the workers of the next."""
    import corpus_pipeline

    collectors = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(m.getCollectionCount() for m in collectors if "Young" not in m.getName() and "Scavenge" not in m.getName())
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES:
        before = whole()
        stage(spark, docs, sf)
        assert whole() >= before + 2, name
