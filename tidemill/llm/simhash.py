"""Operator 10: SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the whole radius are within a
small radius in at least one segment, so each segment has a table by its value, and each
fingerprint looks up the small Hamming ball round its own value. Candidates are verified by
their complete distance.

Half of a ball of radius 1 is enough: of two values that differ in one bit, one has it unset
and finds the other by setting it.

A table entry of over `hot` fingerprints isn't listed pair by pair. Its first few members
stand for it; once the components of those links are known, only members outside the
entry's main component are compared with the others, so no link between components is lost.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_distance, narrowed, per_batch, pick, shared_dir, stored, table, text_bytes
from .components import components, hot_join

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_hash = xxhash.xxh64_intdigest


def shingle_hashes(raw: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included: A-Z in lower case, single spaces; the whole if it has fewer words."""
    parts = raw.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda at, n: at + 1 + n))
    if len(parts) <= words:
        return np.array([_hash(line, seed)], np.uint64)
    starts = [0] + [e + 1 for e in ends[: len(parts) - words]]
    return np.array([_hash(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit words of a fingerprint from hashes of shape (shingles, words): bits set in over half; none: zero."""
    n, words = hashes.shape
    if not n:
        return np.zeros(words, np.uint64)
    width = 8 * words
    if n < 64:
        ones = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:  # counts by byte value instead of by bit
        ones = np.zeros(8 * width, np.int64)
        base = np.arange(width, dtype=np.int64) << 8
        for part in range(0, n, 1 << 14):
            seen = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, width) + base
            ones += (np.bincount(seen.ravel(), minlength=width << 8).reshape(width, 256) @ _BITS).ravel()
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` independent 64-bit hashes of each hash (splitmix64); the first is the hash itself."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    with np.errstate(over="ignore"):
        for k in range(1, words):
            z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed long; a text without words has 0."""

    def make():
        def run(batch):
            fps = [majority(shingle_hashes(raw, shingle, seed).reshape(-1, 1))[0] for raw in text_bytes(batch[1])]
            return {"doc_id": batch[0], "fp": np.array(fps, np.uint64).view(np.int64)}

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, fp long", make)


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _entries(codes: DataFrame, segments: list[tuple[int, int, int]], ball: bool) -> DataFrame:
    """(key, node, sketch, own) of each segment (word, first bit, bits): its own value and, with ball, one more bit set.

    All segments have the same number of bits. What to look up is a constant array, so the
    generated code stays small.
    """
    bits = segments[0][2]
    masks = [0] + [1 << b for b in range(bits) if ball]
    spec = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(word).alias("word"), F.lit(first).alias("first"), F.lit(m).cast("long").alias("mask")) for k, (word, first, _) in enumerate(segments) for m in masks]
    rows = codes.select("node", "code", F.explode(F.array(*spec)).alias("s"))
    rows = rows.select("node", "s.k", "s.mask", F.expr("code[0]").alias("sketch"), F.expr(f"shiftrightunsigned(code[s.word], s.first) & {(1 << bits) - 1}L").alias("value"))
    key = F.expr(f"shiftleft(k, {bits}) | value | mask")
    return rows.where("value & mask = 0").select(key.alias("key"), "node", "sketch", (F.col("mask") == 0).alias("own"))


def mih_links(codes: DataFrame, segments: list[tuple[int, int, int]], words: int, most: int, most_first: int | None = None, hot: int = 64, stand: int = 3, whole: bool = True) -> DataFrame:
    """(a, b): links whose components are those of all pairs of candidates within `most` differing bits.

    codes: (node long, code array<long> of `words`), one row per node. most_first: largest
    distance of the first word of a candidate pair. Within an entry of up to `hot` nodes every
    pair is a candidate; see the module's text for larger entries. Without `whole` these are
    only linked to their stand-ins, which is for callers that find the rest another way.
    """
    codes = codes.select("node", "code")
    most_first = most if most_first is None else most_first

    def verify(pairs: DataFrame) -> DataFrame:
        if words == 1:  # the first word is the whole code
            return pairs
        x, y = codes.select(F.col("node").alias("a"), F.col("code").alias("x")), codes.select(F.col("node").alias("b"), F.col("code").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(bit_distance(F.col("x"), F.col("y"), words) <= most).select("a", "b")

    own = _entries(codes, segments, ball=False)
    # one row more than `hot` tells a hot entry; limits per key apply before the shuffle
    ranked = own.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("node"))).where(F.col("at") <= hot + 1)
    grouped = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "sketch"))).alias("all"))
    is_hot = F.size("all") > hot
    entries = stored(grouped.select("key", F.when(is_hot, F.slice("all", 1, stand)).otherwise(F.col("all")).alias("members"), is_hot.alias("hot")))
    probes = _entries(codes, segments, ball=True)
    near = F.filter(
        "members",
        lambda m: (m["node"] != F.col("node"))
        & (F.bit_count(m["sketch"].bitwiseXOR(F.col("sketch"))) <= most_first)
        & (F.col("hot") | ~F.col("own") | (m["node"] > F.col("node"))),
    )
    # what explode makes is far larger than Spark expects: neither side may be broadcast
    found = probes.hint("merge").join(entries, "key").select("node", F.explode(near).alias("m"))
    pairs = found.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()
    links = verify(pairs).checkpoint()
    if not whole:
        return links
    hot_keys = entries.where("hot").select("key")
    if hot_keys.isEmpty():
        return links
    labels = components(links)
    rows = probes.hint("merge").join(hot_keys, "key").hint("merge").join(labels, "node", "left")
    rows = stored(rows.select("key", "node", "sketch", "own", F.coalesce("component", "node").alias("label")))
    sizes = rows.where("own").groupBy("key", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rows = rows.join(main, "key").withColumn("out", F.col("label") != F.col("main"))
    if words > 1:  # whole codes go with these rows, so that only links leave the join
        rows = rows.hint("merge").join(codes, "node")
    else:
        rows = rows.withColumn("code", F.array("sketch"))
    side = lambda df, p: df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "sketch", "label", "out", "code")])
    x, y = side(rows, "x"), side(rows.where("own"), "y")
    apart = (F.col("x_label") != F.col("y_label")) & (_distance("x_sketch", "y_sketch") <= most_first) & (bit_distance(F.col("x_code"), F.col("y_code"), words) <= most)
    on = lambda a, b: a.hint("merge").join(b, (a["key"] == b["key"]) & apart).select("x_node", "y_node")
    rest = on(x.where("x_out"), y).unionByName(on(x.where("not x_out"), y.where("y_out")))
    return links.unionByName(rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, hot: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at 3 or fewer differing bits.

    Two segments of 32 bits: of at most 3 differing bits one half has at most 1. A null text
    counts as empty, with fingerprint zero. component_id is the smallest non-null doc_id
    reachable (null if there is none); repeated rows each have their row; an empty table gives
    none. Equal fingerprints are one node, so copies make no pairs.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = stored(fingerprints(docs, shingle))
    total = rows.count()
    codes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    codes = stored(codes)
    nodes = codes.select(F.col("fp").alias("node"), F.array("fp").alias("code"))
    links = mih_links(nodes, [(0, 0, 32), (0, 32, 32)], 1, 3, hot=hot)
    found = components(links)
    labelled = codes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.select("fp", "n", "component").join(least, "component").select("fp", "component_id", "n")
    joined = hot_join(rows, by_fp, "fp", total)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(nodes: DataFrame, hot: int = 64) -> DataFrame:
    """(a, b): nodes (node, code) to compare, as their fingerprints (code) differ in 3 or fewer bits.

    Nodes of equal fingerprint are paired with the smallest of them; of an index entry of over
    `hot` fingerprints each is paired with a few.
    """
    groups = stored(nodes.groupBy("code").agg(F.min("node").alias("least")))
    found = mih_links(groups.select(F.col("code").alias("node"), F.array("code").alias("code")), [(0, 0, 32), (0, 32, 32)], 1, 3, hot=hot, whole=False)
    at = lambda end: groups.select(F.col("code").alias(end), F.col("least").alias(f"of_{end}"))
    pairs = found.join(at("a"), "a").join(at("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    equal = nodes.join(groups, "code").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Rows of docs, all columns: of each group of near-duplicates that with the smallest doc_id.

    Texts of equal word sequence (A-Z as a-z) are duplicates; others are near-duplicates where
    their five-word shingle sets have a similarity (Jaccard) of 0.8 or more, and groups are the
    components of these links. Fingerprints over the shingles and multi-index hashing find close
    copies; the prefix index of shingle_join finds whatever pairs they miss; each link is
    verified by whole sets. Null doc_ids come last; of rows of equal doc_id and text one stays;
    empty texts are duplicates of each other; an empty table gives no rows; a very long text is
    compared whole. Rows are told apart by a 64-bit hash of doc_id and text, so a repeated task
    or another split of the input changes nothing.
    """
    from . import shingle_join

    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    marked = plain.withColumn("rid", F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text))
    texts = marked.select("rid", doc_id.alias("doc_id"), text.alias("text"))
    rows = stored(shingle_join.prefixes(texts, shingle, shingle_join.common_shingles(texts.select("text"), shingle)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    firsts = stored(rows.groupBy("node").agg(first.alias("first")))
    # one row for each word sequence; of repeated rows any
    copies = rows.select("rid").distinct().join(firsts.select("first.rid"), "rid", "left_anti")
    nodes = narrowed(rows, stored(copies), "rid", anti=True, otherwise=firsts.select("first.rid"))
    if rows.select("rid").distinct().count() < rows.count():
        nodes = stored(nodes.dropDuplicates(["node"]))
    pairs = shingle_join.Pairs(nodes.select("node", "n", "bits", "rid"), texts.select("rid", "text"), shingle)
    known = pairs.verified(near_copies(nodes.select("node", "code")))
    found = shingle_join.groups(nodes.select("node", "n", "prefix"), pairs, known)
    groups = firsts.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = groups.select(F.col("first.rid").alias("rid"))
    counts = stored(rows.groupBy("rid").agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), "rid", "left"))
    left = narrowed(marked, counts.where("kept is null").select("rid"), "rid", anti=True, otherwise=counts.where("kept").select("rid"))
    repeated = counts.where("kept and n > 1").select("rid")
    if not repeated.isEmpty():
        left = narrowed(left, repeated, "rid", anti=True).unionByName(narrowed(left, repeated, "rid").dropDuplicates(["rid"]))
    return left.drop("rid").toDF(*names)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole table documents: three-word shingles, links at 3 or fewer bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
