"""Pairs of shingle sets of similarity 0.8 or more, without a miss, by prefix filtering.

In any one order of all shingles, two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of each (n: its size); so sets meet in an index of these prefixes alone. The
order is common shingles last, else by hash; which ones count as common is learned from a
sample and changes only the time taken. Candidates are compared by their whole sets.

An index entry of more than two sets isn't listed pair by pair. Its first and last members
stand for it; once the components of those links are known, only members outside the entry's
main component are compared with those of like size, so no link between components is lost.

Before two sets are compared, bitmaps that hold the parity of the hashes' counts bound what they
can share: each bit that differs is a shingle that only one of them has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Runs, as_texts, narrowed, per_batch, stored
from .components import components

#: Least similarity as a fraction, so that all bounds are exact in whole numbers.
OF, OUT_OF = 4, 5
#: 64-bit words of the least parity bitmap.
LEAST_WORDS = 8
_hash = xxhash.xxh64_intdigest


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): a 64-bit hash of each word (A-Z as a-z, between ASCII white space); each different word is hashed once."""
    runs = Runs(pc.ascii_lower(as_texts(texts)))
    unique = runs.unique.to_pylist()
    found = np.fromiter((_hash(w.encode()) for w in unique), np.uint64, len(unique))
    real = np.fromiter(map(bool, unique), bool, len(unique))[runs.codes]
    return found[runs.codes[real]], np.concatenate([[0], np.cumsum(real)])[runs.bounds]


def _mixed(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Ascending different 64-bit hashes of each text's shingles; a text of fewer words has one of all its words, one without none."""
    n = len(words)
    mixed = np.zeros(n, np.uint64)
    for k in range(shingle):
        if n > k:
            mixed[: n - k] += words[k:] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    mixed = _mixed(mixed)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(mixed[a : b - shingle + 1]))
        else:
            out.append(np.array([_hash(words[a:b].tobytes(), b - a)] if b > a else [], np.uint64))
    return out


def parity(found: np.ndarray) -> np.ndarray:
    """The bitmap of a set: bit h is set if an odd number of its hashes are h modulo the bits, a power of two from the set's size on."""
    bits = 64 * LEAST_WORDS
    while bits < len(found):
        bits *= 2
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(x: str, y: str):
    """Bitmap x as long as y, if it is twice as long: bits that become one are added up."""
    half = F.size(y)
    return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))


def bits_apart(x: str, y: str):
    """Bits that differ between the bitmaps of two sets of which neither is more than twice as large."""
    each = F.zip_with(_folded(x, y), _folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def common_shingles(texts: DataFrame, shingle: int, sample: int = 4096, least: int = 4, most: int = 20_000) -> np.ndarray:
    """Hashes, ascending, of the shingles most often met in a sample of different texts (text): at most `most`."""
    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, texts.count() // sample))) == 0).distinct()
    met = sets_of(part.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "text"), shingle).select(F.explode("grams").alias("g"))
    found = [r["g"] for r in met.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "g").limit(most).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def prefixes(docs: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """(rid, doc_id, node, n, code, bits, prefix) of (rid, doc_id, text).

    node is a hash of the word sequence, n the size of the set of shingles, code its SimHash of 64
    bits and bits its parity bitmap.
    """
    from .simhash import majority

    def make():
        def run(batch):
            words, bounds = word_hashes(batch[2])
            sets = shingle_sets(words, bounds, shingle)
            nodes = [xxhash.xxh3_64_intdigest(words[a:b].tobytes()) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            starts = []
            for found in sets:
                n = len(found)
                if n and len(common):
                    usual = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
                    found = np.concatenate([found[~usual], found[usual]])
                starts.append(found[: n + (OF * n) // -OUT_OF + 1 if n else 0].view(np.int64))
            codes = np.array([majority(found.reshape(-1, 1))[0] for found in sets], np.uint64)
            return {"rid": batch[0], "doc_id": batch[1], "node": np.array(nodes, np.uint64).view(np.int64), "n": [len(s) for s in sets], "code": codes.view(np.int64), "bits": [parity(s) for s in sets], "prefix": starts}

        return run

    return per_batch(docs, "rid long, doc_id long, node long, n int, code long, bits array<long>, prefix array<long>", make)


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, grams) of (a, b, text)."""

    def make():
        return lambda batch: {"a": batch[0], "b": batch[1], "grams": [s.view(np.int64) for s in shingle_sets(*word_hashes(batch[2]), shingle)]}

    return per_batch(texts, "a long, b long, grams array<long>", make)


class Pairs:
    """Candidates and the check of their whole sets.

    nodes: (node, n, bits, rid), one row per node; texts: (rid, text).
    """

    def __init__(self, nodes: DataFrame, texts: DataFrame, shingle: int):
        self.nodes, self.texts, self.shingle = nodes, texts, shingle

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(a, b, grams) of wanted (node, a, b)."""
        rids = stored(wanted.join(self.nodes.select("node", "rid"), "node").select("rid", "a", "b"))
        return sets_of(narrowed(self.texts, rids, "rid", keep=("a", "b", "text"), most=300_000), self.shingle)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose whole sets have a similarity of 0.8 or more."""
        at = lambda end: self.nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
        # the smaller node is `a`; both have at least as many of their own as bits differ
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.hint("merge").join(at("a"), "a").hint("merge").join(at("b"), "b")
        total = F.col("n_a") + F.col("n_b")
        sized = F.least("n_a", "n_b") * OUT_OF >= F.greatest("n_a", "n_b") * OF
        pairs = pairs.where(sized).where((total - bits_apart("bits_a", "bits_b")) * (OF + OUT_OF) >= total * (2 * OF))
        pairs = stored(pairs.select("a", "b"))
        if pairs.isEmpty():
            return pairs
        x = self._sets(pairs.select("a").distinct().select(F.col("a").alias("node"), "a", F.lit(0).cast("long").alias("b"))).select("a", F.col("grams").alias("x"))
        y = self._sets(pairs.select(F.col("b").alias("node"), "a", "b")).select("a", "b", F.col("grams").alias("y"))
        alike = F.size(F.array_intersect("x", "y")) * (OF + OUT_OF) >= (F.size("x") + F.size("y")) * OF
        return stored(y.hint("merge").join(x, "a").where(alike).select("a", "b"))


def groups(nodes: DataFrame, pairs: Pairs, known: DataFrame) -> DataFrame:
    """(node, component) of all pairs of similarity 0.8 or more; nodes without such a pair have no row.

    nodes: (node, n, prefix), one row per node; known: pairs found before, each of that similarity.
    """
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    # summed before the shuffle, so a hot key is one row a task
    index = entries.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("a"), F.max("node").alias("b")).where("k > 1")
    index = stored(index)
    many = index.where("k > 2").select("key", "a", "b")
    met = stored(narrowed(entries.select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest")), many, "key", keep=("key", "node", "n", "rest", "a", "b")))
    stands = met.select("node", F.explode(F.array("a", "b")).alias("end")).where("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    new = index.where("k = 2").select("a", "b").unionByName(stands).distinct().join(known, ["a", "b"], "left_anti")
    found = stored(components(known.unionByName(pairs.verified(new))))
    rows = met.select("key", "node", "n", "rest").join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    # two alike sets differ in size by a quarter at most: their bands are equal or neighbours
    rows = stored(rows.select("key", "node", "n", "rest", "label", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OUT_OF / OF))).alias("band")))
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    rows = rows.join(main, "key").withColumn("out", F.col("label") != F.col("main"))
    side = lambda p: rows.select("key", "band", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "rest", "label", "out")])
    x, y = side("x").where("x_out"), side("y")
    x = x.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    # whether they can be alike with so many left from the shared one on; of two outside the main component the smaller asks
    alike = F.least("x_rest", "y_rest") * (OF + OUT_OF) >= (F.col("x_n") + F.col("y_n")) * OF
    alike &= (F.col("x_label") != F.col("y_label")) & (~F.col("y_out") | (F.col("x_node") < F.col("y_node")))
    rest = x.hint("merge").join(y, (x["key"] == y["key"]) & (x["band"] == y["band"]) & alike).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    rest = pairs.verified(rest)
    if rest.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
