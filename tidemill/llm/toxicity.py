"""Operator 3: toxicity by a counterfactually regularised classifier.

A logistic model over which words and word beginnings a text has. Training pairs each labelled text that has
identity terms with a counterfactual in which they are swapped for others of their group, all
features of the swapped text computed anew (words and beginnings alike), and penalises the
squared change of the logit between the two (Garg et al., 2019). Identity words that merely go
along with toxic labels so lose their weight, and so do their beginnings.

Words are chosen by chi-square on the training rows, and a lasso step sets the weights of
words that tell nothing to zero, so a long text doesn't gather a score from many small ones.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, as_texts, bounded_sample, crc32_of, gathered, kept_rows, per_batch, pick, stored, table

#: Groups of terms that name people; a term is swapped for the next of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("refugees", "residents"), ("old", "young"), ("blind", "sighted"), ("deaf", "hearing"),
)
THRESHOLD = 0.3
STEMS = range(4, 9)
_word_or_end = re.compile(r"[^\W\d_]+|\n")


def swaps() -> dict[str, str]:
    return {a: group[(i + 1) % len(group)] for group in IDENTITY for i, a in enumerate(group)}


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters."""
    return [word] + [f"{word[:n]}-" for n in STEMS if len(word) > n]


def fit(x: np.ndarray, y: np.ndarray, x_swapped: np.ndarray, share: float | None = None, penalty: float = 5.0, lasso: float = 0.0005, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient.

    Mean log loss with toxic rows weighted to `share` of all (None: as they are), plus penalty *
    mean squared logit change between x and x_swapped, plus ridge and lasso on the weights.
    """
    n, d = x.shape
    share = y.mean() if share is None else share
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())) / n
    moved = x_swapped - x
    moved = moved[np.any(moved != 0, axis=1)]
    gram = 2 * penalty / n * (moved.T @ moved)
    full = np.hstack([x, np.ones((n, 1))])
    # the largest curvature bounds the step
    v = np.ones(d + 1)
    for _ in range(30):
        u = full.T @ (weight * (full @ v)) / 4
        u[:d] += gram @ v[:d] + ridge * v[:d]
        size = np.linalg.norm(u)
        v = u / max(size, 1e-12)
    step = 0.9 / max(size, 1e-9)
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        grad = full.T @ (weight * (p - y))
        grad[:d] += gram @ z[:d] + ridge * z[:d]
        new = z - step * grad
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * lasso, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return w[:d], float(w[d])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, most_terms: int = 1024, least_chi: float = 15.0, penalty: float = 5.0) -> dict:
    """{"weights": {word: weight}, "bias": b} from rows whose crc32(doc_id as text) mod 4 is not 2.

    The sample takes up to most_rows labelled documents of each class, by smallest xxhash64 of
    their id (ties: smaller id), and reads their whole texts. All their words and beginnings are
    weighed by chi-square; those below least_chi tell too little to be told from chance, and of
    the others the model uses the most_terms highest (ties: first by name) beside all features of
    the identity terms. These bounds hold at every size; the driver gets at most 2 * most_rows
    rows of so many numbers. Null labels, ids and texts are left out; an id with several labels
    counts as toxic if any says so. Without both classes the model has no weights and says
    toxic (bias 2) or clean (bias -2) throughout; so does it without any labels (clean).
    """
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.where(crc32_of(F.col("doc_id")) % 4 != 2).withColumn("toxic", (F.col("toxic") == 1).cast("int")))
    all_of = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = stored(bounded_sample(known, "toxic", "doc_id", most_rows))  # at most 2 * most_rows ids
    texts = pick(docs, "doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    swap = swaps()
    other = F.create_map(*[F.lit(x) for pair in swap.items() for x in pair])
    found = texts.select("doc_id", "toxic", F.explode(words).alias("whole")).withColumn("other", F.coalesce(other[F.col("whole")], "whole"))

    def parts(word: str, kind):
        """Features of a word, marked 1 (of the text), 2 (of the swapped text) or 3 (of both)."""
        beginnings = [F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("-"))) for n in STEMS]
        every = F.filter(F.array(F.col(word), *beginnings), lambda w: w.isNotNull())
        return F.transform(every, lambda w: F.struct(w.alias("word"), kind.alias("kind")))

    moved = F.col("other") != F.col("whole")
    both = F.when(moved, F.concat(parts("whole", F.lit(1)), parts("other", F.lit(2)))).otherwise(parts("whole", F.lit(3)))
    words = stored(found.select("doc_id", "toxic", F.explode(both).alias("part")).groupBy("doc_id", "toxic", "part.word").agg(F.bit_or("part.kind").alias("kind")))
    own = words.where("kind & 1 = 1")
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {"weights": {}, "bias": 2.0 if pos else -2.0}
    hits = own.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(pos + neg)
    chi = n * F.pow(a * neg - b * pos, F.lit(2)) / ((a + b) * (n - a - b + 1) * pos * neg)
    chosen = hits.where("a + b >= 3").withColumn("chi", chi).where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "word").limit(most_terms)
    names = sorted({r["word"] for r in chosen.select("word").collect()} | {f for w in swap for f in features(w)})
    index = {w: i for i, w in enumerate(names)}
    terms = docs.sparkSession.createDataFrame(list(index.items()), "word string, i int")
    at = lambda bit: F.collect_list(F.when(F.col("kind").bitwiseAND(bit) > 0, F.col("i")))
    rows = words.join(F.broadcast(terms), "word").groupBy("doc_id", "toxic").agg(at(1).alias("at"), at(2).alias("swapped"))
    x, y = np.zeros((pos + neg, len(names)), np.float64), np.zeros(pos + neg)
    swapped = np.zeros_like(x)
    y[:pos] = 1
    row = {1: 0, 0: pos}
    for r in rows.orderBy("doc_id").collect():
        k = row[r["toxic"]]
        x[k, r["at"]] = swapped[k, r["swapped"]] = 1
        row[r["toxic"]] += 1
    w, bias = fit(x, y, swapped, all_of[1] / (all_of[0] + all_of[1]), penalty)
    return {"weights": {t: float(v) for t, v in zip(names, w) if v}, "bias": bias}


class _Scorer:
    """Scores of whole texts; a feature counts once in a text."""

    def __init__(self, model: dict):
        names = sorted(model["weights"])
        self.index = {f: i for i, f in enumerate(names)}
        self.weights, self.bias = np.array([model["weights"][f] for f in names], float), model["bias"]
        self.heads = {f.removesuffix("-")[:4] for f in names}  # of words that may have a feature

    def __call__(self, texts) -> np.ndarray:
        runs = Runs(as_texts(texts))
        total = np.full(len(texts), float(self.bias))
        if self.index and len(runs.unique):
            found, sizes, k = [], np.zeros(len(runs.unique), np.int64), 0
            for w in _word_or_end.findall("\n".join(runs.unique.to_pylist()).lower() + "\n"):
                if w == "\n":
                    k += 1
                elif w[:4] in self.heads:
                    for f in features(w):
                        if f in self.index:
                            found.append(self.index[f])
                            sizes[k] += 1
            each, ends = gathered(np.array(found, np.int64), sizes, runs.codes)
            text = np.searchsorted(np.concatenate([[0], ends])[runs.bounds], np.arange(len(each)), side="right") - 1
            once = np.unique(text * len(self.weights) + each)
            total += np.bincount(once // len(self.weights), self.weights[once % len(self.weights)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): whole texts, however long.

    A null or empty text has the score of no words; null ids and repeated rows keep their rows;
    an empty table gives no rows; other columns are left out.
    """

    def make():
        score = _Scorer(model)
        return lambda batch: {"doc_id": batch[0], "score": score(batch[1])}

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, score double", make)


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose score is below the threshold; nulls, repeats and empty tables as in scores()."""

    def make():
        score = _Scorer(model)
        return lambda texts: score(texts) < threshold

    return kept_rows(docs, "text", make)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """scores() of the whole table documents by a model learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held = crc32_of(F.col("doc_id")) % 4 == 2
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
