"""Operator 8: language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The likelihood
of a word sums the products of piece probabilities over all its segmentations, by a forward
pass; a text's is the product over its words. Piece probabilities are learned by expectation
maximisation on word counts: forward and backward sums give each piece's expected uses.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, as_texts, bounded_sample, crc32_of, kept_rows, once, per_batch, pick, stored, table
from .token_counts import SPACE, load

UNKNOWN = "und"
#: Letters of a word up to which passes run together and need no rescaling; words kept at most.
SHORT, KEPT = 32, 250_000
#: Over the characters of the longest piece.
REACH = 64
_word = re.compile(r"[^\W\d_]+")
_word_or_end = re.compile(r"[^\W\d_]+|\n")


def _vocabulary(path: str | None) -> tuple[dict[str, int], dict[str, int]]:
    """Lower-case pieces of letters, with or without the leading space mark; and their beginnings, with the piece's number or -1."""

    def make():
        names = sorted({p for p in load(path).score if p.lstrip(SPACE).isalpha() and p == p.lower() and p.count(SPACE) < 2})
        pieces = {p: i for i, p in enumerate(names)}
        return pieces, {p[:n]: pieces.get(p[:n], -1) for p in names for n in range(1, len(p) + 1)}

    return once(("lang_vocabulary", path), make)


def lattice(word: str, starts: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in the marked word, by start; piece -1: a character without a piece."""
    s = SPACE + word
    n, out = len(s), []
    for start in range(n):
        if starts.get(s[start], -1) < 0:
            out.append((start, start + 1, -1))
        end = start + 1
        while end <= n:
            i = starts.get(s[start:end])
            if i is None:
                break
            if i >= 0:
                out.append((start, end, i))
            end += 1
    return out


def log_likelihood(word: str, starts: dict[str, int], columns: list[list[float]]) -> list[float]:
    """Log of the sum over all segmentations, by a forward pass for each language's piece probabilities.

    Sums that get small are scaled up, with all that still follow from them.
    """
    arcs, n = lattice(word, starts), len(word) + 1
    out = []
    for p in columns:
        alpha, log, at = [1.0] + [0.0] * n, 0.0, 0
        for start, end, i in arcs:
            if start != at:
                at = start
                if alpha[at] < 1e-100:
                    low = alpha[at] or 1e-300
                    log += math.log(low)
                    alpha[at : at + REACH] = [x / low for x in alpha[at : at + REACH]]  # no piece reaches further
            alpha[end] += alpha[start] * p[i]
        out.append(math.log(alpha[n] or 1e-300) + log)
    return out


def _expected(word: str, starts: dict[str, int], row: list[float], times: float, used: np.ndarray) -> None:
    """Adds each piece's expected uses in one word of any length: forward and backward sums with a scale for each place."""
    arcs, n = lattice(word, starts), len(word) + 1
    by_end: dict[int, list] = {}
    for start, end, i in arcs:
        by_end.setdefault(end, []).append((start, i))
    # place e holds alpha times the product of all scales up to e, so no product of many small numbers is made
    alpha, log = [1.0] + [0.0] * n, [0.0] * (n + 1)
    for e in range(1, n + 1):
        parts = [alpha[s] * row[i] * math.exp(log[s] - log[e - 1]) for s, i in by_end.get(e, ())]
        total = sum(parts)
        if not total:
            return
        alpha[e], log[e] = 1.0, log[e - 1] + math.log(total)
    beta = [0.0] * n + [1.0]  # share of all segmentations' weight that passes each place
    for e in range(n, 0, -1):
        if beta[e]:
            for s, i in by_end[e]:
                share = beta[e] * row[i] * math.exp(log[s] - log[e])
                beta[s] += share
                used[i] += times * share


def learn(counts: dict[str, dict[str, int]], tokenizer: str | None = None, rounds: int = 3, prior: float = 0.05) -> dict:
    """{"langs": [...], "p": (languages, pieces + 1)} from {lang: {word: count}}; the last column is a character without a piece."""
    pieces, starts = _vocabulary(tokenizer)
    langs = sorted(counts)
    size = len(pieces) + 1
    p = np.full((len(langs), size), 1.0 / size)
    p[:, -1] = 1e-6
    arcs = Arcs(pieces)
    for k, lang in enumerate(langs):
        words = sorted(counts[lang])
        short = [w for w in words if len(w) <= SHORT]
        parts = [(arcs(some), np.array([counts[lang][w] for w in some], float)) for some in (short[i : i + 8192] for i in range(0, len(short), 8192))]
        for _ in range(rounds):
            used = np.full(size, prior)
            for found, times in parts:
                used += found.expected(p[k], times)
            row = p[k].tolist()
            for w in words:
                if len(w) > SHORT:
                    _expected(w, starts, row, counts[lang][w], used)
            p[k] = used / used.sum()
    return {"langs": langs, "p": p, "tokenizer": tokenizer}


def train(docs: DataFrame, most_docs: int = 200, tokenizer: str | None = None) -> dict:
    """Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 3 is not 1.

    The sample takes up to most_docs documents a language, by smallest xxhash64 of their id, and
    all words of their whole texts: a bound that holds at every size. Null ids, texts and
    languages are left out; an id that repeats counts once for each of its rows. Without rows
    the model knows no language.
    """
    known = pick(docs, "doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null").where(crc32_of(F.col("doc_id")) % 3 != 1)
    ids = stored(bounded_sample(known.select("doc_id", "lang").distinct(), "lang", "doc_id", most_docs))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    counts = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    by_lang: dict[str, dict[str, int]] = {}
    for r in counts.collect():  # words of at most most_docs documents a language
        by_lang.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return learn(by_lang, tokenizer)


class Arcs:
    """Pieces in words, found by an Aho-Corasick automaton of all pieces."""

    def __init__(self, pieces: dict[str, int]):
        self.none = len(pieces)
        self.find = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self.find.add_word(piece, len(piece) << 20 | i)
        self.find.make_automaton()

    def __call__(self, words: list[str]) -> Lattice:
        line = "\n".join([SPACE + w for w in words]) + "\n"
        n = np.array([len(w) + 1 for w in words])
        begin = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        word_at = np.repeat(np.arange(len(words)), n + 1)
        found = np.array([at << 26 | value for at, value in self.find.iter(line)], np.int64)
        at, value = found >> 26, found & (1 << 26) - 1
        length, piece = value >> 20, value & (1 << 20) - 1
        # a character that is no piece is an arc of its own
        lone = np.ones(len(line), bool)
        lone[at[length == 1]] = False
        lone[begin + n] = False
        lone = np.nonzero(lone)[0]
        at, length, piece = np.concatenate([at, lone]), np.concatenate([length, np.ones_like(lone)]), np.concatenate([piece, np.full_like(lone, self.none)])
        word = word_at[at]
        end = at - begin[word] + 1
        order = np.argsort(end << 40 | word)
        return Lattice(n, word[order], end[order], length[order], piece[order])


class Lattice:
    """Arcs of many words, by end and word; a word with its mark has n characters."""

    def __init__(self, n: np.ndarray, word: np.ndarray, end: np.ndarray, length: np.ndarray, piece: np.ndarray):
        self.n, self.word, self.end, self.length, self.piece = n, word, end, length, piece
        self.bounds = np.searchsorted(end, np.arange(1, int(n.max()) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(words, places, languages) of forward sums, for piece probabilities p of shape (pieces, languages)."""
        word, length = self.word, self.length
        alpha = np.zeros((len(self.n), int(self.n.max()) + 1, p.shape[1]))
        alpha[:, 0] = 1
        for e, (i, j) in enumerate(zip(self.bounds, self.bounds[1:]), 1):
            if i < j:
                w = word[i:j]
                first = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
                alpha[w[first], e] = np.add.reduceat(alpha[w, e - length[i:j]] * p[self.piece[i:j]], first, axis=0)
        return alpha

    def expected(self, row: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, words counted `times` each."""
        alpha = self.forward(row[:, None])[:, :, 0]
        total = alpha[np.arange(len(self.n)), self.n]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.n)), self.n] = np.divide(times, total, out=np.zeros_like(times), where=total > 0)
        used = np.zeros(len(row))
        for e in range(len(self.bounds) - 1, 0, -1):
            i, j = self.bounds[e - 1], self.bounds[e]
            w, start, piece = self.word[i:j], e - self.length[i:j], self.piece[i:j]
            weight = row[piece] * beta[w, e]
            np.add.at(beta, (w, start), weight)
            used += np.bincount(piece, alpha[w, start] * weight, len(row))
        return used


class Forward:
    """Forward passes of many words at once."""

    def __init__(self, pieces: dict[str, int], starts: dict[str, int], p: np.ndarray):
        self.starts, self.columns = starts, [row.tolist() for row in p]
        self.p = np.ascontiguousarray(p.T)
        self.arcs = Arcs(pieces)

    def __call__(self, words: list[str]) -> np.ndarray:
        """(words, languages) of log likelihoods."""
        out = np.empty((len(words), self.p.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        for k in range(0, len(short), 8192):
            part = short[k : k + 8192]
            found = self.arcs([words[i] for i in part])
            out[part] = np.log(np.maximum(found.forward(self.p)[np.arange(len(part)), found.n], 1e-300))
        for k, w in enumerate(words):
            if len(w) > SHORT:
                out[k] = log_likelihood(w, self.starts, self.columns)
        return out


class Scorer:
    """Languages of whole texts; the likelihoods of a worker's recent words are kept."""

    def __init__(self, model: dict):
        pieces, starts = _vocabulary(model["tokenizer"])
        self.langs = model["langs"]
        self.forward = Forward(pieces, starts, model["p"]) if self.langs else None
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.of_word = np.empty((KEPT, len(self.langs)))

    def _of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each run the sums over its words, and how many words it has."""
        found = _word_or_end.findall("\n".join(runs).lower() + "\n")
        new = list({w for w in found if w not in self.words and w != "\n"})
        if len(self.words) + len(new) > KEPT:
            self._clear()
            new = list(set(found) - {"\n"})
        n = len(self.words)
        if n + len(new) > len(self.of_word):  # a text with very many different words
            self.of_word = np.vstack([self.of_word[:n], np.empty((len(new), len(self.langs)))])
        self.words.update(zip(new, range(n, n + len(new))))
        if new:
            self.of_word[n : n + len(new)] = self.forward(new)
        words = self.words
        words["\n"] = -1
        at = np.fromiter((words[w] for w in found), np.int64, len(found))
        del words["\n"]
        ends = np.nonzero(at < 0)[0]
        ends -= np.arange(len(ends))
        return _sums(self.of_word, at[at >= 0], np.concatenate([[0], ends])), np.diff(ends, prepend=0)

    def __call__(self, texts) -> list[tuple[str, float]]:
        """Of an array of texts: language and its posterior under equal priors; ties go to the language that comes first."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        runs = Runs(as_texts(texts))
        sums, words = self._of_runs(runs.unique.to_pylist()) if len(runs.unique) else (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))
        total = _sums(sums, runs.codes, runs.bounds)
        told = _sums(words[:, None].astype(float), runs.codes, runs.bounds)[:, 0] > 0
        best = np.argmax(total, axis=1)
        score = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(axis=1)
        return [(self.langs[b], s) if t else (UNKNOWN, 0.0) for b, s, t in zip(best.tolist(), score.tolist(), told.tolist())]


def _sums(values: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[at[a:b]] between neighbouring bounds, column by column; none: zero."""
    out = np.zeros((len(bounds) - 1, values.shape[1]))
    some = np.nonzero(np.diff(bounds) > 0)[0]
    if len(some):
        for k in range(values.shape[1]):
            out[some, k] = np.add.reduceat(values[:, k][at[: bounds[-1]]], bounds[some])
    return out


def predictions(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior under equal priors.

    `und` with score 0 where the text is null or has no letter, or no language was learned. A very
    long text is scored whole, alone; null ids and repeated rows keep their rows; an empty table
    gives none; other columns are left out.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        scorer = once(("lang_scorer", key), lambda: Scorer(shared.value))

        def run(batch):
            found = scorer(batch[1])
            return {"doc_id": batch[0], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, lang_pred string, score double", make)


def keep_told(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose language is told with at least this posterior; `und` goes.

    Repeated rows and rows with null ids stay if their text does; an empty table gives no rows.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        scorer = once(("lang_scorer", key), lambda: Scorer(shared.value))
        return lambda texts: [x != UNKNOWN and s >= least for x, s in scorer(texts)]

    return kept_rows(docs, "text", make)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """predictions() for the whole table documents by a model learned from its rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc32_of(F.col("doc_id")) % 3 == 1, F.lit(False))
    return predictions(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
