"""Operator 6: exact token counts at every prefix of a text.

The pieces of a BPE encoding are right exactly when each two neighbours are: encoding their
joined text gives just these two. So the last piece of every prefix is the one piece that
ends there and follows validly on the last piece of the prefix before it, and a prefix has
one piece more than the prefix it extends. One pass stores the count at every prefix; after
that, questions of length, truncation and budget need no encoding.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_texts, at_bounds, gathered, once, per_batch, pick, table

SPACE = "▁"
#: Characters of a run up to which runs are counted many at a time.
SHORT = 40
_runs = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def _fields(raw: bytes):
    """(field, value) of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        n = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, raw[i : i + n]
        i += n


class PieceBpe:
    """A piece model's BPE with byte fallback, identity normalisation and a leading space."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.score: dict[str, float] = {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) in (1, 4, 5):  # normal, user-defined, unused
                    self.score[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        self.longest = max(map(len, self.score))
        #: neighbours within some piece; between any others a text falls into independent parts
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.by_part = Memo(self._deltas, most=50_000, longest=32)
        self.names = sorted(self.score)
        self.find = ahocorasick.Automaton()
        for i, piece in enumerate(self.names, 1):
            self.find.add_word(piece, len(piece) << 20 | i)
        self.find.make_automaton()
        #: (last piece, next piece) as one number, ascending, and whether the second may follow; new ones wait in a dict
        self.pairs, self.valid, self.waiting = np.empty(0, np.int64), np.empty(0, bool), {}
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or "\n" in self.score:
            raise ValueError("the model has pieces across spaces or lines")
        self.follows = Memo(self._follows, most=200_000, longest=4)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by plain merging: the highest score first, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, pair: tuple[str, str]) -> bool:
        a, b = pair
        return self.merge(a + b) == ([a, b] if a else [b])

    def deltas(self, run: str) -> bytes:
        """Change of the count with each character of a run, as 16-bit integers."""
        inside, parts, start = self.inside, [], 0
        for i in range(1, len(run)):
            if run[i - 1 : i + 1] not in inside:
                parts.append(self.by_part[run[start:i]])
                start = i
        parts.append(self.by_part[run[start:]])
        return b"".join(parts)

    def _deltas(self, run: str) -> bytes:
        n, score, follows, longest = len(run), self.score, self.follows, self.longest
        last, count = [""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            c = run[end - 1]
            if c not in score:  # bytes; nothing merges with it
                count[end] = count[end - 1] + len(c.encode())
                continue
            for start in range(max(0, end - longest), end):
                piece = run[start:end]
                if piece in score and follows[last[start], piece]:
                    last[end], count[end] = piece, count[start] + 1
                    break
            else:
                raise AssertionError("no piece ends here")
        return np.diff(np.array(count, np.int32)).astype("<i2").tobytes()

    def may_follow(self, keys: np.ndarray, most: int = 2_000_000) -> np.ndarray:
        """Whether the second piece of each pair may follow the first (number 0: the beginning)."""
        out = np.zeros(len(keys), bool)
        unknown = np.ones(len(keys), bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            unknown = self.pairs[at] != keys
            out = self.valid[at]
        if unknown.any():
            new, back = np.unique(keys[unknown], return_inverse=True)
            told, waiting = [], self.waiting
            for k in new.tolist():
                if k not in waiting:
                    a, b = k >> 20, k & (1 << 20) - 1
                    waiting[k] = self._follows((self.names[a - 1] if a else "", self.names[b - 1]))
                told.append(waiting[k])
            out[unknown] = np.array(told)[back]
            if len(waiting) > 20_000:
                if len(self.pairs) > most:
                    self.pairs, self.valid = self.pairs[:0], self.valid[:0]
                pairs = np.concatenate([self.pairs, np.fromiter(waiting, np.int64, len(waiting))])
                valid = np.concatenate([self.valid, np.fromiter(waiting.values(), bool, len(waiting))])
                order = np.argsort(pairs)
                self.pairs, self.valid = pairs[order], valid[order]
                waiting.clear()
        return out

    def deltas_batch(self, runs: list[str]) -> list[bytes]:
        """deltas() of many runs of at most SHORT characters: the same programme, a step for each end in all runs at once.

        An automaton finds every piece in every run; of the pieces that end at a place the
        longest that may follow the last piece before it is the one there.
        """
        line = "\n".join(runs) + "\n"
        n = np.fromiter(map(len, runs), np.int64, len(runs))
        begin = np.cumsum(n + 1) - n - 1
        of = np.repeat(np.arange(len(runs)), n + 1)
        found = np.array([at << 26 | value for at, value in self.find.iter(line)], np.int64)
        at, length, piece = found >> 26, found >> 20 & 63, found & (1 << 20) - 1
        lone = np.ones(len(line), bool)
        lone[at[length == 1]] = False
        lone[begin + n] = False
        lone = np.nonzero(lone)[0]  # characters that are no piece count as their bytes
        width = np.array([len(line[i].encode()) for i in lone.tolist()], np.int32)
        lone_run, lone_end = of[lone], lone - begin[of[lone]] + 1
        run = of[at]
        end = at - begin[run] + 1
        order = np.argsort(end << 40 | run << 6 | 63 - length)
        run, end, length, piece = run[order], end[order], length[order], piece[order]
        steps = int(n.max())
        last, count = np.zeros((len(runs), steps + 1), np.int64), np.zeros((len(runs), steps + 1), np.int32)
        bounds = np.searchsorted(end, np.arange(1, steps + 2))
        reached = 0
        for e, (i, j) in enumerate(zip(bounds, bounds[1:]), 1):
            alone = lone_end == e
            if alone.any():
                count[lone_run[alone], e] = count[lone_run[alone], e - 1] + width[alone]
                reached += int(alone.sum())
            if i < j:
                w, start = run[i:j], e - length[i:j]
                ok = np.nonzero(self.may_follow(last[w, start] << 20 | piece[i:j]))[0]
                ok = ok[np.concatenate([[True], w[ok][1:] != w[ok][:-1]])]
                last[w[ok], e], count[w[ok], e] = piece[i:j][ok], count[w[ok], start[ok]] + 1
                reached += len(ok)
        if reached != int(n.sum()):
            raise AssertionError("no piece ends somewhere")
        inside = np.arange(1, steps + 1) <= n[:, None]
        raw = np.diff(count, axis=1).astype("<i2")[inside].tobytes()
        stops = (2 * np.cumsum(n)).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def entries(self, words: list[str], memo: dict[str, bytes], most: int = 400_000) -> list[bytes]:
        """Deltas of what follows a space; a word that begins with a new line follows none. memo is kept up to `most` words."""
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > most:
            memo.clear()
            new = words
        long = {}
        new = [(w, w if w[:1] == "\n" else SPACE + w) for w in new]
        short = [x for x in new if len(x[1]) <= SHORT]
        for k in range(0, len(short), 16384):
            part = short[k : k + 16384]
            memo.update(zip([w for w, _ in part], self.deltas_batch([r for _, r in part])))
        for w, r in new:
            if len(r) > SHORT:
                long[w] = self.deltas(r)
        return [long[w] if w in long else memo[w] for w in words] if long else [memo[w] for w in words]


def load(path: str | None) -> PieceBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return once(("piece_bpe", path), lambda: PieceBpe(path))


def _memos(path: str | None) -> tuple[PieceBpe, dict, Memo]:
    bpe = load(path)
    return bpe, *once(("piece_memo", path), lambda: ({}, Memo(bpe.deltas, most=50_000, longest=32)))


def prefix_deltas(text: str, path: str | None = None) -> bytes:
    """Change of the token count with each character of text (little-endian 16 bits each).

    Entry k is count(first k + 1 characters) - count(first k). The sum of the first k is the
    exact number of tokens of the first k characters.
    """
    if not text:
        return b""
    _, _, by_run = _memos(path)
    raw = b"".join([by_run[r] for r in _runs.findall(SPACE + text.replace(SPACE, " ").replace(" ", SPACE))])
    # the leading space is no character of the text: its count belongs to the first one
    first = int.from_bytes(raw[:2], "little", signed=True) + int.from_bytes(raw[2:4], "little", signed=True)
    return first.to_bytes(2, "little", signed=True) + raw[4:]


def _odd(texts: pa.Array) -> np.ndarray:
    """Texts whose white space is not one space between words."""
    found = pc.match_substring(texts, SPACE)
    for test in (pc.match_substring(texts, "  "), pc.match_substring(texts, " \n"), pc.starts_with(texts, " "), pc.starts_with(texts, "\n"), pc.ends_with(texts, " ")):
        found = pc.or_(found, test)
    return pc.or_(found, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)


def deltas_many(texts: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """prefix_deltas() of many texts: (deltas, bounds), text k has deltas[bounds[k]:bounds[k + 1]].

    What stands between two spaces is looked up once for all texts. A null text has none.
    """
    texts = as_texts(texts)
    odd = _odd(texts)
    apart = {int(k): np.frombuffer(prefix_deltas(texts[int(k)].as_py(), path), "<i2") for k in np.nonzero(odd)[0]}
    plain = texts.filter(pa.array(~odd))
    bpe, by_word, _ = _memos(path)
    found = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    coded = found.flatten().dictionary_encode()
    blocks = bpe.entries(coded.dictionary.to_pylist(), by_word)
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks)) >> 1
    flat, ends = gathered(np.frombuffer(b"".join(blocks), "<i2"), sizes, coded.indices.to_numpy())
    bounds = at_bounds(ends, np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)]))
    # the leading space is no character of the text: its count belongs to the first one
    first = bounds[:-1]
    flat[first + 1] += flat[first]
    kept = np.ones(len(flat), bool)
    kept[first] = False
    flat, bounds = flat[kept], bounds - np.arange(len(bounds))
    if not apart:
        return flat, bounds
    rows = iter(zip(bounds.tolist(), bounds[1:].tolist()))
    parts = [apart[k] if k in apart else flat[slice(*next(rows))] for k in range(len(texts))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def totals(deltas: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each whole text."""
    return np.diff(np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])[bounds])


def count_at(deltas: bytes, characters: int | None = None) -> int:
    """Tokens of the first `characters` characters (None: of all)."""
    return int(np.frombuffer(deltas, "<i2")[:characters].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64)
    within = np.nonzero(counts <= budget)[0]
    return int(within[-1]) + 1 if len(within) else 0


def prefix_table(docs: DataFrame, model: str | None = None, budget: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix_deltas binary, within_budget): the stored counts of every prefix.

    A null text counts as empty: 0 bytes, 0 tokens, no deltas. within_budget is the number of
    characters of the longest prefix of at most `budget` tokens (null without a budget).
    """

    def make():
        def run(batch):
            flat, bounds = deltas_many(batch[1], model)
            deltas = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            return {
                "doc_id": batch[0], "n_bytes": pc.fill_null(pc.binary_length(batch[1]), 0).cast(pa.int64()), "n_tokens": totals(flat, bounds),
                "prefix_deltas": deltas, "within_budget": [None if budget is None else longest_within(d, budget) for d in deltas],
            }

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary, within_budget long", make)


def counts(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): totals from the prefix counts, which stay in the task.

    Nulls as in prefix_table(); repeated rows and null ids stay as they are.
    """

    def make():
        def run(batch):
            return {"doc_id": batch[0], "n_bytes": pc.fill_null(pc.binary_length(batch[1]), 0).cast(pa.int64()), "n_tokens": totals(*deltas_many(batch[1], model))}

        return run

    found = per_batch(pick(docs, "doc_id", "text"), "doc_id long, n_bytes long, n_tokens long", make)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """counts() of the whole table documents with the file piece_bpe_32k.model and the limit 4096."""
    return counts(table(spark, sf_dir, "documents"))
