"""Word-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

Follows the public file format "tokenizer.json" for a BPE model with word ends, the
normalisers NFC / white space / lower case, a Split pre-tokeniser and byte symbols.

Each word's symbols are the leaves of a segment tree that holds the merge rank of every
adjacent pair. The root is the lowest rank; walking down and preferring the left child
yields its leftmost place. A merge changes three leaves, each updated in logarithmic
time, until the root says that no pair merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from .common import Memo, Runs, as_texts, at_bounds, gathered, once, top_bytes

NONE = 1 << 30
#: From here on, letters and digits may differ between Unicode versions.
NEW = "\u0530"
#: Separators 28 to 31 are white space to Python but not to the tokeniser's patterns.
_odd_space = re.compile("[\x1c-\x1f]")
_space = regex.compile(r"(?:\S|[\x1c-\x1f])+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str, library: bool = False):
        """library: merges by the tokeniser library's own model instead of the segment tree."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])"))
        # the same pattern with classes written out for characters below NEW
        chars = [chr(c) for c in range(ord(NEW))]
        cls = lambda first: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == first)
        white = "\\t-\\r \x85\xa0"
        rest = split["pattern"]["Regex"].replace(r"[\p{L}]", f"[{cls('L')}]").replace(r"[\p{N}]", f"[{cls('N')}]")
        self.low_pieces = re.compile(rest.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{cls('L')}{cls('N')}]") + "|\n")
        self.ascii_pieces = re.compile(split["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", "a-z0-9\t-\r ") + "|\n")
        #: ids of a piece as bytes (little-endian, 32 bits)
        self.by_piece = Memo(self.piece, most=120_000, longest=32)
        if not library:  # what the segment tree and decoding need
            self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
            self.merges = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(model["merges"])))}
            self.merged = [vocab[a + b] for a, b in model["merges"]]
            self.inner = [vocab[s] for s in symbols]
            self.last = [vocab[s + self.end] for s in symbols]
            self.keys = np.array(sorted(self.merges), np.int64)
            self.ranks = np.array([self.merges[k] for k in self.keys.tolist()], np.int32)
            self.merged_ids, self.inner_ids, self.last_ids = np.array(self.merged, np.int32), np.array(self.inner, np.int32), np.array(self.last, np.int32)
        spec = model = vocab = None  # tens of MB as Python objects, before the library reads the file again
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.model = tokenizer.model if library else None
        self.symbols = {b: s for b, s in enumerate(symbols) if b != 10}  # a line feed ends a piece here
        self.by_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = [s[:2] for s in self.special]

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols of one word after all merges."""
        n = len(ids)
        if n == 1:
            return ids
        rank, merged = self.merges.get, self.merged
        size = 1 << max(0, (n - 2).bit_length())
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank(ids[i] << 20 | ids[i + 1], NONE)
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        while (best := tree[1]) != NONE:
            i = 1
            while i < size:
                i *= 2
                if tree[i] != best:
                    i += 1
            i -= size
            j = after[i]
            new = ids[i] = merged[best]
            ids[j] = -1
            k = after[i] = after[j]
            changed = []
            if k < n:
                before[k] = i
                changed.append((i, rank(new << 20 | ids[k], NONE)))
                changed.append((j, NONE))
            else:
                changed.append((i, NONE))
            if i:
                p = before[i]
                changed.append((p, rank(ids[p] << 20 | new, NONE)))
            for leaf, value in changed:
                leaf += size
                tree[leaf] = value
                while leaf > 1:
                    leaf >>= 1
                    a, b = tree[2 * leaf], tree[2 * leaf + 1]
                    if b < a:
                        a = b
                    if tree[leaf] == a:
                        break
                    tree[leaf] = a
        return [x for x in ids if x >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NONE where a pair doesn't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """merge() of many short words at once, each with a segment tree of its own: arrays of trees of one size.

        Returns each word's ids as bytes.
        """
        out: list = [b""] * len(raws)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        pairs = np.maximum(lengths - 1, 1)
        size = 1
        while size < 64:
            chosen = np.nonzero((pairs <= size) & (pairs > size // 2) & (lengths > 0))[0]
            for k in range(0, len(chosen), 1 << 14):
                part = chosen[k : k + (1 << 14)]
                self._merge_batch([raws[i] for i in part.tolist()], part.tolist(), lengths[part], size, out)
            size *= 2
        for i in np.nonzero(pairs > 32)[0].tolist():
            ids = [self.inner[b] for b in raws[i]]
            ids[-1] = self.last[raws[i][-1]]
            out[i] = np.array(self.merge(ids), "<u4").tobytes()
        return out

    def _merge_batch(self, raws: list[bytes], places: list[int], n: np.ndarray, size: int, out: list) -> None:
        rows = len(raws)
        width = size + 1
        flat = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum(n)
        symbols = self.inner_ids[flat]
        symbols[ends - 1] = self.last_ids[flat[ends - 1]]
        ids = np.full((rows, width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = symbols
        tree = np.full((rows, 2 * size), NONE, np.int32)
        real = np.arange(size) < n[:, None] - 1
        tree[:, size:][real] = self._rank(ids[:, :-1][real], ids[:, 1:][real])
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 1), (rows, 1)).ravel()
        before = np.tile(np.arange(-1, width - 1), (rows, 1)).ravel()
        t, x = tree.ravel(), ids.ravel()
        active = np.arange(rows)
        active = active[t[active * 2 * size + 1] != NONE]
        while len(active):
            root, own, count = active * 2 * size, active * width, n[active]
            best = t[root + 1]
            at = np.ones(len(active), np.int64)
            while at[0] < size:
                at *= 2
                at += t[root + at] != best
            i = at - size
            j = after[own + i]
            new = self.merged_ids[best]
            x[own + i], x[own + j] = new, -1
            k = after[own + j]
            after[own + i] = k
            more = k < count
            follow = np.where(more, k, 0)
            before[(own + k)[more]] = i[more]
            t[root + size + i] = np.where(more, self._rank(new, x[own + follow]), NONE)
            t[(root + size + j)[more]] = NONE
            prior = i > 0
            p = np.where(prior, before[own + i], 0)
            t[(root + size + p)[prior]] = self._rank(x[own + p], new)[prior]
            paths = [at, np.where(more, size + j, at), np.where(prior, size + p, at)]
            level = size
            while level > 1:
                level //= 2
                for m, path in enumerate(paths):
                    path = paths[m] = path >> 1
                    t[root + path] = np.minimum(t[root + 2 * path], t[root + 2 * path + 1])
            active = active[t[root + 1] != NONE]
        kept = ids >= 0
        raw = ids[kept].astype("<u4").tobytes()
        stops = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        start = 0
        for place, stop in zip(places, stops):
            out[place] = raw[start:stop]
            start = stop

    def split_pieces(self, words: pa.Array) -> list[str]:
        """Pieces of runs without white space, all in one list; a line feed ends each run."""
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_string())), pa.scalar("\n", pa.large_string()))
        # lower case is per character: a final sigma has no form of its own here
        line = joined[0].as_py().replace("Σ", "σ").lower() + "\n"
        if line.isascii():
            return self.ascii_pieces.findall(line)
        if np.frombuffer(line.encode(), np.uint8).max() < 0xD4:  # below U+0500
            return self.low_pieces.findall(line)
        out: list[str] = []
        for w in words.to_pylist():
            out += self.low_pieces.findall(w.replace("Σ", "σ").lower()) if not w or max(w) < NEW else self.library_pieces(w)
            out.append("\n")
        return out

    def blocks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs, joined, and how many each has."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        pieces = self.split_pieces(words)
        memo = self.by_piece
        new = [p for p in set(pieces) if p not in memo]
        if len(memo) + len(new) > memo.most:
            memo.clear()
            new = list(set(pieces))
        memo["\n"], long = b"", {}
        if new:
            new = [p for p in new if p != "\n"]
            found = self.model_many(new) if self.model else self.merge_many([p.encode() for p in new])
            for p, ids in zip(new, found):
                (memo if len(p) <= memo.longest else long)[p] = ids
        rows = [memo[p] for p in pieces] if not long else [long[p] if p in long else memo[p] for p in pieces]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) >> 2
        ends = np.cumsum(sizes)[sizes == 0]  # a line feed is the only one without ids
        return np.frombuffer(b"".join(rows), "<u4"), np.diff(ends, prepend=0)

    def word(self, word: str) -> list[int]:
        """Ids of a run without white space."""
        return self.blocks(pa.array([word], pa.large_string()))[0].tolist()

    def library_pieces(self, word: str) -> list[str]:
        """Lower case and pieces by the tokeniser library: newer characters have classes of its own Unicode version."""
        low = self.normalizer.normalize_str(word)
        return [low[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(low)]

    def piece(self, piece: str) -> bytes:
        return (self.model_many([piece]) if self.model else self.merge_many([piece.encode()]))[0]

    def model_many(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, as bytes, by the library's model."""
        coded = "\n".join(pieces).encode().decode("latin-1").translate(self.symbols).split("\n")
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(p)]).tobytes() for p in coded]

    def words(self, text: str) -> list[str]:
        """Runs whose ids, one after the other, are the ids of the text; special strings are runs of their own."""
        if any(m in text for m in self.marks):
            return [w for part in self.by_special.split(text) for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    @staticmethod
    def _words(text: str) -> list[str]:
        if text.isascii():
            return _space.findall(text) if _odd_space.search(text) else text.split()
        text = WordBpe.composed(text)
        return _space.findall(text) if _odd_space.search(text) else text.split()

    def ids_of(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.word(word)

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.ids_of(w)]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text k has ids[bounds[k]:bounds[k + 1]]; a null text has none.

        Runs are encoded once for all texts. Texts with characters from U+0300 on are normalised
        first; texts with a special string are encoded apart.
        """
        texts = as_texts(texts)
        special = pc.match_substring(texts, self.marks[0]).to_numpy(zero_copy_only=False) if self.marks else np.zeros(len(texts), bool)
        for mark in self.marks[1:]:
            special = special | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        high = top_bytes(texts) >= 0xCC
        apart = {int(k): np.array(self.encode(texts[int(k)].as_py()), "<u4") for k in np.nonzero(special)[0]}
        if high.any() or apart:
            rows = texts.to_pylist()
            for k in np.nonzero(high)[0]:
                rows[k] = self.composed(rows[k])
            for k in apart:
                rows[k] = ""
            texts = pa.array(rows, texts.type)
        runs = Runs(texts)
        ids, ends = gathered(*self.blocks(runs.unique), runs.codes)
        bounds = at_bounds(ends, runs.bounds)
        if apart:
            parts = [apart.get(k, ids[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds

    @staticmethod
    def composed(text: str) -> str:
        return unicodedata.normalize("NFC", text) if max(text) < NEW else NFC().normalize_str(text)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder. Unknown ids are left out."""
        return " ".join([self.token[i] for i in ids if i in self.token])


def load(path: str | None, library: bool = False) -> WordBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return once(("word_bpe", path, library), lambda: WordBpe(path, library))
