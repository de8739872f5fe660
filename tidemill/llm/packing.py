"""Operator 9: best-two-fit packing of token sequences.

Only lengths matter to a packing, and there are at most `size` of them. So the plan is made
from the histogram of lengths: a bin is filled greedily, largest fitting length first; then
its smallest document gives way to two unpacked documents that fit the expanded gap more
tightly. The bin so found is repeated as often as the remaining counts allow, which uses up
at least one length: the number of distinct bins, and the driver's work, depend on `size`
and not on the number of documents. Pieces then find their place by their rank within their
length, which comes from counts per task.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, pick, stored, table
from .word_bpe import load

SIZE = 2048


def _fill(lengths: list[int], count: dict[int, int], size: int) -> dict[int, int]:
    """One bin: {length: uses}. lengths: those with a count, ascending."""
    used: dict[int, int] = {}
    gap = size
    top = len(lengths) - 1
    while gap and (top := min(top, bisect_right(lengths, gap) - 1)) >= 0:
        length = lengths[top]
        n = min(count[length], gap // length)
        used[length] = n
        gap -= n * length
        top -= 1
    if gap:
        small = min(used)
        room, best, pair = gap + small, small, None
        left = lambda x: count[x] - used.get(x, 0)
        lo, hi = 0, bisect_right(lengths, room) - 1
        while lo <= hi:  # two pointers: the largest sum of two that fits
            a, b = lengths[lo], lengths[hi]
            if left(a) < 1:
                lo += 1
            elif left(b) < 1 or a + b > room:
                hi -= 1
            elif lo == hi:
                if left(a) > 1 and a + b > best:
                    best, pair = a + b, (a, b)
                break
            else:
                if a + b > best:
                    best, pair = a + b, (a, b)
                lo += 1
        if pair:
            used[small] -= 1
            for x in pair:
                used[x] = used.get(x, 0) + 1
    return {x: n for x, n in used.items() if n}


def plan(count: dict[int, int], size: int = SIZE) -> tuple[dict[int, list], int]:
    """Places for count[length] pieces of each length, 1 <= length <= size.

    Returns {length: [(first rank, uses per bin, first bin, offset of the first use)]} and the
    number of bins. Rank r of an entry is in bin first + (r - rank) // uses, at offset +
    length * ((r - rank) % uses).
    """
    count = {x: n for x, n in count.items() if n > 0}
    lengths = sorted(count)
    taken = dict.fromkeys(lengths, 0)
    places: dict[int, list] = {x: [] for x in lengths}
    bins = 0
    while lengths:
        used = _fill(lengths, count, size)
        times = min(count[x] // n for x, n in used.items())
        at = 0
        for x in sorted(used, reverse=True):
            places[x].append((taken[x], used[x], bins, at))
            taken[x] += times * used[x]
            count[x] -= times * used[x]
            at += used[x] * x
            if not count[x]:
                lengths.remove(x)
        bins += times
    return places, bins


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to rows with length (1..size), task and rank_in_task.

    rank_in_task counts the rows of one length within one task from 0. Collected: one row for
    each length, at most `size`. Counts by task and length are summed in a window per length,
    which sees a row for each task.
    """
    spark = pieces.sparkSession
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = plan(totals, size)
    shared = spark.sparkContext.broadcast({x: np.array(v, dtype=np.int64) for x, v in places.items()})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank_in_task")).alias("rank")
    )

    def make():
        plans = shared.value

        def run(batch):
            got = batch.to_pydict()
            length, rank = np.array(got["length"], dtype=np.int64), np.array(got.pop("rank"), dtype=np.int64)
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, entries = length == x, plans[int(x)]
                e = entries[np.searchsorted(entries[:, 0], rank[at], side="right") - 1]
                past = rank[at] - e[:, 0]
                bins[at] = e[:, 2] + past // e[:, 1]
                offsets[at] = e[:, 3] + x * (past % e[:, 1])
            return got | {"sequence_id": bins, "offset": offsets}

        return run

    return per_batch(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)


def cut(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of at most `size` ids of each document's ids followed by id 0, with their rank by length and task."""

    def make():
        # merges by the library's model; texts are split as operator 4 does
        bpe = load(tokenizer, library=True)
        task, ranks = TaskContext.get().partitionId(), array("q", [0] * (size + 1))

        def run(batch):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task")}
            ids, bounds = bpe.encode_many(batch[1])
            raw, bounds = memoryview(ids.tobytes()), bounds.tolist()
            for doc, a, b in zip(batch[0].to_pylist(), bounds, bounds[1:]):
                for piece, start in enumerate(range(0, b - a + 1, size)):
                    end = min(start + size, b - a + 1)
                    crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + end, b)])
                    if end > b - a:  # the id 0 after the document
                        crc = zlib.crc32(bytes(4), crc)
                    length = end - start
                    for k, v in zip(out, (doc, piece, start, length, crc, task, ranks[length])):
                        out[k].append(v)
                    ranks[length] += 1
            return out

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long", make, most=1 << 20)


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces in sequences of at most `size` ids.

    A null or empty text has the one id 0; null doc_ids and repeated rows are packed like any
    other row; an empty table gives no rows; other columns are left out. The pieces are stored
    before they are counted, so that a lost executor can't change a rank.
    """
    return place(stored(cut(docs, size, tokenizer)), size)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """pack() of the whole table documents: sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
