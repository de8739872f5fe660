"""Operator 5: approximate nearest neighbours by an HNSW graph per shard.

Largest inner product becomes nearest neighbour on a sphere: each vector of a shard gets one
more component that makes all norms equal, and a query gets 0 there. Graphs are flat arrays of
neighbour numbers, -1 for none. Insertion and search run on many vectors at a time, as array
operations. Each shard holds a bounded number of different vectors; its best are merged with
the other shards' by exact inner products of the original vectors in double precision. Only the
graph's own copies are of single precision, scaled so that they stay finite.

How long a search list must be depends on the data and on how many shards share the nearest:
with many, a shard need find only its first few. So each shard of over 1,024 vectors measures it
as it is built: 64 vectors that the graph doesn't hold yet are searched and compared with brute
force over the shard, and the shortest list whose recall is 0.96 or more is kept with the shard.
Smaller shards take 512.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored, table
from .components import hot_join

M, EF_BUILD, EF_SEARCH = 16, 80, 512
LISTS, HELD, RECALL = (64, 96, 128, 192, 256, 384, 512, 768, 1024, 2048), 64, 0.96


def scaled(vectors: np.ndarray, by) -> np.ndarray:
    """In double precision, divided by a largest component: the order of inner products is that of the originals."""
    return vectors.astype(np.float64) / by


class Hnsw:
    """layers[0] has a row of 2 M neighbours for each vector, layers[l] of M for each; level: the top layer of each."""

    def __init__(self, vectors: np.ndarray, level: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.level, self.layers, self.entry = vectors, level, layers, entry
        self.ef = EF_SEARCH

    @staticmethod
    def augmented(vectors: np.ndarray) -> np.ndarray:
        vectors = scaled(vectors, np.abs(vectors).max())
        norms = (vectors**2).sum(axis=1)
        return np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0, batch: int = 256, most: int = 0) -> Hnsw:
        """vectors: augmented, float32, at least one, all different. most: sets ef for so many of the nearest; the last vectors are then a sample."""
        n = len(vectors)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(np.int64), 8)
        level = level[np.argsort(-level, kind="stable")]  # highest first: every layer is complete before the one below
        layers = [np.full((int((level >= k).sum()), 2 * M if k == 0 else M), -1, np.int32) for k in range(int(level[0]) + 1)]
        graph = cls(vectors, level, layers, 0)
        at, held = 1, HELD if most and n > 1024 else 0
        for end in (n - held, n):
            while at < end:
                size = min(batch, max(1, at // 4), end - at)
                graph._insert(np.arange(at, at + size))
                at += size
            if at < n:
                graph.ef = graph._shortest_list(at, most)
        return graph

    def _shortest_list(self, n: int, most: int) -> int:
        """The shortest search list that finds the `most` nearest among the first n, for the vectors after them; equal similarities are as good."""
        q = self.vectors[n:].copy()
        q[:, -1] = 0
        sims = q @ self.vectors[:n].T
        least = -np.partition(-sims, most - 1, axis=1)[:, most - 1]
        least -= 1e-6 * np.abs(sims).max(axis=1)
        for ef in LISTS:
            found = self.search_layer(q, self._descend(q), max(ef, most), 0)[1][:, :most]
            if (found >= least[:, None]).mean() >= RECALL:
                break
        return ef

    def _insert(self, new: np.ndarray) -> None:
        q = self.vectors[new]
        entry = np.zeros((len(new), 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            joins = self.level[new] >= k
            if not joins.any():
                entry = self.search_layer(q, entry, 1, k)[0]
                continue
            ids, sims = self.search_layer(q, entry, EF_BUILD, k, new[0])
            entry = ids[:, :1]
            who = new[joins]
            # the others of the batch are candidates too, if they come before
            own = self.vectors[who] @ self.vectors[who].T
            own[np.triu_indices(len(who))] = -np.inf
            cand = np.hstack([ids[joins], np.where(np.isfinite(own), who[None, :], -1)])
            sim = np.hstack([sims[joins], own])
            chosen = self._diverse(cand, sim, M)
            self.layers[k][who, : M] = chosen
            src, dst = np.repeat(who, M), chosen.ravel()
            self._link_back(k, dst[dst >= 0], src[dst >= 0])

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, most: int, keep: int = 48) -> np.ndarray:
        """Up to `most` candidates a row, nearest first, skipping those nearer to a chosen one; rest filled with skipped ones."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, :keep]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        sim = np.where(cand < 0, -np.inf, sim)
        v = self.vectors[np.maximum(cand, 0)]
        between = v @ v.transpose(0, 2, 1)
        rows, width = cand.shape
        chosen = np.zeros((rows, width), bool)
        count = np.zeros(rows, np.int64)
        for i in range(width):
            near = np.where(chosen, between[:, i, :], -np.inf).max(axis=1)
            take = (cand[:, i] >= 0) & (near < sim[:, i]) & (count < most)
            chosen[:, i] = take
            count += take
        # chosen first, then the nearest skipped
        rank = np.argsort(np.where(cand < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(cand, rank, 1)
        return np.hstack([out, np.full((rows, most - out.shape[1]), -1, out.dtype)]) if out.shape[1] < most else out

    def _link_back(self, k: int, at: np.ndarray, new: np.ndarray) -> None:
        """Adds new[i] to the neighbours of at[i]; full rows keep a diverse choice."""
        layer = self.layers[k]
        width = layer.shape[1]
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        nodes, first, counts = np.unique(at, return_index=True, return_counts=True)
        added = np.full((len(nodes), counts.max()), -1, np.int64)
        added[np.repeat(np.arange(len(nodes)), counts), np.arange(len(at)) - np.repeat(first, counts)] = new
        both = np.hstack([layer[nodes], added])
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = (both >= 0).sum(axis=1) > width
        layer[nodes[~full]] = both[~full][:, :width]
        if full.any():
            rows = both[full]
            sim = np.einsum("rd,rcd->rc", self.vectors[nodes[full]], self.vectors[np.maximum(rows, 0)])
            layer[nodes[full]] = self._diverse(rows, np.where(rows < 0, -np.inf, sim), width)

    def search_layer(self, q: np.ndarray, entry: np.ndarray, ef: int, k: int, limit: int | None = None, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The ef most similar vectors found in layer k for each query: numbers (-1: none) and similarities, best first.

        Each round opens the `step` best of every list at once. Lists are cut without being
        sorted, and only vectors not met before are compared.
        """
        layer, rows = self.layers[k], len(q)
        n = len(layer)
        met = np.zeros(rows * n, np.int32)
        ids = np.full((rows, ef), -1, np.int64)
        sims = np.full((rows, ef), -np.inf, np.float32)
        m = min(ef, entry.shape[1])
        ids[:, :m] = entry[:, :m]
        r, c = np.nonzero(ids >= 0)
        sims[r, c] = np.einsum("kd,kd->k", q[r], self.vectors[ids[r, c]])
        met[r * n + ids[r, c]] = 1
        done = ids < 0
        step, active = min(step, ef), np.arange(rows)
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            best = np.argpartition(-open_sims, step - 1, axis=1)[:, :step]
            real = np.isfinite(np.take_along_axis(open_sims, best, 1))
            alive = real.any(axis=1)
            active, best, real = active[alive], best[alive], real[alive]
            if not len(active):
                break
            mine, at = np.nonzero(real)
            at = best[mine, at]
            done[active[mine], at] = True
            near = layer.take(ids[active[mine], at], axis=0)
            place = near + (active[mine] * n)[:, None]
            # a missing neighbour (-1) looks up another row's mark, or the last one's; it is left out anyway
            fresh = np.flatnonzero((met.take(place) == 0) & (near >= 0))
            near, mine, place = near.take(fresh).astype(np.int64), mine.take(fresh // near.shape[1]), place.take(fresh)
            mark = np.arange(1, len(place) + 1, dtype=np.int32)
            met[place] = mark  # of a vector that several nodes share, one stays
            one = np.flatnonzero(met.take(place) == mark)
            near, mine = near.take(one), mine.take(one)
            count = np.bincount(mine, minlength=len(active))  # mine is in order
            sim = np.einsum("kd,kd->k", np.repeat(q[active], count, axis=0), self.vectors.take(near, axis=0))
            better = np.flatnonzero(sim > np.repeat(sims[active].min(axis=1), count))
            near, mine, sim = near.take(better), mine.take(better), sim.take(better)
            if not len(mine):
                continue
            count = np.bincount(mine, minlength=len(active))
            c = ef + np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)
            shape = (len(active), ef + int(count.max()))
            all_ids, all_sims, all_done = np.full(shape, -1, np.int64), np.full(shape, -np.inf, np.float32), np.ones(shape, bool)
            all_ids[:, :ef], all_sims[:, :ef], all_done[:, :ef] = ids[active], sims[active], done[active]
            all_ids[mine, c], all_sims[mine, c], all_done[mine, c] = near, sim, False
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, most: int, ef: int = EF_SEARCH, block: int = 256) -> np.ndarray:
        """Numbers of about the `most` most similar vectors of each query, -1 for none."""
        out = []
        for i in range(0, len(q), block):
            part = scaled(q[i : i + block], np.abs(q[i : i + block]).max(axis=1, keepdims=True))
            part = np.hstack([part, np.zeros((len(part), 1))]).astype(np.float32)
            out.append(self.search_layer(part, self._descend(part), max(ef, most), 0)[0][:, :most])
        return np.vstack(out)

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """Where each query enters the lowest layer."""
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self.search_layer(q, entry, 1, k)[0]
        return entry

    def pack(self) -> dict:
        return {"level": self.level.astype("<i4").tobytes(), "neighbours": b"".join(x.astype("<i4").tobytes() for x in self.layers)}

    @classmethod
    def unpack(cls, vectors: np.ndarray, level: bytes, neighbours: bytes) -> Hnsw:
        level, flat = np.frombuffer(level, "<i4"), np.frombuffer(neighbours, "<i4")
        layers, at = [], 0
        for k in range(int(level.max()) + 1):
            shape = (int((level >= k).sum()), 2 * M if k == 0 else M)
            layers.append(flat[at : at + shape[0] * shape[1]].reshape(shape))
            at += shape[0] * shape[1]
        return cls(vectors, level, layers, 0)


def valid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors that are not null, zero or empty and hold only finite components; ids not null."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = pick(rows, id_col, vector_col).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.coalesce(odd(x), F.lit(True)))
    return rows.where("vec_id is not null and v is not null").where(ok).distinct()


def index(vectors: DataFrame, most: int, shard_size: int) -> DataFrame:
    """One row per shard: its vectors, their ids (the `most` smallest of equal vectors) and its graph's arrays.

    Equal vectors are one vector of the graph. A search for `most` rows needs no more than the
    `most` smallest ids of equal vectors, since ties go to smaller ids. Shards are dealt by hash
    and dimension, about shard_size different vectors each.
    """
    few = vectors.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= most)
    groups = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-groups.count() // shard_size))
    wanted = min(most, -(-most // shards) + 2)  # of the nearest, a shard has as many on average, and two to be safe
    groups = groups.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # a mixed order, the same in every attempt, so that the last vectors are a sample
        pdf = pdf.assign(first=[x[0] for x in pdf["ids"]]).sort_values("first").iloc[np.random.default_rng(0).permutation(len(pdf))]
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        graph = Hnsw.build(Hnsw.augmented(v), most=wanted)
        ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "n": len(v), "vectors": v.tobytes(), "ids": np.concatenate(ids).tobytes(), "counts": np.array([len(x) for x in ids], "<i4").tobytes(), "ef": graph.ef, **graph.pack()}])

    schema = "dim int, shard int, n long, vectors binary, ids binary, counts binary, ef int, level binary, neighbours binary"
    return stored(groups.groupBy("dim", "shard").applyInPandas(build, schema))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_size: int = 8192, block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id `every` divides.

    Vectors of unequal length never meet. Repeated rows count once. Equal query vectors are
    searched once, in blocks of about `block` against each shard; a shard is sent once for each
    block. Ties go to the smaller vec_id. Null, zero or non-finite vectors and null ids take no
    part; an empty table gives no rows; other columns are left out.
    """
    rows = stored(valid(vectors))
    shards = index(rows, k + 1, shard_size)
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.withColumn("qkey", F.concat_ws(":", *[F.hex(F.xxhash64("v", F.lit(s))) for s in (0, 1)]))
    asked = stored(asked)
    total = asked.count()
    queries = asked.groupBy("qkey").agg(F.first("v").alias("v"), F.count("*").alias("n"))
    queries = stored(queries)
    blocks = max(1, -(-queries.count() // block))
    spread = queries.select("qkey", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int").alias("block"))
    places = shards.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    right = spread.join(places, "dim").select("dim", "shard", "block", "qkey", "v")  # each query once for each shard
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, shard: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qkey": pd.Series([], dtype=str), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype=float)})
        if not len(shard) or not len(part):
            return empty
        s = shard.iloc[0]
        v = np.frombuffer(s["vectors"], np.float64).reshape(int(s["n"]), -1)
        counts = np.frombuffer(s["counts"], "<i4").astype(np.int64)
        ids, start = np.frombuffer(s["ids"], np.int64), np.concatenate([[0], np.cumsum(counts)])
        graph = Hnsw.unpack(Hnsw.augmented(v), s["level"], s["neighbours"])
        q = np.stack(part["v"].to_numpy()).astype(np.float64)
        found = graph.search(q, k + 1, int(s["ef"]))
        out = []
        for name, qv, row in zip(part["qkey"], q, found):
            row = row[row >= 0]
            scores = (v[row] * qv).sum(axis=1)
            pairs = sorted((-x, int(i)) for x, r in zip(scores, row) for i in ids[start[r] : start[r + 1]])[: k + 1]
            out += [(name, i, -x) for x, i in pairs]
        return pd.DataFrame(out, columns=["qkey", "vec_id", "score"]) if out else empty

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "qkey string, vec_id long, score double")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    lists = top.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    answers = hot_join(asked.select("qkey", F.col("vec_id").alias("query_id")), lists.join(queries.select("qkey", "n"), "qkey"), "qkey", total)
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = answers.select("query_id", F.posexplode(others).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op5_hnsw(spark, sf_dir: str) -> DataFrame:
    """nearest() over the whole table embeddings: rows whose vec_id 20 divides against all others."""
    return nearest(table(spark, sf_dir, "embeddings"))
