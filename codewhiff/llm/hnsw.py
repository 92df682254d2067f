"""Approximate nearest neighbours: a navigable small-world hierarchy for each shard (operator 7)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RESULT = "vec_id long, neighbor_id long, rank int, distance double"
PASS = 1 << 16  # vectors that a task looks up in one pass over the shards


class Graph:
    """Layers of flat neighbour arrays over the vectors ``x``; -1 fills up. Queries and insertions go in batches, each step for all at once."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 64):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.m, self.ef = m, ef
        n = len(self.x)
        level = np.minimum((-np.log(np.random.default_rng(n).random(n) + 1e-12) / np.log(m)).astype(int), 8)
        self.order = np.argsort(-level, kind="stable")  # higher levels first, so that layers are built top down
        self.level = level
        self.layers = [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(int(level.max()) + 1 if n else 0)]
        self.entry = int(self.order[0]) if n else -1

    @classmethod
    def built(cls, x: np.ndarray, m: int = 16, ef: int = 64) -> Graph:
        g = cls(x, m, ef)
        n, done = len(g.x), 1
        while done < n:
            size = int(min(n - done, max(1, min(done, 256))))
            g._insert(g.order[done : done + size])
            done += size
        return g

    def _distance(self, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances [b, c] of queries [b, d] to the vectors ``ids`` [b, c]; ids below 0 are infinitely far."""
        safe = np.maximum(ids, 0)
        d = qn[:, None] + self.norm[safe] - 2 * np.matmul(self.x[safe], q[:, :, None])[:, :, 0]
        return np.where(ids < 0, np.float32(np.inf), np.maximum(d, 0))

    def _descend(self, q: np.ndarray, qn: np.ndarray, to: int, start: np.ndarray, ds: np.ndarray, top: int):
        for k in range(top, to, -1):
            while True:
                near = self.layers[k][start]
                d = self._distance(q, qn, near)
                j = d.argmin(axis=1)
                best = d[np.arange(len(q)), j]
                better = best < ds
                if not better.any():
                    break
                start = np.where(better, near[np.arange(len(q)), j], start)
                ds = np.where(better, best, ds)
        return start, ds

    def _beam(self, q: np.ndarray, qn: np.ndarray, layer: np.ndarray, start: np.ndarray, ds: np.ndarray, ef: int, wide: int = 2):
        """Best-first search for all queries in lockstep: the nearest ``ef`` found, sorted."""
        b = len(q)
        ids = np.full((b, ef), -1, dtype=np.int32)
        dist = np.full((b, ef), np.inf, dtype=np.float32)
        open_ = np.zeros((b, ef), dtype=bool)
        ids[:, 0], dist[:, 0], open_[:, 0] = start, ds, True
        seen = np.zeros((b, len(self.x) + 1), dtype=bool)  # the last column takes what is no node
        seen[np.arange(b), start] = True
        live = np.arange(b)
        while len(live):
            o = open_[live]
            rank = np.argsort(~o, axis=1, kind="stable")[:, :wide]  # beams are sorted, so these are the nearest open ones
            valid = np.take_along_axis(o, rank, axis=1)
            nodes = np.where(valid, np.take_along_axis(ids[live], rank, axis=1), -1)
            np.put_along_axis(o, rank, False, axis=1)
            near = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near = np.where(seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            seen[live, -1] = False
            if wide > 1:  # a node that two opened ones lead to counts once
                s = np.sort(near, axis=1)
                twice = np.zeros_like(near, dtype=bool)
                twice[:, 1:] = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] >= 0)
                near = np.where(twice, -1, s)
            d = self._distance(q[live], qn[live], near)
            all_d = np.concatenate([dist[live], d], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            all_i = np.concatenate([ids[live], near], axis=1)
            all_o = np.concatenate([o, near >= 0], axis=1)
            ids[live] = np.take_along_axis(all_i, keep, axis=1)
            dist[live] = np.take_along_axis(all_d, keep, axis=1)
            open_[live] = np.take_along_axis(all_o, keep, axis=1)
            live = live[open_[live].any(axis=1)]
        return ids, dist

    def _select(self, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """Of sorted candidates those nearer to the query than to each one selected before, filled up with the nearest others."""
        b, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        n = self.norm[np.maximum(ids, 0)]
        mutual = n[:, :, None] + n[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros((b, c), dtype=bool)
        count = np.zeros(b, dtype=int)
        least = np.full((b, c), np.inf, dtype=np.float32)
        for j in range(c):
            ok = (ids[:, j] >= 0) & (count < m) & (dist[:, j] <= least[:, j])
            chosen[:, j] = ok
            count += ok
            least[ok] = np.minimum(least[ok], mutual[ok, j])
        place = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(ids, place, axis=1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1) if out.shape[1] < m else out

    def _insert(self, new: np.ndarray) -> None:
        q, qn = self.x[new], self.norm[new]
        start = np.full(len(new), self.entry, dtype=np.int32)
        ds = self._distance(q, qn, start[:, None])[:, 0]
        among = qn[:, None] + qn[None] - 2 * (q @ q.T)  # those inserted at once see each other
        np.fill_diagonal(among, np.inf)
        top = int(self.level[self.entry])
        for k in range(top, -1, -1):
            on = self.level[new] >= k
            if not on.any():
                start, ds = self._descend(q, qn, k - 1, start, ds, k)
                continue
            ids, dist = self._beam(q, qn, self.layers[k], start, ds, self.ef if on.any() else 1)
            start, ds = ids[:, 0].copy(), dist[:, 0].copy()
            rows = np.flatnonzero(on)
            width = min(len(rows), self.ef)
            own = np.where(on[None, :], among[rows], np.inf)
            near = np.argsort(own, axis=1)[:, :width]
            od = np.take_along_axis(own, near, axis=1).astype(np.float32)
            all_i = np.concatenate([ids[rows], np.where(np.isfinite(od), new[near], -1).astype(np.int32)], axis=1)
            all_d = np.concatenate([dist[rows], np.maximum(od, 0)], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, : self.ef]
            ids_k, dist_k = np.take_along_axis(all_i, keep, axis=1), np.take_along_axis(all_d, keep, axis=1)
            ids_k = np.where(np.isfinite(dist_k), ids_k, -1)
            links = self._select(ids_k, dist_k, self.m)
            self.layers[k][new[rows], : self.m] = links
            self._link_back(k, np.repeat(new[rows], self.m), links.ravel())

    def _link_back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        width = self.layers[k].shape[1]
        for lo in range(0, len(nodes), 512):
            part, f, c = nodes[lo : lo + 512], first[lo : lo + 512], n[lo : lo + 512]
            most = int(c.max())
            at = f[:, None] + np.arange(most)
            extra = np.where(np.arange(most) < c[:, None], source[np.minimum(at, len(source) - 1)], -1)
            ids = np.concatenate([self.layers[k][part], extra.astype(np.int32)], axis=1)
            s = np.sort(ids, axis=1)
            dup = np.zeros_like(s, dtype=bool)
            dup[:, 1:] = s[:, 1:] == s[:, :-1]
            ids = np.where(dup, -1, s)
            d = self._distance(self.x[part], self.norm[part], ids)
            order = np.argsort(d, axis=1, kind="stable")
            ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
            full = (ids >= 0).sum(axis=1) > width
            out = ids[:, :width].copy()
            if out.shape[1] < width:
                out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
            if full.any():
                out[full] = self._select(ids[full], d[full], width)
            self.layers[k][part] = out

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, squared distances), nearest first; -1 where the graph holds fewer."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        qn = np.einsum("ij,ij->i", q, q)
        start = np.full(len(q), self.entry, dtype=np.int32)
        ds = self._distance(q, qn, start[:, None])[:, 0]
        start, ds = self._descend(q, qn, 0, start, ds, int(self.level[self.entry]))
        ids, dist = self._beam(q, qn, self.layers[0], start, ds, max(ef, k))
        return ids[:, :k], dist[:, :k]

    def to_bytes(self, ids: np.ndarray) -> bytes:
        return C.pack(ids.astype(np.int64), self.x.ravel(), self.level.astype(np.int8), np.array([self.entry, self.m, self.ef, self.x.shape[1]], dtype=np.int64), *[a.ravel() for a in self.layers])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Graph, np.ndarray]:
        ids, x, level, head, *layers = C.unpack(data)
        g = cls.__new__(cls)
        g.entry, g.m, g.ef, dim = map(int, head)
        g.x, g.level = x.reshape(-1, dim), level
        g.norm = np.einsum("ij,ij->i", g.x, g.x)
        g.layers = [a.reshape(len(ids), -1) for a in layers]
        return g, ids


@functools.lru_cache(maxsize=1)
def _load(path: str) -> tuple[Graph, np.ndarray]:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return Graph.from_bytes(f.read())


def nearest_neighbours(df: DataFrame, queries: DataFrame | None = None, k: int = 10, shard_size: int = 16384, m: int = 16, ef_build: int = 64, ef: int = 96, batch: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, neighbor_id, rank, distance)``: about the ``k`` nearest other vectors of ``df``, by Euclidean distance, of each
    vector of ``queries``, which has the same columns and is ``df`` unless it is given.

    Vectors fall in shards of about ``shard_size`` by a hash of their id. One task builds each shard's graph and writes its flat neighbour
    arrays to the shared folder. Every query is looked up in every shard: a task holds up to 65,536 queries, reads one graph after the other and merges
    the shards' results, so that vectors are exchanged once, however many shards there are. A row of the query's own id is no neighbour. Ties go to the smaller id. Null ids, null or empty vectors, and vectors with nulls or values that aren't finite, or of another length than the most frequent
    one, take no part. Of repeated ids one row counts. Other columns are ignored. No rows in, none out.
    """
    spark = df.sparkSession
    C.ship(spark)

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
        return rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity'))")

    def of_one_length(rows: DataFrame, name: str) -> DataFrame:
        return C.written(rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), name)

    dims = usable(df).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 0
    base = of_one_length(usable(df), "vectors")
    asked = base if queries is None else of_one_length(usable(queries), "queries")
    total = base.count()
    shards = max(1, -(-total // shard_size))
    path = C.fresh_path(spark, "graphs")
    placed = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def matrix(table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(table.column("vec_id"), dtype=np.int64)
        v = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.float32).reshape(len(ids), -1)
        order = np.argsort(ids)
        return ids[order], v[order]

    def make(key, table):
        import uuid

        ids, v = matrix(table)
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        temp = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(Graph.built(v, m, ef_build).to_bytes(ids))
        C.publish(fs, temp, f"{root}/{key[0].as_py()}.hnsw")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int64())})

    made = sorted(r.shard for r in placed.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(make, "shard int, n long").collect())
    total = asked.count()
    spread = max(-(-total // PASS), min(spark.sparkContext.defaultParallelism, -(-total // 64)), 1)

    def look_up(batches):
        held: list[pa.RecordBatch] = []
        for part in batches:
            held.append(part)
            if sum(map(len, held)) >= PASS:
                yield answer(held)
                held = []
        if held:
            yield answer(held)

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own, v = matrix(pa.Table.from_batches(held))
        best_i, best_d = np.full((len(own), k), -1, dtype=np.int64), np.full((len(own), k), np.inf)
        for shard in made:
            graph, ids = _load(f"{path}/{shard}.hnsw")
            for at in range(0, len(own), batch):
                q, me = v[at : at + batch], own[at : at + batch, None]
                pos, _ = graph.search(q, k + 1, ef)
                found = np.where(pos >= 0, ids[np.maximum(pos, 0)], -1)
                exact = np.sqrt(((q.astype(np.float64)[:, None] - graph.x[np.maximum(pos, 0)]) ** 2).sum(axis=2))
                i = np.concatenate([best_i[at : at + batch], found], axis=1)
                d = np.concatenate([best_d[at : at + batch], np.where((pos < 0) | (found == me), np.inf, exact)], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_i[at : at + batch], best_d[at : at + batch] = np.take_along_axis(i, order, axis=1), np.take_along_axis(d, order, axis=1)
        row, place = np.nonzero(np.isfinite(best_d))
        columns = [own[row], best_i[row, place], (place + 1).astype(np.int32), best_d[row, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["vec_id", "neighbor_id", "rank", "distance"])

    return asked.repartition(spread).mapInArrow(look_up, RESULT)
