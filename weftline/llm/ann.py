"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id, SHARD_ROWS each on average. A shard's graph
(Malkov and Yashunin 2020) has nodes on levels of geometrically falling size; a node's
neighbours on a level are near ones in different directions, and links go both ways. The graph
is stored as flat arrays, one row a shard: for each level its nodes and a table of neighbours. A
search descends greedily to level 0 and there keeps the EF best nodes of each query; the
shards' results are merged. Queries come in blocks of QUERY_BLOCK, each broadcast, so what is
broadcast doesn't grow with the data. Scores are computed in double precision on the original
vectors.

Defined cases: a vector that is null, zero, of another dimension than the table's most frequent
one, or that holds null or non-finite components takes no part, nor does a null id; equal
vectors of a shard are one node that lists all their ids; rows of one id are one query and one
candidate, at the least distance of any of their vectors; vectors of any finite size are scaled
by a power of two before they are searched in single precision; rows of a query's own id aren't its
candidates; ties go to the smaller id; with fewer candidates than k all are returned; an empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a shard on average, queries of a block.
SHARD_ROWS, QUERY_BLOCK = 8192, 50_000
#: Neighbours on level 0 and on higher ones, near nodes they are picked from, nodes kept by a search.
LINKS, UPPER_LINKS, PICKED_FROM, EF = 32, 16, 48, 160
#: Nodes that a query opens at a time, and queries searched at a time.
OPENED, AT_ONCE = 4, 128


def valid(vector: Column) -> Column:
    """Whether every component is a finite number and one isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None])


def _neighbours(x: np.ndarray, nodes: np.ndarray, links: int) -> np.ndarray:
    """Neighbours of ``nodes`` among themselves: a table of node numbers, -1 where there are fewer."""
    n = len(nodes)
    out = np.full((n, links + 1), -1, np.int32)
    if n == 1:
        return out
    own, near_n = x[nodes], min(PICKED_FROM, n - 1)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        d = _squared(own[lo:hi], own)
        d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
        near = np.argpartition(d, near_n - 1, axis=1)[:, :near_n]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = np.take_along_axis(d, near, 1)
        vectors = own[near]
        norms = (vectors * vectors).sum(2)
        between = norms[:, :, None] - 2 * (vectors @ vectors.transpose(0, 2, 1)) + norms[:, None, :]
        picked = np.zeros(near.shape, bool)
        for k in range(near_n):  # a candidate nearer to one already picked than to the node is left out
            shadowed = (picked & (between[:, k] < dist[:, k, None])).any(1)
            picked[:, k] = ~shadowed & (picked.sum(1) < links // 2)
        rank = np.argsort(~picked, axis=1, kind="stable")[:, : links // 2]  # the picked ones, then the nearest of the rest
        chosen = np.take_along_axis(near, rank, 1)
        out[lo:hi, : chosen.shape[1]] = chosen
    # Links back, nearest first, as far as there is room; and a ring, so that every node can be reached.
    src = np.repeat(np.arange(n), out.shape[1])
    dst = out.ravel()
    src, dst = src[dst >= 0].astype(np.int64), dst[dst >= 0].astype(np.int64)
    one_way = ~np.isin(dst * n + src, src * n + dst)
    src, dst = src[one_way], dst[one_way]
    length = ((own[src] - own[dst]) ** 2).sum(1)
    order = np.lexsort((length, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    used = (out >= 0).sum(1)
    fits = place + used[dst] < links
    out[dst[fits], (place + used[dst])[fits]] = src[fits]
    out[:, links] = (np.arange(n) + 1) % n
    return np.where(out >= 0, nodes[np.maximum(out, 0)], -1).astype(np.int32)


class Graph:
    """Flat arrays: distinct vectors, their ids, and for each level its nodes and their neighbours."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, ends: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], scale: float = 1.0):
        self.x, self.ids, self.ends, self.levels, self.scale = x, ids, ends, levels, scale
        self.fast = (x * scale).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, scale: float = 1.0) -> Graph:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        distinct, which = np.unique(x, axis=0, return_inverse=True)
        which = which.ravel()
        members = np.lexsort((ids, which))
        again = (np.diff(which[members]) == 0) & (np.diff(ids[members]) == 0)
        members = members[np.concatenate([[True], ~again])]  # an id once a node
        which = which[members]
        ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(distinct)))])
        rng = np.random.default_rng(11)
        shuffled = rng.permutation(len(distinct)).astype(np.int32)
        fast, levels, n = (distinct * scale).astype(np.float32), [], len(distinct)
        while n:
            nodes = np.sort(shuffled[:n])  # each level's nodes are all on the levels below
            levels.append((nodes, _neighbours(fast, nodes, UPPER_LINKS if levels else LINKS)))
            n = n // UPPER_LINKS
        return cls(distinct, ids[members], ends.astype(np.int64), levels, scale)

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """The node of level 0 where each query starts: on each higher level, the one that no neighbour betters."""
        at = np.full(len(q), self.levels[-1][0][0])
        best = ((q - self.fast[at]) ** 2).sum(1)
        for nodes, table in reversed(self.levels[1:]):
            moving = np.ones(len(q), bool)
            while moving.any():
                near = table[np.searchsorted(nodes, at[moving])]
                d = ((q[moving][:, None] - self.fast[np.maximum(near, 0)]) ** 2).sum(2)
                d[near < 0] = np.inf
                k = d.argmin(1)
                least = d[np.arange(len(k)), k]
                better = least < best[moving]
                which = np.flatnonzero(moving)
                at[which[better]], best[which[better]] = near[np.arange(len(k)), k][better], least[better]
                moving[which[~better]] = False
        return at

    def _nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The ``ef`` best nodes found for each query, best first; -1 where there are fewer."""
        m, n, table = len(q), len(self.fast), self.levels[0][1]
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n), bool)
        nodes = np.full((m, ef), -1, np.int64)
        dist = np.full((m, ef), np.inf, np.float32)
        open_ = np.zeros((m, ef), bool)
        nodes[:, 0] = self._entry(q)
        dist[:, 0] = ((q - self.fast[nodes[:, 0]]) ** 2).sum(1)
        open_[:, 0] = True
        seen[np.arange(m), nodes[:, 0]] = True
        norms, own = (self.fast * self.fast).sum(1), (q * q).sum(1)
        while open_.any():
            k = np.argsort(~open_, axis=1, kind="stable")[:, :OPENED]
            opened = np.take_along_axis(open_, k, 1)
            open_[rows, k] = False
            near = np.where(opened[:, :, None], table[np.take_along_axis(nodes, k, 1)], -1).reshape(m, -1)
            near = np.sort(near, axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            at = np.maximum(near, 0)
            fresh &= ~seen[rows, at]
            new = np.nonzero(fresh)
            seen[new[0], near[new]] = True
            d = own[:, None] - 2 * np.einsum("mkd,md->mk", self.fast[at], q, optimize=True) + norms[at]
            d[~fresh] = np.inf
            all_d, all_n, all_o = np.concatenate([dist, d], 1), np.concatenate([nodes, near], 1), np.concatenate([open_, fresh], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            dist, nodes, open_ = (np.take_along_axis(a, order, 1) for a in (all_d, all_n, all_o))
            open_ &= np.isfinite(dist)
        nodes[~np.isfinite(dist)] = -1
        return nodes

    def _ids(self, qid: int, q: np.ndarray, row: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Distance and id of the ``k`` nearest ids but ``qid`` among the nodes ``row``, each id once."""
        apart = self.x[row] - q
        # A power of two for each row keeps squares in range and changes no digit.
        power = np.frexp(np.abs(apart).max(axis=1, initial=0.0))[1]
        exact = np.ldexp(np.sqrt((np.ldexp(apart, -power[:, None]) ** 2).sum(1)), power)
        best: dict[int, float] = {}
        for d, node in zip(exact.tolist(), row.tolist(), strict=True):
            # k + 1 ids of a node are enough: its smallest ones, the query's own perhaps among them.
            for i in self.ids[self.ends[node] : self.ends[node + 1]][: k + 1].tolist():
                if i != qid and d < best.get(i, np.inf):
                    best[i] = d
        return sorted((d, i) for i, d in best.items())[:k]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parallel arrays: query id, id and distance of up to ``k`` results of each query."""
        found: list[tuple[int, int, float]] = []
        for lo in range(0, len(queries), AT_ONCE):
            part = queries[lo : lo + AT_ONCE]
            nodes = self._nearest((part * self.scale).astype(np.float32), max(ef, 2 * k))
            for qid, q, row in zip(query_ids[lo : lo + AT_ONCE].tolist(), part, nodes, strict=True):
                near = self._ids(qid, q, row[row >= 0][: 2 * k + 2], k)
                wider = max(ef, 2 * k)
                while len(near) < k and len(row := row[row >= 0]) > 2 * k + 2:  # ids of many vectors fill the places
                    near = self._ids(qid, q, row, k)
                    if len(near) >= k or len(row) < wider or wider >= len(self.x):
                        break
                    wider *= 4
                    row = self._nearest((q[None] * self.scale).astype(np.float32), wider)[0]
                found += [(qid, i, d) for d, i in near]
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.float64)


_INDEX = "shard int, dim int, ids binary, ends binary, vectors binary, nodes array<binary>, neighbours array<binary>"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, scale: float = 1.0) -> DataFrame:
    """One row of flat arrays a shard, written to the shared folder. ``vectors`` has vec_id and vector (array<double>), all valid."""
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        g = Graph.build(ids, flat.reshape(len(ids), -1), scale)
        row = [table.column("shard")[0].as_py(), g.x.shape[1], g.ids.tobytes(), g.ends.tobytes(), g.x.tobytes(), [n.tobytes() for n, _ in g.levels], [t.tobytes() for _, t in g.levels]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        names = ["shard", "dim", "ids", "ends", "vectors", "nodes", "neighbours"]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return common.written(dealt.groupBy("shard").applyInArrow(build, _INDEX))


def _opened(batch: pa.RecordBatch, i: int, scale: float) -> Graph:
    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    levels = []
    for k, (nodes, table) in enumerate(zip(row["nodes"], row["neighbours"], strict=True)):
        width = (UPPER_LINKS if k else LINKS) + 1
        levels.append((np.frombuffer(nodes, np.int32), np.frombuffer(table, np.int32).reshape(-1, width)))
    x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    return Graph(x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64), levels, scale)


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF, query_block: int = QUERY_BLOCK, scale: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each vec_id of ``queries`` (vec_id, vector)."""
    spark = index.sparkSession
    queries = queries.dropDuplicates(["vec_id", "vector"])
    blocks = max(1, -(-queries.count() // query_block))
    numbered = common.written(queries.withColumn("_block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")))
    found = None
    for block in range(blocks):
        # A block's vectors pass the driver on their way to the broadcast; their number is bounded.
        rows = numbered.where(F.col("_block") == block).select("vec_id", "vector").toArrow()
        ids = rows.column("vec_id").to_numpy().astype(np.int64)
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        shared = spark.sparkContext.broadcast((ids, flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 1))))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                for i in range(batch.num_rows if len(ids) else 0):
                    a, b, c = _opened(batch, i, scale).search(ids, q, k, ef)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

        # One row a partition, so that shards are searched apart.
        part = index.repartition(F.col("shard")).mapInArrow(search, "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, vector: str = "embedding", every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest of each row whose vec_id is divisible by ``every``, by Euclidean distance, against all rows."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == dims[0]["dim"])
    power = math.frexp(dims[0]["largest"])[1]
    scale = 1.0 if abs(power) <= 30 else math.ldexp(1.0, min(1000, -power))
    return search_index(build_index(rows, shard_rows, scale), rows.where(F.col("vec_id") % every == 0), k, scale=scale)
