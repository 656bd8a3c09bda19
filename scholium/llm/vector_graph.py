"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt to shards by a hash. A shard has ``SHARD`` vectors, or the
square root of the table's rows times ``GROWTH`` if that is more, as far as ``MOST`` bytes
hold: so the number of shards, each of which every query visits, grows with the root of
the rows alone, for 64 dimensions up to some 50 million; beyond that it grows with the rows. Within a shard
equal vectors are one node with all their ids. Nodes enter the graph
in batches that double, each of them searched for in what is already there:
greedy searches from the medoid propose neighbours, and robust pruning keeps a
candidate unless a kept one is nearer to it by the factor ``ALPHA``, so edges stay
diverse; links back are pruned alike, all of them. A query searches every shard with a beam
of ``BEAM``, and the shards' nearest are merged by their distance in double
precision. A query looks at some 13 % of a shard of 25,000 vectors, and at less of larger ones.

Distances are sums of squared differences in double precision, so vectors may be shifted,
large or small at will. Where lengths spread over several powers of ten, a long vector's neighbours are
short ones all as far, and recall falls: 0.93 over three powers, 0.90 over seven, 0.72 over 45.

Searches and prunings run over a batch of nodes at once in numpy. Each shard is a task of its own,
in building and in searching, and holds one block of queries at a time; a
shard's graph is a row of a written table, so a lost executor costs the
search of a shard, not the building of all graphs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null vec_id; vectors of another
length than the query's are no candidates; ties go to the smaller vec_id;
repeats of a vec_id with the same vector count once; an empty table gives none.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD = 16_384
GROWTH = 32
MOST = 256 << 20
DEGREE = 48
BEAM = 56
ALPHA = 1.2
STARTS = 48
BLOCK = 256
TOP = 10
EVERY = 100
SEED = 7


class Graph:
    """Directed neighbour lists over different vectors; a list shorter than the degree is padded by -1."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE):
        x = np.ascontiguousarray(vectors, np.float64)
        most = float(np.abs(x).max(initial=0))
        #: A power of two that keeps squares of very large or very small components finite and above zero, else 1.
        self.unit = 2.0 ** -np.frexp(most)[1] if most and not 1e-100 < most < 1e100 else 1.0
        self.x = x if self.unit == 1 else x * self.unit
        self.links = np.full((len(vectors), degree), -1, np.int32)
        self.entered = np.zeros(len(vectors), bool)
        #: The medoid, where building starts; searches also start from nodes at even steps of their distance from the centre.
        out = np.argsort(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1), kind="stable") if len(vectors) else np.zeros(1, np.int64)
        self.start = int(out[0])
        self.starts = np.unique(out[np.linspace(0, len(out) - 1, min(STARTS, len(out))).astype(int)])

    def _from(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ids, by differences: sums of squares would lose what is small beside a shift or a long vector."""
        apart = self.x[ids]
        apart -= q[:, None, :]
        return np.einsum("ijk,ijk->ij", apart, apart)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the beam at each query's end, nearest first; ids are -1 past its end."""
        n = len(q)
        every = np.arange(n)
        ids = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.x) + 1), bool)  # a byte for each node and query of the block
        seen[:, -1] = True
        starts = self.starts[self.entered[self.starts]][:beam]
        k = len(starts)
        ids[:, :k], done[:, :k] = starts, False
        far[:, :k] = self._from(q, ids[:, :k])
        order = np.argsort(far, axis=1, kind="stable")
        ids, far, done = (np.take_along_axis(m, order, 1) for m in (ids, far, done))
        seen[:, starts] = True
        while len(active := np.flatnonzero(~done.all(axis=1))):
            at = (~done[active]).argmax(axis=1)
            done[active, at] = True
            nodes = self.links[ids[active, at]].astype(np.int64)
            new = ~seen[active[:, None], nodes]
            seen[active[:, None], nodes] = True
            d = np.where(new, self._from(q[active], np.maximum(nodes, 0)), np.inf)
            all_ids = np.concatenate([ids[active], np.where(new, nodes, -1)], axis=1)
            all_far = np.concatenate([far[active], d], axis=1)
            all_done = np.concatenate([done[active], ~new], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            row = every[: len(active), None]
            ids[active], far[active], done[active] = all_ids[row, order], all_far[row, order], all_done[row, order]
        return ids, far

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Each node's links out of its row of candidates (-1: none), by relaxed distance pruning."""
        degree = self.links.shape[1]
        safe = np.maximum(candidates, 0)
        d = np.where((candidates >= 0) & (candidates != nodes[:, None]), self._from(self.x[nodes], safe), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        safe, d = np.take_along_axis(safe, order, 1), np.take_along_axis(d, order, 1)
        d[:, 1:][(safe[:, 1:] == safe[:, :-1])] = np.inf
        x = self.x[safe] - self.x[nodes][:, None, :]  # as seen from the node
        norm = np.einsum("ijk,ijk->ij", x, x)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        out = np.full((len(nodes), degree), -1, np.int32)
        row, alive = np.arange(len(nodes)), np.isfinite(d)
        for k in range(degree):
            if not alive.any():
                break
            first = alive.argmax(axis=1)
            some = alive[row, first]
            out[some, k] = safe[row, first][some]
            alive &= (alpha * alpha * between[row, first] > d) | ~some[:, None]
            alive[row, first] = False
        return out

    def build(self, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512, seed: int = SEED) -> Graph:
        """Enter all nodes in random order, in batches no longer than what is already there."""
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[self.start, order[order != self.start]] if n else order
        self.entered[order[:1]] = True
        at, step = 1, 1
        while at < n:
            nodes = order[at : at + step]
            found, _ = self.search(self.x[nodes], beam)
            self.links[nodes] = self.pruned(nodes, found, alpha)
            self._back(nodes, alpha)
            self.entered[nodes] = True
            at += len(nodes)
            step = min(batch, at)
        return self

    def _back(self, nodes: np.ndarray, alpha: float) -> None:
        """Links back from the nodes' neighbours; lists that grow too long are pruned, the longest in parts one after another."""
        degree = self.links.shape[1]
        to = self.links[nodes].ravel()
        by = np.repeat(nodes, degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        while len(to):
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            place = np.arange(len(to)) - np.repeat(first, count)
            now = place < degree
            new = np.full((len(targets), min(int(count.max()), degree)), -1, np.int64)
            new[np.repeat(np.arange(len(targets)), count)[now], place[now]] = by[now]
            held = self.links[targets]
            have = (held >= 0).sum(axis=1)
            room = have + (new >= 0).sum(axis=1) <= degree
            for i in np.flatnonzero(room).tolist():
                more = new[i][new[i] >= 0]
                self.links[targets[i], have[i] : have[i] + len(more)] = more
            full = np.flatnonzero(~room)
            for at in range(0, len(full), 256):
                part = full[at : at + 256]
                self.links[targets[part]] = self.pruned(targets[part], np.concatenate([held[part], new[part]], axis=1), alpha)
            to, by = to[~now], by[~now]


def shard_graph(ids: np.ndarray, vectors: np.ndarray) -> tuple:
    """(graph, vectors in double precision, node edges in ids, ids): equal vectors are one node, its ids ascending."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
    again = np.r_[False, (ids[1:] == ids[:-1]) & ~first[1:]]
    ids, vectors, first = ids[~again], vectors[~again], first[~again]
    edges = np.r_[np.flatnonzero(first), len(ids)]
    return Graph(vectors[first]).build(), vectors[first], edges, ids


def nearest(shard: tuple, query_ids: np.ndarray, q: np.ndarray, top: int = TOP, beam: int = BEAM) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, distance) of each query's nearest in the shard, itself left out."""
    graph, exact, edges, ids = shard
    nodes, _ = graph.search(q * graph.unit, beam)
    out = []
    for query_id, vector, found in zip(query_ids.tolist(), q, nodes, strict=True):
        found = found[found >= 0]
        d = np.sqrt((((exact[found] - vector) * graph.unit) ** 2).sum(axis=1)) / graph.unit
        rows = [(float(far), int(i)) for far, node in zip(d, found.tolist(), strict=True) for i in ids[edges[node] : min(edges[node + 1], edges[node] + top + 1)] if i != query_id]
        out += [(query_id, i, far) for far, i in sorted(rows)[:top]]
    return out


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def shard_size(rows: int, dim: int, most: int = MOST) -> int:
    """The vectors of a shard for a table of so many rows; each takes its components, at most twice as doubles, and its links."""
    return max(1, min(max(SHARD, int(GROWTH * rows**0.5)), most // (16 * dim + 4 * DEGREE)))


def search_all(vectors: DataFrame, queries: DataFrame, top: int = TOP, shard: int | None = None, beam: int = BEAM, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``top`` nearest of ``vectors`` to each of ``queries``."""
    rows = usable(vectors, key, vector)
    size = rows.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    shards = max(1, -(-size.n // (shard or shard_size(size.n, size.dim or 1))))

    def build(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for vec_id, v, dim in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(dim, []).append((vec_id, np.asarray(v)))
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for dim, some in held.items():
            blob = pickle.dumps(shard_graph(np.array([i for i, _ in some]), np.stack([v for _, v in some])), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int32()), pa.array([blob], pa.binary())], ["dim", "shard", "graph"])

    dealt = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartitionById(shards, F.col("shard")).select("vec_id", "v", "dim")
    graphs, _ = written(dealt.mapInArrow(build, "dim int, shard int, graph binary"), "ann-graphs")

    asked = usable(queries, key, vector).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v")
    both = graphs.select("dim", "shard", "graph", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"))
    both = both.unionByName(asked.withColumn("graph", F.lit(None).cast("binary")))
    lined = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", F.col("vec_id").asc_nulls_first())

    def find(batches):
        held, ids, block = None, [], []

        def rows_of():
            found = nearest(held, np.array(ids), np.stack(block), top, beam) if held is not None and ids else []
            ids.clear()
            block.clear()
            cols = list(zip(*found, strict=True)) or ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        now = None
        for batch in batches:
            for dim, shard, graph, vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dim, shard) != now:
                    yield rows_of()
                    now, held = (dim, shard), None
                if graph is not None:
                    held = pickle.loads(graph)
                else:
                    ids.append(vec_id)
                    block.append(np.asarray(v))
                    if len(ids) == BLOCK:
                        yield rows_of()
        yield rows_of()

    found = lined.mapInArrow(find, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_vector_graph(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search_all(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
