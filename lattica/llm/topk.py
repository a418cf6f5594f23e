"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard's ball tree is built once and written to a
file in the shared folder. A search visits the tree's nodes in the order of their upper bounds q.centre + |q| * radius, for
all queries of a block whose bound reaches their current k-th score; leaves are scored by one matrix product. The current
k-th scores are shared: each query is first searched in one shard, by its hash, then in waves of ever more shards behind
that one, so that all trees work in each wave, for other queries each. The k best of all shards so far bound the search of a wave
from its start. For that, queries are written as files of blocks of bounded size; each tree's task reads one block after the
other. So no vector is sent to another task but for building its shard, and no more than k candidates of a query and a tree.

Scores are integers: components are floor(scale * x). Ties go to the smaller vec_id. Defined results: vectors that are
null, or hold null or non-finite components, take no part; vectors of different length aren't compared; null ids take no
part; rows of a repeated id are candidates of their own, but never of a query of the same id; rows of one query id are one
query, that of the least vector; a query without candidates has no rows; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.files import open_file, write_file
from lattica.llm.shared import drop_folder, drop_table, new_folder, written

#: Tasks that search at most; a task then has several trees.
MOST_TASKS = 20_000
#: How many times more shards a query has met after a wave than before it.
WIDER = 4
SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 2_048, 128
SCHEMA = "query_id long, rank int, vec_id long, score long"
_PART = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64, vector: str = "embedding") -> DataFrame:
    """vec_id, dim, v (array<bigint>) of the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(math.inf)))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select("vec_id", F.size(x).alias("dim"), v.alias("v"))


class Best:
    """The k best of each query so far: scores descending, ids ascending among equals."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a candidate must reach: the k-th score here, or that found elsewhere."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: a row for each of rows, a column for each id; -inf for what is no candidate."""
        if score.shape[1] > 4 * self.k:  # ids are ascending within a leaf, so a stable sort keeps the order of ties
            top = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            score, ids = np.take_along_axis(score, top, 1), ids[top]
        else:
            ids = np.broadcast_to(ids, score.shape)
        s, i = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class BallTree:
    """Nodes of points with centre and radius; split at the median along the axis of the widest spread.

    points and ids are in the order of the leaves; a node has its span of them, and a leaf no children (-1).
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self._rows: list[np.ndarray] = []
        self._nodes: list[list] = []
        own = points.astype(np.float64)
        self._build(own, ids, np.arange(len(ids)), leaf)
        order = np.concatenate(self._rows) if self._rows else np.zeros(0, np.int64)
        self.points, self.ids = points[order].astype(np.int64), ids[order].astype(np.int64)
        self.centre = np.stack([n[0] for n in self._nodes])
        self.radius, self.child, self.span = (np.array([n[i] for n in self._nodes]) for i in (1, 2, 3))

    def _build(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        own, first = len(self._nodes), sum(map(len, self._rows))
        p = points[rows]
        centre = p.mean(axis=0)
        radius = math.sqrt(float(((p - centre) ** 2).sum(axis=1).max()))
        self._nodes.append([centre, radius, (-1, -1), (first, first + len(rows))])
        if len(rows) <= leaf or radius == 0:  # equal points stay together, however many
            self._rows.append(rows[np.argsort(ids[rows], kind="stable")])
            return own
        axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        order = np.argsort(p[:, axis], kind="stable")
        half = len(rows) // 2
        self._nodes[own][2] = self._build(points, ids, rows[order[:half]], leaf), self._build(points, ids, rows[order[half:]], leaf)
        return own

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in ("points", "ids", "centre", "radius", "child", "span")})
        return out.getvalue()

    @classmethod
    def load(cls, uri: str) -> BallTree:
        tree = cls.__new__(cls)
        with open_file(uri) as f:
            for k, v in np.load(io.BytesIO(f.read())).items():
                setattr(tree, k, v)
        return tree

    def search(self, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
        """Branch and bound for a block of queries at once, the node of the highest bound first."""
        q, points = queries.astype(np.float64), self.points.astype(np.float64)
        norm = np.sqrt((q * q).sum(axis=1))
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(points).max(initial=0)) * q.shape[1] < 2**52

        def bounds(node: int, rows: np.ndarray) -> np.ndarray:
            centre, radius = self.centre[node], float(self.radius[node])
            bound = q[rows] @ centre + norm[rows] * radius
            return bound + 1e-9 * (np.abs(bound) + norm[rows] * (radius + float(np.abs(centre).max(initial=0)))) + 1e-6

        every = np.arange(len(q))
        start = bounds(0, every)
        heap = [(-float(start.max()), 0, every, start)]
        while heap:
            _, node, rows, bound = heapq.heappop(heap)
            open_ = bound >= best.least()[rows]
            rows = rows[open_]
            if not len(rows):
                continue
            if self.child[node][0] >= 0:
                for child in self.child[node].tolist():
                    b = np.minimum(bounds(child, rows), bound[open_])
                    heapq.heappush(heap, (-float(b.max()), child, rows, b))
                continue
            first, end = self.span[node].tolist()
            for at in range(first, end, 4096):
                some = slice(at, min(end, at + 4096))
                if exact:
                    score = q[rows] @ points[some].T
                else:  # beyond 52 bits: integers
                    score = (queries[rows].astype(object) @ self.points[some].astype(object).T).astype(np.float64)
                score[query_ids[rows][:, None] == self.ids[some][None, :]] = -np.inf
                best.add(rows, score, self.ids[some])


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column]) if len(column) else np.zeros((0, 0), np.int64)


def _found(tree: BallTree, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """query_id, vec_id, score: what one tree has for the queries, from the floor of each on."""
    best = Best(len(ids), k, floor)
    tree.search(vectors, ids, best)
    row, col = np.nonzero((best.score > -np.inf) & (best.score >= best.floor[:, None]))
    return {"query_id": ids[row], "vec_id": best.id[row, col], "score": best.score[row, col].astype(np.int64)}


def _trees(points: DataFrame, folder: str) -> DataFrame:
    """dim, shard, path of a ball tree for each shard."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/tree-{key[0]}-{key[1]}.npz"
        write_file(path, BallTree(_matrix(rows["v"]), rows["vec_id"].to_numpy()).dump())
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "path": [path]})

    return written(points.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, path string"), "topk-trees")


def _blocks(queries: DataFrame, blocks: int, folder: str) -> None:
    """Writes queries(vec_id, dim, v, home, floor, block) as a file for each block."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, out = list(batches), {}
        for dim, rows in pa.Table.from_batches(parts).to_pandas().groupby("dim") if parts else ():
            out |= {f"ids-{dim}": rows["vec_id"].to_numpy(np.int64), f"v-{dim}": _matrix(rows["v"]), f"home-{dim}": rows["home"].to_numpy(np.int64), f"floor-{dim}": rows["floor"].to_numpy(np.float64)}
        data = io.BytesIO()
        np.savez(data, **out)
        block = TaskContext.get().partitionId()
        write_file(f"{folder}/block-{block}.npz", data.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], names=["block"])

    written(queries.repartitionById(blocks, F.col("block")).mapInArrow(write, "block int"), "topk-blocks")


def _searched(trees: DataFrame, shards: int, met: tuple[int, int], blocks: int, folder: str, k: int) -> DataFrame:
    """What the trees have for the queries whose home is as many shards before them as a wave says, from met[0] to below met[1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, shard, path in zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "path"))):
                tree = BallTree.load(path)
                for block in range(blocks):
                    with open_file(f"{folder}/block-{block}.npz") as f:
                        q = np.load(io.BytesIO(f.read()))
                    if f"ids-{dim}" not in q:
                        continue
                    behind = (shard - q[f"home-{dim}"]) % shards
                    now = np.flatnonzero((behind >= met[0]) & (behind < met[1]))
                    if len(now):
                        found = _found(tree, q[f"ids-{dim}"][now], q[f"v-{dim}"][now], q[f"floor-{dim}"][now], k)
                        yield pa.RecordBatch.from_pydict(found)

    tasks = max(1, min(trees.count(), MOST_TASKS))
    return trees.repartition(tasks, "dim", "shard").mapInArrow(run, _PART)


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query; Spark cuts each partition down to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _with_floor(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """queries with floor: the k-th score so far."""
    reached = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    return queries.join(reached, "vec_id", "left").select("vec_id", "dim", "v", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "block")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best of all vectors for each vector that satisfies is_query (a condition on vec_id)."""
    all_ = written(quantised(vectors, scale), "topk-vectors")
    total, asked = all_.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_rows))
    of = lambda what, n: F.pmod(F.xxhash64("vec_id", F.lit(what)), F.lit(n)).cast("int")
    folder = new_folder(vectors.sparkSession, "topk")
    trees = _trees(all_.withColumn("shard", of("shard", shards)), folder)
    # rows of one query id are one query
    queries = all_.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*")
    queries = written(queries.withColumn("block", of("block", blocks)).withColumn("home", of("home", shards)), "topk-queries")

    def at_home(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.DataFrame(_found(BallTree.load(right["path"][0]), left["vec_id"].to_numpy(), _matrix(left["v"]), np.full(len(left), -np.inf), k))

    own = trees.select("dim", F.col("shard").alias("home"), "path")
    at_first = queries.groupBy("dim", "home").cogroup(own.groupBy("dim", "home")).applyInPandas(at_home, _PART)
    best, met = written(_best(at_first, k), "topk-best", asked * k), 1
    while met < shards:
        wave = f"{folder}/wave-{met}"
        _blocks(_with_floor(queries, best, k), blocks, wave)
        found = _searched(trees, shards, (met, met * WIDER), blocks, wave, k)
        found = best.select("query_id", "vec_id", "score").unionByName(found)
        best, old, met = written(_best(found, k), "topk-best", asked * k), best, met * WIDER
        drop_table(old)
        drop_folder(vectors.sparkSession, wave)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
