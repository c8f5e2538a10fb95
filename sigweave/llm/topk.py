"""Exact top-k search by integer inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt by their place to shards of about SHARD_ROWS rows; each shard is planted once, as one row with its tree: the
vectors in order of the leaves, and each node's centre, radius and smallest id. Queries are written once, in blocks of
BLOCK_ROWS, and blocks go to shards, never vectors to queries: a task reads a shard's tree and then its blocks one by one.
A block of queries takes the leaves in order of their largest upper bound q.c + |q|r; a leaf is multiplied at once with
the queries whose bound for it is not under their current k-th score. That score is shared: shards are searched in waves, each WAVE times as many as those before it, and a wave starts
from the k-th scores of all waves before, so that shards return only rows that can still be among the k best.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length
than the query's are no candidates for it; rows with the query's own id are its own; each row with a query's id is a query
with ranks of its own; equal scores go to the smaller id (a null id comes last, and a null id is no query); repeated
candidate rows count once each; scores beyond 64 bits are cut to the nearest 64-bit number; vectors of any length are taken
whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

SHARD_ROWS = 65_536
BLOCK_ROWS = 256
LEAF_ROWS = 128
WAVE = 8  # shards of a wave, for each one searched before it
_LAST = np.iinfo(np.int64).max


def scaled(vectors: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of list vectors without nulls, as float64 (whole numbers)."""
    flat = vectors.flatten() if len(vectors) else pa.array([], pa.float64())
    return np.floor(np.asarray(flat).astype(np.float64) * scale).reshape(len(vectors), dim)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q, exact, cut to 64 bits."""
    if not x.size or np.abs(x).max() * max(1.0, np.abs(q).max(initial=0)) * x.shape[1] < 2**53:
        return (x @ q).astype(np.int64)
    own = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, own, strict=True)), -(2**63)), 2**63 - 1) for row in x], np.int64)


def small(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = np.dtype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))
    return kind.char.encode() + x.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(data[:1].decode()), offset=1).astype(np.float64)


class BallTree:
    """Nodes hold rows a..b of the reordered vectors, their centre and radius, and the smallest id among them."""

    FIELDS = ("ids", "x", "nodes", "centre", "radius", "least")

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        order, self.nodes = np.arange(len(ids)), []
        todo = [(0, len(ids), -1)] if len(ids) else []
        while todo:
            a, b, parent = todo.pop()
            node = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            if parent >= 0:
                self.nodes[parent][2 if self.nodes[parent][2] < 0 else 3] = node
            if b - a > leaf:
                own = order[a:b]
                part = x[own]
                axis = int(np.argmax(part.max(0) - part.min(0))) if x.shape[1] else 0
                half = (b - a) // 2
                if x.shape[1]:
                    order[a:b] = own[np.argpartition(part[:, axis], half)]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.ids, self.x = ids[order], x[order]
        self.centre = np.array([self.x[a:b].mean(0) for a, b, *_ in self.nodes]).reshape(len(self.nodes), x.shape[1])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b, *_), c in zip(self.nodes, self.centre, strict=True)])
        self.least = np.array([self.ids[a:b].min() for a, b, *_ in self.nodes], np.int64)

    def stored(self) -> list[bytes]:
        """FIELDS as bytes."""
        return [self.ids.tobytes(), small(self.x), np.array(self.nodes, np.int64).tobytes(), self.centre.tobytes(), self.radius.tobytes(), self.least.tobytes()]

    @classmethod
    def read(cls, dim: int, parts: list[bytes]) -> BallTree:
        tree = cls.__new__(cls)
        ids, x, nodes, centre, radius, least = parts
        tree.ids, tree.least, tree.radius = np.frombuffer(ids, np.int64), np.frombuffer(least, np.int64), np.frombuffer(radius)
        tree.x = large(x).reshape(len(tree.ids), dim)
        tree.nodes, tree.centre = np.frombuffer(nodes, np.int64).reshape(-1, 4).tolist(), np.frombuffer(centre).reshape(-1, dim) if dim else np.zeros((len(tree.least), 0))
        return tree

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, by query and node."""
        norm = np.sqrt((q**2).sum(1))[:, None]
        far = norm * (self.radius[None] + np.sqrt((self.centre**2).sum(1))[None])
        return np.floor(q @ self.centre.T + norm * self.radius[None] + 1e-9 * far + 1e-6)

    def search(self, own: int, q: np.ndarray, bound: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """Up to k pairs (-score, id), best first; none under the score `floor`."""
        best: list[tuple[int, int]] = []
        worst = (-floor, _LAST) if floor is not None else (math.inf, _LAST)
        heap = [(-bound[0], 0)] if self.nodes else []
        while heap:
            upper, node = heapq.heappop(heap)
            if (upper, self.least[node]) > worst:
                if upper > worst[0]:
                    break
                continue
            a, b, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            scores = products(self.x[a:b], q)
            keep = np.flatnonzero((scores >= -worst[0]) & (self.ids[a:b] != own)) if worst[0] != math.inf else np.flatnonzero(self.ids[a:b] != own)
            if len(keep):
                best = sorted([*best, *((-int(scores[i]), int(self.ids[a + i])) for i in keep)])[:k]
                best = [p for p in best if p <= worst]
                if len(best) == k:
                    worst = min(worst, best[-1])
        return best

    def search_all(self, own: np.ndarray, q: np.ndarray, k: int, floors: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search() of all queries q at once: (query, id, score), best first. floors: the least score asked of some, by their place.

        Leaves are taken in order of their largest bound among the queries that still need them; a leaf is multiplied
        with all those at once.
        """
        n = len(own)
        ids, scores = np.full((n, k), _LAST), np.full((n, k), -math.inf)
        leaves = np.array([i for i, node in enumerate(self.nodes) if node[2] < 0], np.int64)
        if not len(leaves) or not n:
            return (np.zeros(0, np.int64),) * 3
        bound = self.bounds(q)[:, leaves]
        exact = np.abs(self.x).max(initial=0) * max(1.0, np.abs(q).max(initial=0)) * self.x.shape[1] < 2**53
        if not exact:  # one by one, in whole numbers of any size
            full = self.bounds(q)
            found = [(i, other, -minus) for i in range(n) for minus, other in self.search(int(own[i]), q[i], full[i], k, floors.get(i))]
            return tuple(np.array([f[c] for f in found], np.int64) for c in range(3))
        worst = np.full(n, -math.inf)  # no score under it can be among the k best
        for i, floor in floors.items():
            worst[i] = floor
        for at in np.argsort(-bound.max(0), kind="stable").tolist():
            ask = np.flatnonzero(bound[:, at] >= worst)
            if not len(ask):
                continue
            a, b, _, _ = self.nodes[leaves[at]]
            got = q[ask] @ self.x[a:b].T
            got[self.ids[None, a:b] == own[ask][:, None]] = -math.inf
            got[got < worst[ask][:, None]] = -math.inf
            some = np.flatnonzero(got.max(1) > -math.inf)
            if not len(some):
                continue
            rows, got = ask[some], got[some]
            i, j = np.nonzero(got > -math.inf)
            row = np.concatenate([np.repeat(np.arange(len(rows)), k), i])
            other = np.concatenate([ids[rows].ravel(), self.ids[a + j]])
            value = np.concatenate([scores[rows].ravel(), got[i, j]])
            order = np.lexsort((other, -value, row))
            row, other, value = row[order], other[order], value[order]
            start = np.searchsorted(row, np.arange(len(rows)))
            best = start[:, None] + np.arange(k)
            ids[rows], scores[rows] = other[best], value[best]
            worst[rows] = np.maximum(worst[rows], scores[rows, k - 1])
        i, j = np.nonzero(scores > -math.inf)
        return i, ids[i, j], scores[i, j].astype(np.int64)


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return df.select(F.col(key).cast("long").alias("__id"), F.col(vector).alias("__v")).where(good).withColumn("__dim", F.size("__v"))


def top_k(vectors: DataFrame, is_query: Column | None = None, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each query. vectors: a table (rows are dealt by their place in it)."""
    is_query = F.col("__id") % 50 == 0 if is_query is None else is_query
    rows = _vectors(vectors, key, vector)
    asks = is_query & F.col("__id").isNotNull()
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).first()
    shards, blocks = max(1, math.ceil(sizes["n"] / shard_rows)), max(1, math.ceil(sizes["q"] / block_rows))
    tasks = partitions(vectors.sparkSession)
    place = lambda n, seed: F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)).cast("int")  # noqa: E731  no id is hot

    def plant(group: pa.Table) -> pa.Table:
        dim = group["__dim"][0].as_py()
        ids = np.asarray(pc.fill_null(group["__id"], int(_LAST)))
        tree = BallTree(ids, scaled(group["__v"].combine_chunks(), dim, scale))
        return pa.table({"__dim": pa.array([dim], pa.int32()), "__shard": group["__shard"].combine_chunks()[:1], **{f: [v] for f, v in zip(BallTree.FIELDS, tree.stored(), strict=True)}})

    def bundle(group: pa.Table) -> pa.Table:
        dim = group["__dim"][0].as_py()
        x = scaled(group["__v"].combine_chunks(), dim, scale)
        return pa.table({"__dim": pa.array([dim], pa.int32()), "__block": group["__block"].combine_chunks()[:1], "qids": [np.asarray(group["__id"]).tobytes()], "q": [small(x)]})

    fields = ", ".join(f"{f} binary" for f in BallTree.FIELDS)
    trees = materialise(rows.withColumn("__shard", place(shards, 0)).groupBy("__dim", "__shard").applyInArrow(plant, f"__dim int, __shard int, {fields}"))
    blocked = materialise(rows.where(asks).withColumn("__block", place(blocks, 1)).groupBy("__dim", "__block").applyInArrow(bundle, "__dim int, __block int, qids binary, q binary"))

    def search(batches):
        tree, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if row["__block"] < 0:
                    at, tree = (row["__dim"], row["__shard"]), BallTree.read(row["__dim"], [row[f] for f in BallTree.FIELDS])
                elif at == (row["__dim"], row["__shard"]):  # or no row has this length and shard
                    yield answers(tree, row)

    def answers(tree: BallTree, row: dict) -> pa.RecordBatch:
        ids = np.frombuffer(row["qids"], np.int64)
        q = large(row["q"]).reshape(len(ids), row["__dim"])
        floors = {known["at"]: known["floor"] for known in row["floors"] or ()}
        i, other, score = tree.search_all(ids, q, k, floors)
        same = lambda v: pa.array(np.full(len(i), v, np.int32))
        return pa.RecordBatch.from_arrays([same(row["__dim"]), same(row["__block"]), pa.array(i.astype(np.int32)), pa.array(ids[i]), pa.array(other), pa.array(score)], schema=FOUND)

    def meet(low: int, high: int, floors: DataFrame | None) -> DataFrame:
        """Every block against the shards low .. high - 1."""
        asked = blocked.withColumn("floors", F.lit(None).cast("array<struct<at:int,floor:long>>")) if floors is None else blocked.join(floors, ["__dim", "__block"], "left")
        asked = asked.withColumn("__shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        copies = max(1, min(blocks, math.ceil(tasks / (high - low))))  # of each tree, for waves of few shards: no more trees than tasks
        asked = asked.withColumn("copy", F.pmod("__block", F.lit(copies)))
        own = trees.where(F.col("__shard").between(low, high - 1)).withColumn("__block", F.lit(-1)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        both = own.unionByName(asked, allowMissingColumns=True).repartition(copies * (high - low), "__dim", "__shard", "copy").sortWithinPartitions("__dim", "__shard", "copy", "__block")
        return both.mapInArrow(search, "__dim int, __block int, at int, query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("__dim", "__block", "at").orderBy(F.col("score").desc(), "vec_id"))
    best, done = None, 0
    while done < shards:
        floors, more = None, max(1, WAVE * done)
        if best is not None:  # one number per query, by block of queries
            kth = best.groupBy("__dim", "__block", "at").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
            floors = kth.groupBy("__dim", "__block").agg(F.collect_list(F.struct("at", "floor")).alias("floors"))
        found = meet(done, min(shards, done + more), floors)
        found = found if best is None else best.drop("rank").unionByName(found)
        best, done = materialise(found.withColumn("rank", rank).where(F.col("rank") <= k)), done + more
    return best.select("query_id", "rank", F.when(F.col("vec_id") != int(_LAST), F.col("vec_id")).alias("vec_id"), "score")


FOUND = pa.schema([("__dim", pa.int32()), ("__block", pa.int32()), ("at", pa.int32()), *((c, pa.int64()) for c in ("query_id", "vec_id", "score"))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
