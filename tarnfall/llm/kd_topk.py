"""Exact top-k by inner product over KD-trees, one per shard.

The vectors are dealt out to shards by hash. A shard's KD-tree splits at the median of the widest dimension; each node has
the tight bounding box of its vectors, whose best possible inner product with a query is an upper bound. Queries go in
blocks: nodes are visited best bound first, each by the queries of the block whose bound reaches their kth score so far,
and the search ends when no bound left does.

Every query first searches one shard; the kth score found there is passed on to its searches of all others, which return
only what can still enter the result. Queries go in blocks: a task holds one shard and one group of query blocks.

Defined results: rows with null or non-finite components, or without a vector, take no part, nor do vectors of a length
other than the query's. All other finite vectors do: inner products are exact whatever their size, a score beyond a long
is reported as the least or greatest long (more than -2**63), and such scores tie. Ties go to the smaller vec_id. Every
query row has its own k results: an id on several vectors is asked with each of them, and a row that comes twice has its
results twice. Rows that repeat a vec_id are candidates of their own for other ids' queries; rows with the query's own id
are no candidates. Null ids take no part. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfall.llm.shared import bound_batches, saved

FOUND = "query long, query_id long, vec_id long, score long"
OUT = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")])


class KdTree:
    """Nodes in arrays: boxes, row ranges, children (-1 for a leaf)."""

    def __init__(self, vectors: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(vectors))
        lows, highs, ranges, children = [], [], [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = vectors[self.order[lo:hi]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(ranges)
            lows.append(low), highs.append(high), ranges.append((lo, hi)), children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if hi - lo > leaf and (high > low).any():
                mid = (hi - lo) // 2
                part = np.argpartition(rows[:, int(np.argmax(high - low))], mid)
                self.order[lo:hi] = self.order[lo:hi][part]
                todo += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.lows, self.highs, self.ranges, self.children = np.array(lows), np.array(highs), ranges, children
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray, node=slice(None)) -> np.ndarray:
        """The largest inner product with each query that the box of the node (of each node) allows."""
        return np.maximum(queries, 0) @ self.highs[node].T + np.minimum(queries, 0) @ self.lows[node].T

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best-first for a block of queries: (query, id, score) of what can be among the k best of each, given that its kth
        best score is ``floors`` at least.

        A node goes to the queries whose bound still reaches their kth best score, in the order of its best bound; nodes and
        leaves are met by all these queries in one product. own: the queries' ids, which are not their candidates.
        """
        floors = floors.copy()
        best = np.zeros((3, 0), np.int64)

        def enter(node: int, some: np.ndarray) -> None:
            bound = whole(self.bounds(queries[some], node))
            heapq.heappush(heap, (-int(bound.max()), node, some, bound))

        heap: list[tuple] = []
        enter(0, np.arange(len(queries)))
        while heap:
            _, node, some, bound = heapq.heappop(heap)
            some = some[bound >= floors[some]]
            if not len(some):
                continue
            left, right = self.children[node]
            if left >= 0:
                enter(left, some), enter(right, some)
                continue
            lo, hi = self.ranges[node]
            score = whole(queries[some] @ self.vectors[lo:hi].T)
            row, at = np.nonzero((score >= floors[some, None]) & (ids[lo:hi] != own[some, None]))
            best = np.concatenate([best, np.stack([some[row], ids[lo:hi][at], score[row, at]])], axis=1)
            best = best[:, np.lexsort((best[1], -best[2], best[0]))]
            first = np.searchsorted(best[0], best[0])
            best = best[:, np.arange(best.shape[1]) - first < k]
            full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) == k)
            last = np.searchsorted(best[0], full, side="right") - 1
            floors[full] = np.maximum(floors[full], best[2, last])
        return best[0], best[1], best[2]


LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max  # the least has a negative of its own


def whole(x: np.ndarray) -> np.ndarray:
    """Exact products as longs; what is beyond a long becomes the least or greatest one."""
    return x.astype(np.int64) if x.dtype != object else np.clip(x, LEAST, MOST).astype(np.int64)


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double (exact: beyond 2**52 a double is whole); null if a component is null, or
    it or its multiple is not finite."""
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)))

    def lower(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.when(fine, F.transform(embedding, lower))


def packed(rows: DataFrame, key: str) -> DataFrame:
    """One row (key, dim, ids, queries, vectors) per key and batch of Arrow rows: the rows of a key are sent as arrays, not row by
    row. rows: key, vec_id, query (a number of the row, if rows are queries), v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, queries = (batch.column(c).to_numpy() for c in (key, "vec_id", "query"))
            dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            flat, at = batch.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for k, dim in {*zip(keys.tolist(), dims.tolist(), strict=True)}:
                own = np.flatnonzero((keys == k) & (dims == dim))
                vectors = flat[at[own][:, None] + np.arange(dim)]
                small = vectors.astype(np.int32) if np.abs(vectors).max(initial=0) < 2**31 else vectors  # else doubles, whole too
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([x[own].astype(np.int64).tobytes()]) for x in (ids, queries)), pa.array([small.tobytes()])], names=["key", "dim", "ids", "queries", "vectors"])

    number = F.col("query") if "query" in rows.columns else F.lit(0).cast("long")
    return rows.select(F.col(key).cast("int").alias(key), "vec_id", number.alias("query"), "v").mapInArrow(run, "key int, dim int, ids binary, queries binary, vectors binary")


def arrays(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(vectors) == 4 * len(own) * dim else np.float64
    return own, np.frombuffer(vectors, kind).astype(np.float64).reshape(len(own), dim)


def exact(x: np.ndarray, large: float) -> np.ndarray:
    """The vectors in a type in which inner products are exact: doubles, or Python's integers where sums could pass 2**52."""
    return x if x.shape[1] * large * large < 2**52 else np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def search_shard(shard: list[dict], queries: list[dict], k: int) -> Iterator[pa.RecordBatch]:
    """Searches all of a shard's KD-trees, one per vector length, for all queries."""
    for dim in {r["dim"] for r in shard}:
        own = [arrays(r["ids"], r["vectors"], dim) for r in shard if r["dim"] == dim]
        asked = [(*arrays(r["ids"], r["vectors"], dim), np.frombuffer(r["floors"], np.int64), np.frombuffer(r["queries"], np.int64)) for r in queries if r["dim"] == dim]
        if not asked:
            continue
        ids, vectors = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
        large = max(float(np.abs(x).max(initial=0)) for x in [vectors, *(q[1] for q in asked)])
        tree = KdTree(exact(vectors, large))
        ids = ids[tree.order]
        for query_ids, rows, floors, numbers in asked:
            rows = exact(rows, large)
            for lo in range(0, len(rows), 256):
                some = query_ids[lo : lo + 256]
                row, found, score = tree.search(rows[lo : lo + 256], some, floors[lo : lo + 256], ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (numbers[lo : lo + 256][row], some[row], found, score)], schema=OUT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = 16384, block: int = 512, blocks_per_task: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest integer inner products for each query row.

    vectors: vec_id, embedding. is_query: which rows are queries.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", is_query.alias("q"), scaled(F.col("embedding"), scale).alias("v")).where("v is not null")
    rows = saved(rows.withColumn("h", F.xxhash64("vec_id", "v", F.monotonically_increasing_id())), "vectors")  # rows that repeat go to many shards
    shards = max(1, -(-rows.count() // shard_rows))
    pack = packed(rows.withColumn("key", F.pmod("h", F.lit(shards)).cast("int")).repartition(shards, "key").sortWithinPartitions("key"), "key")
    pack = saved(pack, "shards").withColumnRenamed("key", "shard")
    distinct = saved(rows.where("q").groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("query", F.xxhash64("vec_id", "v")), "distinct")
    blocks = max(1, -(-distinct.count() // block))
    asked = saved(packed(distinct.withColumn("key", F.pmod("query", F.lit(blocks)).cast("int")).repartition(min(blocks, 4096), "key").sortWithinPartitions("key"), "key"), "queries")
    group = F.expr(f"key div {blocks_per_task}").cast("int")
    groups = -(-blocks // blocks_per_task)
    home = F.pmod(F.xxhash64(F.lit("home"), "key"), F.lit(shards)).cast("int")

    def search(queries: DataFrame) -> DataFrame:
        """queries: packed rows with floors, shard (to search) and group; each task gets one shard and one group."""
        each = pack.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            shard, some = left.to_pylist(), right.to_pylist()
            return pa.Table.from_batches(search_shard(shard, some, k) if shard and some else [], OUT)

        return each.groupBy("shard", "group").cogroup(queries.groupBy("shard", "group")).applyInArrow(run, FOUND)

    lowest = int(LEAST)

    def no_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) // 8 for x in b.column("ids").to_pylist()]
            yield b.append_column("floors", pa.array([np.full(x, lowest).tobytes() for x in n], pa.binary()))

    packed_schema = "key int, dim int, ids binary, queries binary, vectors binary, floors binary"
    first = saved(search(asked.mapInArrow(no_floor, packed_schema).withColumn("shard", home).withColumn("group", group)), "home")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    kth = kth.withColumn("key", F.pmod("query", F.lit(blocks)).cast("int")).groupBy("key").agg(F.collect_list(F.struct("query", "floor")).alias("known"))

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                known = {x["query"]: x["floor"] for x in row["known"] or ()}
                of = np.array([known.get(i, lowest) for i in np.frombuffer(row["queries"], np.int64).tolist()], np.int64)
                same = [pa.array([row[c]]) for c in ("ids", "queries", "vectors")]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]], pa.int32()), pa.array([row["dim"]], pa.int32()), *same, pa.array([of.tobytes()])], names=["key", "dim", "ids", "queries", "vectors", "floors"])

    told = saved(asked.join(kth, "key", "left").select("key", "dim", "ids", "queries", "vectors", "known").mapInArrow(with_floors, packed_schema), "told")
    others = told.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home).withColumn("group", group)
    found = first.unionByName(search(others)) if shards > 1 else first
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    again = distinct.where("times > 1").select("query", "times")
    if not again.isEmpty():
        best = best.join(again, "query", "left").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
    return best.select("query_id", "rank", "vec_id", "score")
