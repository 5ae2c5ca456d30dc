"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node parts its sample rows at the median of a random projection, a leaf holds about
``LEAF_ROWS`` rows of the whole table. Every row goes down every tree. A query walks all trees at once with one priority
queue of the branches it did not take, nearest split first, until the leaves it visited hold ``share`` of the rows, over all
trees. Leaves meet queries in blocks; the best of each block are reranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.llm.common import numbered
from duelframe.llm.vectors import in_runs, matrix, numbers, product, runs, usable
from duelframe.storage import materialise

K = 20
TREES = 8
#: Share of a tree's rows in the leaves a query visits, on average over the trees. On unstructured vectors 8 trees reach a recall of
#: 0.95 with it; the more the vectors cluster, the less is needed.
SHARE = 0.16
LEAF_ROWS = 2000
#: At most about so many rows are sampled to fit the trees, whatever the table's size; every row is indexed.
SAMPLE_ROWS = 20_000
MAX_DEPTH = 9
#: Rows and queries of a leaf that are compared at once.
ROW_BLOCK = 4096
QUERY_BLOCK = 1024
#: Results that a task gathers before it brings them down to the best of each query.
HELD_ROWS = 400_000
#: Pairs whose products are summed component by component at once.
EXACT_PAIRS = 1 << 15


class Forest:
    """Fitted trees: node i of a tree has children 2i and 2i + 1, leaves are numbered from 2^depth on."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 5, leaf_rows: int = LEAF_ROWS):
        rng = np.random.default_rng(seed)
        depth = int(np.clip(np.ceil(np.log2(max(rows, 1) / leaf_rows)), 0, MAX_DEPTH))
        while depth and len(sample) < 4 << depth:
            depth -= 1
        self.depth, self.trees = depth, trees
        self.normals = rng.normal(size=(trees, 1 << depth, sample.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, 1 << depth))
        self.weights = np.zeros((trees, 2 << depth))
        for t in range(trees):
            node = np.ones(len(sample), np.int64)
            for level in range(depth):
                along = np.einsum("ij,ij->i", sample, self.normals[t][node])
                for n in range(1 << level, 2 << level):
                    inside = along[node == n]
                    self.cuts[t, n] = np.median(inside) if len(inside) else 0.0
                node = 2 * node + (along > self.cuts[t][node])
            self.weights[t] = np.bincount(node, minlength=2 << depth) / max(len(sample), 1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` in each tree, numbered over the whole forest."""
        out = np.empty((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", x, self.normals[t][node])
                node = 2 * node + (along > self.cuts[t][node])
            out[:, t] = t * (2 << self.depth) + node
        return out

    def visited(self, query: np.ndarray, share: float) -> list[int]:
        """Leaves of all trees, in the order in which one queue of untaken branches gives them out."""
        margins = self.normals @ query - self.cuts
        queue = [(0.0, t, 1) for t in range(self.trees)]
        found, seen = [], 0.0
        while queue and (seen < share * self.trees or len(found) < self.trees):
            far, t, node = heapq.heappop(queue)
            while node < 1 << self.depth:
                margin = margins[t, node]
                near = 2 * node + (margin > 0)
                heapq.heappush(queue, (max(far, abs(margin)), t, near ^ 1))
                node = near
            found.append(t * (2 << self.depth) + node)
            seen += self.weights[t, node]
        return found


def classes(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(rid, vec) of each different usable vector of the most common dimension, numbered by its smallest id, and that dimension."""
    vec = F.col(vector).cast("array<double>")
    good = rows.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(vec.alias("vec"), F.col(key).cast("long").alias("id"))
    most = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = most["d"] if most else 0
    each = good.where(F.size("vec") == size).groupBy("vec").agg(F.min("id").alias("first"))
    each = numbered(each, [F.col("first"), F.xxhash64("vec")], "forest-numbered", "rid")
    return materialise(each.select("rid", "vec"), "forest-vectors"), size


def _blocks(df: DataFrame, limit: int, name: str) -> DataFrame:
    """(leaf, ids, vectors): rows (run, leaf, rid, vec) packed by leaf, at most ``limit`` to a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "run", limit):
            x = np.ascontiguousarray(matrix(part.column(3)))
            row = [[part.column(1)[0].as_py()], [part.column(2).to_numpy().tobytes()], [x.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["leaf", "ids", "x"])

    return materialise(in_runs(df.select("run", "leaf", "rid", "vec"), "run").mapInArrow(pack, "leaf long, ids binary, x binary"), name)


def nearest(
    rows: DataFrame,
    asked: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    trees: int = TREES,
    share: float = SHARE,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``asked`` picks, among all other rows.

    Nearness is the inner product in double precision on the original vectors, ties go to the smaller id; a query meets
    every id but its own, and gets all candidates found if they are fewer than ``k``. Vectors that are NULL, zero, or hold
    NULL or non-finite components take no part, nor do rows with a NULL id or another dimension than most. Equal vectors are
    searched as one, and stand for the ``k`` + 1 smallest of their ids, which is as many as a result can hold. A
    repeated id is one candidate, with its best score. An empty table gives an empty table.
    """
    every, size = classes(rows, key, vector)
    n = every.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    part = min(1.0, sample_rows / n)
    picked = every.where(F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * part) + 1)
    sample = np.array([r["vec"] for r in picked.select("vec").limit(2 * sample_rows).collect()]).reshape(-1, size)
    forest = Forest(sample, n, trees, seed, leaf_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.leaves(matrix(batch.column(1)))
            ids = np.repeat(batch.column(0).to_numpy(), trees)
            vec = batch.column(1).take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), pa.array(ids), vec], ["leaf", "rid", "vec"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest.visited(q, share) for q in matrix(batch.column(1))]
            at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["leaf", "rid", "vec"]
            )

    # ids of each class, of rows and of queries: of many equal vectors only as many as can be in a result
    vec = F.col(vector).cast("array<double>")
    keyed = rows.where(usable(F.col(vector)) & F.col(key).isNotNull() & (F.size(vector) == size))
    keyed = keyed.select(F.col(key).cast("long").alias("id"), vec.alias("vec"), asked.alias("asked"))
    keyed = keyed.groupBy("vec", "id").agg(F.max("asked").alias("asked"))
    named = materialise(keyed.join(every, "vec").select("rid", "id", "asked"), "forest-ids")
    first = Window.partitionBy("rid").orderBy("id")
    ids = named.select("rid", "id", F.row_number().over(first).alias("_n")).where(F.col("_n") <= k + 1).drop("_n")
    queries = materialise(named.where("asked").select("rid", F.col("id").alias("query_id")), "forest-queries")

    shape = "leaf long, rid long, vec array<double>"
    width = max(1, round(n / max(1, (1 << forest.depth) * ROW_BLOCK)))
    placed = every.mapInArrow(place, shape).withColumn("run", F.xxhash64("leaf", F.pmod(F.xxhash64("rid"), F.lit(width))))
    right = _blocks(placed, ROW_BLOCK, "forest-rows")
    asking = every.join(queries.select("rid").distinct(), "rid").mapInArrow(walk, shape)
    asking = asking.withColumn("run", F.xxhash64("leaf", F.pmod(F.xxhash64("rid"), F.lit(1 + n // (20 * QUERY_BLOCK * 16)))))
    left = _blocks(asking, QUERY_BLOCK, "forest-asked")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best of each block of the task, brought down to the best of each query whenever they are many
        held: list[tuple[np.ndarray, ...]] = []
        rows, most = 0, HELD_ROWS
        for batch in batches:
            for q_ids, q, ids, x in zip(*(batch.column(c) for c in ("q_ids", "q", "ids", "x")), strict=True):
                a, b = (np.frombuffer(i.as_buffer(), np.int64) for i in (q_ids, ids))
                at, of, exact = _top(np.frombuffer(q.as_buffer()).reshape(len(a), size), np.frombuffer(x.as_buffer()).reshape(len(b), size), k + 1)
                held.append(_nearest(a[at], b[of], exact, k + 1))
                rows += len(held[-1][0])
                if rows > most:
                    held = [_nearest(*map(np.concatenate, zip(*held, strict=True)), k + 1)]
                    rows = len(held[0][0])
                    if rows > most // 2:
                        yield numbers("q rid near", *held[0])
                        held, rows = [], 0
        if held:
            yield numbers("q rid near", *_nearest(*map(np.concatenate, zip(*held, strict=True)), k + 1))

    met = left.select("leaf", F.col("ids").alias("q_ids"), F.col("x").alias("q")).join(right, "leaf").select("q_ids", "q", "ids", "x")
    found = met.mapInArrow(best, "q long, rid long, near double").groupBy("q", "rid").agg(F.max("near").alias("near"))
    near = Window.partitionBy("q").orderBy(F.desc("near"), "rid")
    found = found.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1).select("q", "rid")
    scored = found.join(every.select("rid", F.col("vec").alias("x")), "rid").join(every.select(F.col("rid").alias("q"), F.col("vec").alias("y")), "q")
    scored = materialise(scored.select("q", "rid", product(F.col("y"), F.col("x")).alias("score")), "forest-scored")
    pairs = scored.join(queries.withColumnRenamed("rid", "q"), "q").join(ids.withColumnRenamed("id", "vec_id"), "rid").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and products, of all pairs that may be among the ``k`` nearest of a query.

    A matrix product differs from ``product`` in the last bits; what is within that of the k-th is kept, and computed as ``product`` does, from the
    first component on. So equal products stay equal, and ties are for the order of rows to decide.
    """
    score = queries @ rows.T
    take = min(k, len(rows))
    cut = -np.partition(-score, take - 1, axis=1)[:, take - 1]
    slack = 8 * rows.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    at, of = np.nonzero(score >= (cut - slack)[:, None])
    exact = np.empty(len(at))
    for i in range(0, len(at), EXACT_PAIRS):
        some = slice(i, i + EXACT_PAIRS)
        exact[some] = np.cumsum(queries[at[some]] * rows[of[some]], axis=1)[:, -1]
    return at, of, exact


def _nearest(q: np.ndarray, rid: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest of each query, each row once."""
    order = np.lexsort((-near, rid, q))
    q, rid, near = q[order], rid[order], near[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (rid[1:] != rid[:-1])])
    q, rid, near = q[once], rid[once], near[once]
    order = np.lexsort((rid, -near, q))
    q, rid, near = q[order], rid[order], near[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
    place = np.arange(len(q)) - np.repeat(begin, np.diff([*begin, len(q)]))
    return q[place < k], rid[place < k], near[place < k]


def recall(rows: DataFrame, found: DataFrame, queries: list[int], key: str = "vec_id", vector: str = "embedding", k: int = K) -> float:
    """Share of the true ``k`` nearest of a few stated queries that ``found`` has, by comparing them with every row."""
    vec = F.col(vector).cast("array<double>")
    good = rows.where(usable(F.col(vector))).select(F.col(key).alias("vec_id"), vec.alias("x"))
    few = F.broadcast(good.where(F.col("vec_id").isin(queries)).select(F.col("vec_id").alias("query_id"), F.col("x").alias("y")))
    every = good.join(few, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", product(F.col("y"), F.col("x")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query_id", "vec_id")
    total = true.count()
    return true.join(found, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op10_projection_forest: the 20 nearest of every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 20 == 0)
