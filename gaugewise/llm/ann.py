"""Operator 5, approximate nearest neighbours by largest inner product: a hierarchical k-means tree.

The tree is fitted on the driver from a bounded sample (``sample`` vectors, the first by a hash of vec_id); every vector
is then put into its leaf. A query walks the tree best-bin-first: a priority queue holds open branches by the inner
product with their centre, the best one is opened next, and leaves are visited until the best open branch lies more than
``margin`` below the best leaf. So a query within a dense cluster sees a few leaves and one in the open sees many.
The margin is calibrated: for some queries the true neighbours over all rows are found in blocks, and the margin is
widened until the wanted share of them lies in visited leaves.

Leaves are packed in tree order into buckets of bounded size, a large leaf over several; queries are cut into blocks.
A task holds one bucket and one block of its queries, so neither a hot leaf nor many queries grow it; it returns the
nearest ones of each query, and the final ranking is a window over those.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not
the most frequent one (the longer at a tie); rows without vec_id take no part; repeated rows of a vec_id are one
candidate with its best score; with fewer candidates than k all are returned; other columns are not read, so their names
cannot clash; an empty table gives no rows. Equal scores are ordered by vec_id.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gaugewise.llm.common import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
SAMPLE = 20_000
BRANCHES = 8
LEAF_SAMPLE = 64
BUCKET = 8_192
QUERY_BLOCK = 16_384
CALIBRATION = 200
RECALL = 0.97


@dataclass
class Tree:
    """Nodes by number, 0 the root: centres, children (empty: a leaf) and the leaves' own numbers."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node, out = [(0, np.arange(len(x)))], np.zeros(len(x), np.int64)
        while node:
            at, rows = node.pop()
            if not len(self.children[at]):
                out[rows] = self.leaf[at]
            elif len(rows):
                c = self.centres[self.children[at]]
                near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
                node += [(int(child), rows[near == i]) for i, child in enumerate(self.children[at])]
        return out

    def visits(self, q: np.ndarray, margin: float, population: np.ndarray, least: int) -> Iterator[tuple[int, float]]:
        """Leaves in best-bin-first order with the margin that reaches them, while that is at most ``margin`` or the
        leaves so far hold fewer than ``least`` vectors."""
        near = self.centres @ q
        queue, best, needed, seen = [(-np.inf, 0)], None, 0.0, 0
        while queue:
            priority, at = heapq.heappop(queue)
            if best is not None:
                needed = max(needed, best + priority)
                if needed > margin and seen >= least:
                    return
            if len(self.children[at]):
                for child in self.children[at]:
                    heapq.heappush(queue, (-near[child], int(child)))
            else:
                best = -priority if best is None else max(best, -priority)
                seen += population[self.leaf[at]]
                yield int(self.leaf[at]), needed


def fitted(x: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 5) -> Tree:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres, children = [x.mean(0)], [np.zeros(0, np.int64)]
    todo = [(0, x)]
    while todo:
        at, rows = todo.pop()
        if len(rows) <= leaf_sample:
            continue
        c = rows[rng.choice(len(rows), branches, replace=False)]
        for _ in range(10):
            near = np.argmin((c * c).sum(1) - 2 * rows @ c.T, axis=1)
            c = np.array([rows[near == i].mean(0) if (near == i).any() else c[i] for i in range(branches)])
        near = np.argmin((c * c).sum(1) - 2 * rows @ c.T, axis=1)
        used = [i for i in range(branches) if (near == i).any()]
        if len(used) < 2:
            continue
        children[at] = np.arange(len(centres), len(centres) + len(used))
        for i in used:
            todo.append((len(centres), rows[near == i]))
            centres.append(c[i])
            children.append(np.zeros(0, np.int64))
    is_leaf = np.array([not len(c) for c in children])
    return Tree(np.array(centres), children, np.cumsum(is_leaf) - 1, int(is_leaf.sum()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int,
            allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query number: the k vec_ids whose best rows have the largest inner products, and these scores; ``allowed``:
    which rows count."""
    # So many rows have k vec_ids at least.
    rows = k * int(np.unique(ids, return_counts=True)[1].max(initial=1))
    for a in range(0, len(queries), 512):
        scores = queries[a:a + 512] @ x.T
        for i, row in enumerate(scores):
            row[ids == own[a + i]] = -np.inf
            if allowed is not None:
                row[~allowed[a + i]] = -np.inf
            # The products above may differ in the last bit between equal vectors; those kept are taken again.
            kth = np.partition(row, -rows)[-rows] if len(row) > rows else -np.inf
            at = np.flatnonzero((row >= kth - 1e-9 * (1 + abs(kth)) if np.isfinite(kth) else row > -np.inf))
            exact = (x[at] * queries[a + i]).sum(1)
            order = np.lexsort((ids[at], -exact))
            if rows > k:
                order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
            yield a + i, ids[at[order[:k]]], exact[order[:k]]


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and ``v`` of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        "vec_id", v.alias("v"))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.filter(F.size("v") == (width["w"] if width else -1))


def repeats(rows: DataFrame) -> int:
    """The most rows that one vec_id has."""
    return rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1


def searched(vectors: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE, bucket: int = BUCKET,
             query_block: int = QUERY_BLOCK, recall: float = RECALL) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k nearest found of each query row."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    most = repeats(rows)
    if most > 1:  # repeated rows are one; other vectors under the same vec_id stay
        rows = stage(rows.distinct(), "vectors")
        most = repeats(rows)
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(picked.column("v")[0])
    tree = fitted(matrix(picked.column("v"), width))
    shared = spark.sparkContext.broadcast(tree)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.assigned(matrix(
                batch.column(1), width)))], ["vec_id", "v", "leaf"])

    element = rows.schema["v"].dataType.simpleString()
    placed = stage(rows.mapInArrow(put, f"vec_id long, v {element}, leaf long"), "leaves")
    population = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row per leaf of the fixed-size tree
        population[r["leaf"]] = r["count"]
    queries = placed.filter(is_query).dropDuplicates(["vec_id"])
    margin = calibrated(tree, placed, queries, population, width, k, recall, most)

    # Buckets of bounded size in tree order; a large leaf is spread over several by a hash of vec_id.
    parts = np.maximum(1, -(-population // bucket))
    first, load, at = np.zeros(tree.leaves, np.int64), 0, 0
    for leaf, n in enumerate(population):
        if load + n > bucket and load:
            at, load = at + 1, 0
        first[leaf], load = at, load + n
        if parts[leaf] > 1:
            at, load = at + parts[leaf], 0
    blocks = max(1, -(-queries.count() // query_block))
    layout = spark.sparkContext.broadcast((first, parts, population, margin))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = layout.value[:2]
        for batch in batches:
            leaf, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            where = first[leaf] + (ids * 2_654_435_761 >> 7) % parts[leaf]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where)], ["vec_id", "v", "leaf", "bucket"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, population, margin = layout.value
        for batch in batches:
            row, leaves, buckets = [], [], []
            for i, q in enumerate(matrix(batch.column(1), width)):
                seen: dict[int, list[int]] = {}
                for leaf, _ in shared.value.visits(q, margin, population, (k + 1) * most):
                    for b in range(first[leaf], first[leaf] + parts[leaf]):
                        seen.setdefault(b, []).append(leaf)
                row += [i] * len(seen)
                buckets += seen.keys()
                leaves += seen.values()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())),
                pa.array(leaves, pa.list_(pa.int64())), pa.array(buckets, pa.int64())],
                ["query_id", "q", "leaves", "bucket"])

    def matched(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, leaf, x = right["vec_id"].to_numpy(), right["leaf"].to_numpy(), matrix(right["v"], width)
            own, q = left["query_id"].to_numpy(), matrix(left["q"], width)
            for a in range(0, len(q), 512):
                lists = left["leaves"][a:a + 512].to_pylist()
                allowed = np.array([np.isin(leaf, y) for y in lists])
                for i, near, score in nearest(q[a:a + 512], ids, x, own[a:a + 512], k, allowed):
                    found[0].append(np.full(len(near), own[a + i]))
                    found[1].append(near)
                    found[2].append(score)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(np.concatenate([e, *y])) for e, y in zip(empty, found)],
                        names=["query_id", "vec_id", "score"])

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    asked = queries.select("vec_id", "v").mapInArrow(
        walked, f"query_id long, q {element}, leaves array<long>, bucket long").withColumn("block", block)
    held = placed.mapInArrow(bucketed, f"vec_id long, v {element}, leaf long, bucket long").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = asked.groupBy("bucket", "block").cogroup(held.groupBy("bucket", "block")).applyInArrow(
        matched, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def calibrated(tree: Tree, placed: DataFrame, queries: DataFrame, population: np.ndarray, width: int, k: int,
               recall: float, most: int = 1) -> float:
    """The smallest margin that reaches the share ``recall`` of the true neighbours of ``CALIBRATION`` queries."""
    tried = queries.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(CALIBRATION).toArrow()
    if not tried.num_rows:
        return np.inf
    own, q = tried["vec_id"].to_numpy(), matrix(tried["v"], width)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            # Positions stand in for ids here, so that the leaf can be told.
            order = np.argsort(ids, kind="stable")
            x, ids, leaf = matrix(batch.column(1), width)[order], ids[order], leaf[order]
            places = np.arange(len(ids))
            for i, near, score in nearest(q, places, x, np.full(len(q), -1), min((k + 1) * most, len(ids))):
                other = ids[near] != own[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(other.sum(), i)), pa.array(ids[near][other]),
                                                  pa.array(leaf[near][other]), pa.array(score[other])],
                                                 ["i", "vec_id", "leaf", "score"])

    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    near = placed.mapInArrow(block, "i long, vec_id long, leaf long, score double").groupBy("i", "vec_id").agg(
        F.max(F.struct("score", "leaf")).alias("s")).select("i", "vec_id", "s.*")
    true = near.withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("i", "leaf").collect()
    needed: list[float] = []
    reach = [dict(tree.visits(x, np.inf, population, 0)) for x in q]
    for r in true:  # at most CALIBRATION * k rows
        needed.append(reach[r["i"]][r["leaf"]])
    return float(np.quantile(needed, recall, method="higher")) if needed else np.inf
