"""Operator 11, ranked lexical search by two trees: whole batches of items meet whole batches of documents.

A score is a sum over an item's terms of a weight (rarity, from all documents) times an impact (saturated frequency, from
the document's length); both are integers of 0 or more. So for a set of items and a set of documents, the sum over terms of the
largest item weight times the largest impact is no less than any score between them. Items and documents each stand in a
tree whose nodes hold these maxima. A pair of nodes whose bound is below the weakest k-th score of its items cannot change
any result and is dropped with everything under it; other pairs are opened, best bound first, down to batches that
are scored exactly. Equal bounds are opened, as ties go to the smaller doc_id.

Items come in blocks of bounded terms, so what tasks get of them is bounded however long their table is; usually there is
one block. For a block, all documents are read once and kept as frequencies of the block's terms (a written stage), counted,
given impacts, and dealt into ranges by their strongest terms, so that a node's documents resemble each other and no group
is one task. Every task grows trees over chunks of its rows. First a sample of about ``SAMPLE`` documents is searched: its k-th
scores are lower bounds of the final ones and let the full search drop nearly everything; they change no result. Each
task gives at most k rows an item, and the k best of those are the answer.

Words are met by 64-bit hash, length and their first and last eight bytes, which is exact up to 16 bytes.

Cases: null or empty text has no terms, counts nowhere and is never ranked; an item without terms, or whose terms no document
has, gives no rows; a repeated document row is ranked again, a repeated item row asks again; null doc_ids rank last among
equal scores; other columns are not read, so their names cannot clash; empty tables give no rows. A text of any length is
one run of its own in memory; nothing is cut.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from gaugewise.llm.common import Words, lower_ascii, pieces, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 10
#: Fixed values of the contract: what stands between terms, how scores round, and how lengths weigh.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SCALE, FREQUENCY, LENGTH, SHARE = 1_000_000_000, 1000, 8, 75

BLOCK_TERMS = 16_384
BLOCK_ITEMS = 1_024
SAMPLE = 20_000
ITEM_LEAF, DOC_LEAF, FAN = 8, 32, 8
NODE_CELLS = 4_000_000


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms' counts, in blocks of at most so many items and distinct terms (or one item)."""
    block, seen = [], set()
    terms = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0))
    for row in items.select("item_id", terms.alias("terms")).toLocalIterator():
        counts = Counter(row["terms"] or ())
        if block and (len(block) == BLOCK_ITEMS or len(seen | counts.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        if counts:
            block.append((row["item_id"], counts))
            seen |= counts.keys()
    if block:
        yield block


class Terms:
    """The terms of a block, found among the words of texts."""

    def __init__(self, terms: list[str]) -> None:
        data = [t.encode() for t in terms]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in data])))
        words = Words(np.frombuffer(b"".join(data), np.uint8), bounds, SEPARATORS)
        hashes = words.hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.marks = [mark[self.order] for mark in self._marks(words)]

    @staticmethod
    def _marks(words: Words) -> list[np.ndarray]:
        """Length, first eight and last eight bytes of each word (zeros after a shorter one)."""
        padded = np.concatenate((words.data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(words.data) + 1, "<u8", padded.data, strides=(1,))
        length = words.end - words.start
        keep = np.where(length < 8, (np.uint64(1) << (8 * np.minimum(length, 7)).astype(np.uint64)) - np.uint64(1),
                        np.uint64(0xFFFFFFFFFFFFFFFF))
        return [length, eight[words.start] & keep, eight[np.maximum(words.end - 8, words.start)] & keep]

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the number of each one's term."""
        at = np.minimum(np.searchsorted(self.hashes, hashes := words.hashes()), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        for own, mark in zip(self._marks(words), self.marks):
            same &= own == mark[at]
        return same, self.order[at]


def _lists(rows: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """List columns of ``n`` rows from values and the row of each, rows ascending."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in values]


def frequencies(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Each text with at least one term: doc_id, ``n`` (all its terms, with repeats), and ``t``, ``tf``: how often it has each
    of the given terms, by number."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField(
        "t", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for batch in batches:
            for at, to, data, bounds in pieces(batch["text"]):
                words = Words(data, bounds, SEPARATORS)
                n = words.counts()
                rows = np.repeat(np.arange(to - at), n)
                same, term = known.found(words)
                key, tf = np.unique(rows[same] * len(terms) + term[same], return_counts=True)
                t, tf = _lists(key // len(terms), to - at, (key % len(terms)).astype(np.int32), tf.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, to - at), pa.array(n.astype(np.int64)), t, tf],
                    ["doc_id", "n", "t", "tf"]).filter(pa.array(n > 0))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def weighed(freq: DataFrame, weight: np.ndarray, total: int, length: int) -> DataFrame:
    """Documents that have a term of weight: doc_id, ``t``, ``impact``, and their strongest term and the next."""
    schema = T.StructType([freq.schema["doc_id"], freq.schema["t"], T.StructField("impact", T.ArrayType(T.LongType())),
                           T.StructField("lead", T.IntegerType()), T.StructField("next", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy()
            rows = np.repeat(np.arange(len(n)), batch["t"].value_lengths().to_numpy())
            t, tf = batch["t"].flatten().to_numpy(), batch["tf"].flatten().to_numpy()
            m = (100 - SHARE + SHARE * n * total // length)[rows]
            impact = SCALE * tf // (FREQUENCY * tf + LENGTH * m)
            strong = np.lexsort((t, -impact * weight[t], rows))
            first = np.searchsorted(rows, np.arange(len(n)))
            some = np.flatnonzero(np.diff(np.append(first, len(rows))))
            lead, second = np.full((2, len(n)), -1, np.int32)
            lead[some] = t[strong[first[some]]]
            more = some[np.diff(np.append(first, len(rows)))[some] > 1]
            second[more] = t[strong[first[more] + 1]]
            t, impact = _lists(rows, len(n), t, impact)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], t, impact, pa.array(lead), pa.array(second)], [
                "doc_id", "t", "impact", "lead", "next"]).filter(pa.array(lead >= 0))
    return freq.select("doc_id", "n", "t", "tf").mapInArrow(run, schema)


class Tree:
    """Levels of coordinate maxima, batches first; every ``FAN`` nodes are one node of the next level."""

    def __init__(self, batches: np.ndarray) -> None:
        self.levels = [batches]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def under(self, level: int, node: int) -> tuple[int, range]:
        """The nodes below one; a batch is below itself."""
        if level == 0:
            return 0, range(node, node + 1)
        return level - 1, range(node * FAN, min(node * FAN + FAN, len(self.levels[level - 1])))


class Items:
    """A block of items in the order of their strongest terms, as a tree over their weights."""

    def __init__(self, counts: list[Counter], number: dict[str, int], weight: np.ndarray) -> None:
        own = [(np.array([number[t] for t in c], np.int64), np.array([*c.values()], np.int64)) for c in counts]
        own = [(t, c * weight[t]) for t, c in own]
        self.order = sorted(range(len(own)), key=lambda i: int(own[i][0][own[i][1].argmax()]))
        self.own = [own[i] for i in self.order]
        batches = np.zeros((-(-len(own) // ITEM_LEAF), len(weight)))
        for i, (t, w) in enumerate(self.own):
            batches[i // ITEM_LEAF, t] = np.maximum(batches[i // ITEM_LEAF, t], w)
        self.tree = Tree(batches)
        self.columns, self.weights = [], []
        for at in range(0, len(own), ITEM_LEAF):
            part = self.own[at:at + ITEM_LEAF]
            columns = np.unique(np.concatenate([t for t, _ in part]))
            weights = np.zeros((len(columns), len(part)), np.int64)
            for j, (t, w) in enumerate(part):
                weights[np.searchsorted(columns, t), j] = w
            self.columns.append(columns)
            self.weights.append(weights)


class Search:
    """The k best documents of each item so far; ``least``: scores known to be reached by k documents."""

    def __init__(self, items: Items, k: int, least: np.ndarray) -> None:
        self.items, self.k, self.least = items, k, np.maximum(least, 1)
        self.best: list[list[tuple]] = [[] for _ in items.own]
        self.batches = self.opened = 0

    def weakest(self, level: int, node: int) -> int:
        size = ITEM_LEAF * FAN ** level
        return int(self.least[node * size:(node + 1) * size].min())

    def chunk(self, ids: list, first: np.ndarray, t: np.ndarray, impact: np.ndarray, width: int) -> None:
        """Documents with terms ``t[first[i]:first[i + 1]]``: all pairs of nodes that may matter, best bound first."""
        leaf = np.repeat(np.arange(len(ids)), np.diff(first)) // DOC_LEAF
        maxima = np.zeros((-(-len(ids) // DOC_LEAF), width))
        np.maximum.at(maxima, (leaf, t), impact)
        docs, items = Tree(maxima), self.items.tree
        self.batches += len(maxima) * len(items.levels[0])
        queue = [(-math.inf, len(items.levels) - 1, 0, len(docs.levels) - 1, 0)]
        while queue:
            bound, a, i, b, d = heapq.heappop(queue)
            if -bound < self.weakest(a, i):
                continue
            if a == b == 0 and bound != -math.inf:
                self.opened += 1
                self._scored(i, d, ids, first, t, impact)
                continue
            a, under_i = items.under(a, i)
            b, under_d = docs.under(b, d)
            # A little more than the bound, for what sums of doubles may lose.
            bounds = items.levels[a][under_i.start:under_i.stop] @ docs.levels[b][under_d.start:under_d.stop].T * (1 + 1e-9)
            for x, i in enumerate(under_i):
                weakest = self.weakest(a, i)
                for y, d in enumerate(under_d):
                    if bounds[x, y] >= weakest:
                        heapq.heappush(queue, (-bounds[x, y], a, i, b, d))

    def _scored(self, i: int, d: int, ids: list, first: np.ndarray, t: np.ndarray, impact: np.ndarray) -> None:
        """Exact scores of a batch of documents for a batch of items."""
        columns, weights = self.items.columns[i], self.items.weights[i]
        at, to = d * DOC_LEAF, min(d * DOC_LEAF + DOC_LEAF, len(ids))
        own = slice(first[at], first[to])
        place = np.minimum(np.searchsorted(columns, t[own]), len(columns) - 1)
        hit = columns[place] == t[own]
        dense = np.zeros((to - at, len(columns)), np.int64)
        dense[np.repeat(np.arange(to - at), np.diff(first[at:to + 1]))[hit], place[hit]] = impact[own][hit]
        scores = dense @ weights
        for x, j in zip(*np.nonzero(scores >= self.least[i * ITEM_LEAF:i * ITEM_LEAF + weights.shape[1]])):
            item, score, doc = i * ITEM_LEAF + j, int(scores[x, j]), ids[at + x]
            # Worst first: low scores, then absent and large ids.
            rank = (score, doc is not None, -doc if doc is not None else 0)
            best = self.best[item]
            if len(best) < self.k:
                heapq.heappush(best, rank)
            elif rank > best[0]:
                heapq.heapreplace(best, rank)
            if len(best) == self.k:
                self.least[item] = max(self.least[item], best[0][0])


def _searched(docs: DataFrame, items: Items, k: int, least: np.ndarray, width: int) -> DataFrame:
    """Every task's best: ``at`` (the item's place in its block), doc_id, score."""
    size = DOC_LEAF * max(1, NODE_CELLS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, k, least.copy())
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            first = np.concatenate(([0], np.cumsum(batch["t"].value_lengths().to_numpy())))
            t, impact = batch["t"].flatten().to_numpy(), batch["impact"].flatten().to_numpy()
            for at in range(0, len(ids), size):
                to = min(at + size, len(ids))
                own = slice(first[at], first[to])
                search.chunk(ids[at:to], first[at:to + 1] - first[at], t[own], impact[own], width)
        rows = [(items.order[i], -doc if there else None, score) for i, best in enumerate(search.best)
                for score, there, doc in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)],
                                         ["at", "doc_id", "score"])
    return docs.select("doc_id", "t", "impact").mapInArrow(run, "at long, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(docs: DataFrame, items: DataFrame, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` best of docs (doc_id long, text) for each of items (item_id, text): item_id, rank, doc_id, score."""
    spark, out = docs.sparkSession, []
    id_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField(
        "doc_id", T.LongType()), T.StructField("score", T.LongType())])
    for block in item_blocks(items):
        terms = sorted(set().union(*(c for _, c in block)))
        freq = stage(frequencies(docs, terms), "term-frequencies")
        total, length = freq.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if total == 0:
            break
        df = np.zeros(len(terms), np.int64)
        for t, count in freq.select(F.explode("t").alias("t")).groupBy("t").count().collect():
            df[t] = count
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        ranges = stage(weighed(freq, weight, total, length).repartitionByRange("lead", "next", "doc_id").sortWithinPartitions(
            "lead", "next", "doc_id"), "term-impacts")
        tree = Items([c for _, c in block], {t: i for i, t in enumerate(terms)}, weight)
        least = np.zeros(len(block), np.int64)
        some = ranges.filter(F.pmod(F.xxhash64("doc_id", "t"), F.lit(max(1, total // sample))) == 0)
        place = {i: x for x, i in enumerate(tree.order)}
        for at, score in _best(_searched(some, tree, k, least, len(terms)), k).filter(F.col("rank") == k).select(
                "at", "score").collect():
            least[place[at]] = score
        found = stage(_best(_searched(ranges, tree, k, least, len(terms)), k), "best")
        ids = spark.createDataFrame([(at, item_id) for at, (item_id, _) in enumerate(block)],
                                    T.StructType([T.StructField("at", T.LongType()), T.StructField("item_id", id_type)]))
        out.append(found.join(ids, "at").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], schema)
