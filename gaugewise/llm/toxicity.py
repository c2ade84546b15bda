"""Operator 3, toxicity: cumulative-link ordinal regression over sparse text features.

Features are the words of a text and their first four and five bytes (stems), hashed. Over all labelled documents that
may be learned from, each feature's documents are counted by label; the ``features`` most telling ones remain.
Severity has grades 0 to 3: a document labelled clean is 0; one labelled toxic is graded by how many telling stems or
words it has (1; 2 or 3; more). One weight vector is shared by the ordered thresholds, P(grade > k) =
sigmoid(w x - t_k) with t_0 < t_1 < t_2, and the expected severity is the sum of the three.

Labels are learned only from rows where crc32 of doc_id modulo 3 is not 1. Feature counts cover all of them; the
regression is fitted on the driver from at most ``sample`` of them, the first by a hash of doc_id.

Cases: null and empty texts have no features, hence the lowest score; repeated rows are scored each; null labels and
null doc_ids are not learned from; without toxic labels every score is near 0; an empty table gives no rows; only doc_id
and text are read, so other columns cannot clash. Repeated labels of one document count as the worst.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from gaugewise.llm.common import NOT_WORD, Words, pieces, stage
from gaugewise.llm.quality import held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 22
FEATURES = 4096
SAMPLE = 50_000
HEADS = (None, 4, 5)
GRADES = 3
#: Features are looked at if they stand in this share of the toxic documents, and in three.
SUPPORT = 0.002


def hashed(words: Words) -> np.ndarray:
    """Per word its features: rows of ``len(HEADS)`` bucket numbers."""
    return np.column_stack([(words.hashes(head) + np.uint64(i)) >> np.uint64(64 - BITS)
                            for i, head in enumerate(HEADS)]).astype(np.int64)


def present(words: Words) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    x = hashed(words)
    for a, b in zip(words.first[:-1], words.first[1:]):
        yield np.unique(x[a:b])


@dataclass
class Model:
    features: np.ndarray  # sorted bucket numbers
    weights: np.ndarray
    thresholds: np.ndarray

    def matrix(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of the words' features the known ones: row and feature number, each pair once."""
        x = hashed(words)
        if not len(self.features) or not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, x), len(self.features) - 1)
        word, which = np.nonzero(self.features[at] == x)
        row = np.searchsorted(words.first, word, "right") - 1
        pair = np.unique(row * len(self.features) + at[word, which])
        return pair // len(self.features), pair % len(self.features)

    def chances(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2 of n texts."""
        value = np.bincount(rows, self.weights[columns], n)
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds, -40, 40)))


def fitted(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 400,
           rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the mean cross-entropy of the three cumulative links, by Adam.
    The first threshold and the logarithms of the steps between them are free, so they stay ordered."""
    n = len(grades)
    above = grades[:, None] > np.arange(GRADES)
    theta = np.concatenate([np.zeros(n_features), [2.0], np.zeros(GRADES - 1)])
    m, v = 0.0, 0.0
    for step in range(1, steps + 1):
        gaps = np.exp(theta[n_features + 1:])
        limits = theta[n_features] + np.concatenate(([0], np.cumsum(gaps)))
        value = np.bincount(rows, theta[columns], n)
        error = (1 / (1 + np.exp(-np.clip(value[:, None] - limits, -40, 40))) - above) / n
        by_limit = -error.sum(0)
        gradient = np.concatenate([
            np.bincount(columns, error.sum(1)[rows], n_features) + decay * theta[:n_features], [by_limit.sum()],
            gaps * np.cumsum(by_limit[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate(([0], np.cumsum(np.exp(theta[n_features + 1:]))))


def document_counts(rows: DataFrame, among: np.ndarray | None = None) -> dict[int, int]:
    """In how many documents (doc_id, text) each feature stands, of all features or of those marked in ``among``.
    A task's documents are summed up before they are shuffled; at most 2**BITS numbers are collected."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                for x in present(Words(data, bounds, NOT_WORD)):
                    counts[x] += 1
        at = np.flatnonzero(counts if among is None else np.where(among, counts, 0))
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["f", "n"])

    counts = rows.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    if among is None:
        counts = counts.filter(F.col("n") >= 3)
    found = counts.toArrow()
    return dict(zip(found["f"].to_pylist(), found["n"].to_pylist()))


def trained(docs: DataFrame, labels: DataFrame, n_features: int = FEATURES, sample: int = SAMPLE) -> Model:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(
        F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    # Labels grow with the documents, so the join is a merge at any size; its rows are written and read three times.
    learn = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    rows = stage(learn.join(known.hint("merge"), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    c, t = (x or 0 for x in known.agg(F.sum((F.col("toxic") <= 0).cast("long")), F.sum((F.col("toxic") > 0).cast(
        "long"))).first())
    # Only what stands in some toxic documents (SUPPORT of them at least) is worth counting among the others.
    toxic = {f: n for f, n in document_counts(rows.filter("toxic > 0")).items() if n >= SUPPORT * t}
    mark = np.zeros(1 << BITS, bool)
    mark[list(toxic)] = True
    clean = document_counts(rows.filter("toxic <= 0"), mark) if toxic else {}
    odds = {f: np.log((n + 0.5) / (t + 1)) - np.log((clean.get(f, 0) + 0.5) / (c + 1)) for f, n in toxic.items()}
    top = sorted((f for f in odds if odds[f] > 2), key=lambda f: (-odds[f] * toxic[f], f))[:n_features]
    model = Model(np.array(sorted(top), np.int64), np.zeros(len(top)), np.array([40.0, 41.0, 42.0]))
    if not top:
        return model
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(1)):
                r, f = model.matrix(Words(data, bounds, NOT_WORD))
                ends = np.searchsorted(r, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(f))], ["toxic", "f"])

    # At most `sample` rows, and of each only which of the chosen features it has.
    examples = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(listed, "toxic long, f array<long>").collect()
    hits = np.array([len(r["f"]) for r in examples])
    toxic = np.array([r["toxic"] > 0 for r in examples])
    # A word and its stems are up to len(HEADS) features.
    grades = np.where(toxic, np.digitize(hits / len(HEADS), [1.5, 3.5]) + 1, 0)
    columns = np.concatenate([np.zeros(0, np.int64), *(np.array(r["f"], np.int64) for r in examples)])
    model.weights, model.thresholds = fitted(np.repeat(np.arange(len(hits)), hits), columns, grades, len(top))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, ``score`` (the chance of any toxicity), ``severity`` (expected grade), ``grade`` (likeliest)."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("score", T.DoubleType()), ("severity", T.DoubleType()), ("grade", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(1)):
                p = model.chances(*model.matrix(Words(data, bounds, NOT_WORD)), b - a)
                each = np.diff(np.column_stack([np.zeros(b - a), 1 - p, np.ones(b - a)]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p[:, 0]), pa.array(
                    p.sum(1)), pa.array(each.argmax(1).astype(np.int32))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
