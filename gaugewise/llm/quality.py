"""Operator 7, quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled good; unlabelled ones are web documents as they come. With the class prior
the risk of the negatives is what the unlabelled leave after the positives' share, and it is kept from going below
zero: when it does, the step undoes that part instead (non-negative unbiased risk). Documents labelled bad are not
trained on; they only enter the estimated class prior, the share of good among the labels that may be learned from.

The model is linear over a few shape figures of a text: shares of kinds of characters, how often words and word
sequences repeat, word lengths, size. It is fitted on all unlabelled rows and all trusted positives: their figures are
written once, and each Newton step is one pass that sums risk, gradient and curvature in the tasks. The driver sees
those sums only, a few hundred numbers, however often a document is repeated.

Labels are learned only from rows where crc32 of doc_id modulo 3 is not 1; so are unlabelled rows. Neither label, lang,
source nor doc_id is an input.

Cases: null and empty texts have figures of 0 and a score like others; repeated rows are scored each; null labels and
null doc_ids are not learned from; a table without positives or without unlabelled rows gives the prior as every score;
an empty table gives no rows; only doc_id and text are read, so other columns cannot clash. Repeated labels of one
document count as the best of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugewise.llm.common import SPACES, Words, pieces, stage
from gaugewise.session import discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 40
#: The ridge of a fit from few trusted positives is this over their number; 1e-4 at least.
SHRINK = 2.0
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:",
          b"!", b"?", b"|", b"*#$%&@^~_+=<>\\/", b"'\"()[]{}-`", bytes(range(128, 256)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shape(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of figures per text."""
    kind = np.full(256, len(_KINDS), np.int32)
    for i, members in enumerate(_KINDS):
        kind[list(members)] = i
    n, width = len(bounds) - 1, len(_KINDS) + 1
    size = np.diff(bounds)
    kinds = np.bincount(kind[data] + np.repeat(np.arange(n, dtype=np.int32) * width, size), minlength=n * width)
    shares = kinds.reshape(n, width) / np.maximum(size, 1)[:, None]
    words = Words(data, bounds, SPACES, lower=False)
    h, first, count = words.hashes(), words.first, words.counts()
    again = np.concatenate(([0], np.cumsum(np.concatenate(([False], h[1:] == h[:-1]))))) if len(h) else np.zeros(1)
    triples = h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(17) + h[2:] if len(h) > 2 else h[:0]
    distinct, sequences = np.ones(n), np.ones(n)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b > a:
            distinct[i] = len(np.unique(h[a:b])) / (b - a)
        if b > a + 2:
            sequences[i] = len(np.unique(triples[a:b - 2])) / (b - 2 - a)
    many = np.maximum(count, 1)
    repeats = (again[first[1:]] - again[np.minimum(first[:-1] + 1, first[1:])]) / many
    length = (np.concatenate(([0], np.cumsum(words.end - words.start)))[first[1:]]
              - np.concatenate(([0], np.cumsum(words.end - words.start)))[first[:-1]]) / many
    return np.column_stack([np.sqrt(shares), np.sqrt(np.maximum(repeats, 0)), np.log(distinct), sequences,
                            np.log1p(count), np.log1p(length), size == 0])


def _shaped(docs: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(1)):
                x = shape(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(
                    list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _summed(figures: DataFrame, of) -> np.ndarray:
    """The sum over all rows of the vector that ``of`` makes of a batch (``x``, ``positive``). A task sums its own rows
    before anything is shuffled, and only as many numbers as the vector has reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
            if len(x):
                total = total + of(x, batch.column(1).to_numpy(zero_copy_only=False))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = figures.select("x", "positive").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sorted(rows.collect())])


def fitted(figures: DataFrame, prior: float, steps: int = STEPS, decay: float = 1e-4, shrink: float = 0.0) -> Model | None:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss, over all rows of ``figures``
    (``x``, and ``positive`` for the trusted ones; every row is unlabelled too). None without positives.

    With that loss R_p(+) - R_p(-) is linear, so the risk is convex where the maximum is not at zero, and Newton steps
    need one pass each. A step that takes the negatives' risk below zero, or the whole risk up, is halved back. The ridge
    is ``decay``, or ``shrink`` over the number of trusted positives if that is more."""
    if figures.isEmpty():
        return None
    moments = _summed(figures, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]))
    (n, positives), (first, second) = moments[:2], moments[2:].reshape(2, -1) / moments[0]
    if not positives:
        return None
    mean, scale = first, np.sqrt(np.maximum(second - first ** 2, 0)) + 1e-6
    d = len(mean) + 1

    def at(w: np.ndarray):
        def of(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
            g = z @ w
            s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
            bad = np.logaddexp(0, g)
            return np.concatenate([[bad.sum(), bad[p].sum(), np.logaddexp(0, -g[p]).sum()], s @ z, z[p].sum(0), (
                (s * (1 - s))[:, None] * z).T.dot(z).ravel()])
        return of

    ridge = np.append(np.full(d - 1, max(decay, shrink / positives)), 0.0)
    w, before, least = np.zeros(d), None, np.inf
    for _ in range(steps):
        sums = _summed(figures, at(w))
        negative = sums[0] / n - prior * sums[1] / positives
        risk = prior * sums[2] / positives + max(0.0, negative) + ridge @ (w * w) / 2
        if before is not None and (negative < 0 or risk > least + 1e-12):
            w = (w + before) / 2
        else:
            least, before = risk, w
            gradient = sums[3:3 + d] / n - prior * sums[3 + d:3 + 2 * d] / positives + ridge * w
            curve = sums[3 + 2 * d:].reshape(d, d) / n + np.diag(ridge + 1e-6)
            step = np.linalg.solve(curve, gradient)
            w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(w - before).max() < 1e-5:
            break
    # Sums come in any order; their last digits are not kept.
    w = np.round(before, 9)
    return Model(mean, scale, w[:-1], float(w[-1]))


def trained(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Fitted on all documents that may be learned from; on at most ``sample`` trusted positives, if given."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(
        F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, all_ = known.agg(F.sum(F.col("quality").cast("long")), F.count("*")).first()
    prior = ((good or 0) + 1) / (all_ + 2)
    positives = known.filter("quality = 1").select(F.col("doc_id").alias("id"))
    if sample is not None:
        positives = positives.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample)
    web = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Texts become figures before they meet the labels, so no text is moved.
    figures = stage(_shaped(web).join(positives, F.col("doc_id") == F.col("id"), "left").select(
        "x", F.col("id").isNotNull().alias("positive")), "figures")
    model = fitted(figures, prior, shrink=SHRINK)
    discard(figures)
    if model is None:
        size = shape(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
        return Model(np.zeros(size), np.ones(size), np.zeros(size), float(np.log(prior / (1 - prior))))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (as struct ``doc``) with ``score``, the estimated chance that the text is good."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field("text")
            score = [model.score(shape(data, bounds)) for _, _, data, bounds in pieces(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score or [np.zeros(0)]))],
                                             ["doc", "score"])

    return rows.mapInArrow(run, schema)
