"""Operator 2, packing: concatenate all documents and cut into fixed windows.

Two passes. The first tokenises once and writes the ids with each partition's running token count; the partition
totals become prefix sums, which give every document its place in one global token line. The second cuts the line
at multiples of the window: a document that crosses a boundary gives a boundary record for each window it touches.
Only the very last sequence is not full, so there is no padding elsewhere.

Ids are those of the `tokenizers` library without added special tokens; tiktoken's encoder over the same vocabulary
gives the same ids several times faster (a test compares them), so that one runs here. It gives up on white space of
about a million characters in a row; a text that has that is encoded by `tokenizers` itself.

Cases: null or empty text is the end mark alone; a repeated row is packed again; a null doc_id is kept; other columns
are not read, so their names cannot clash; an empty table gives no pieces. One document of any length is cut freely;
memory is bounded by one Arrow batch plus the longest document.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from gaugewise.llm.common import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODER: dict[str, object] = {}


def encoder(vocabulary: str, pattern: str, special: dict[str, int]):
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if vocabulary not in _ENCODER:
        import base64

        import tiktoken
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        _ENCODER[vocabulary] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks,
                                                 special_tokens=special)
    return _ENCODER[vocabulary]


def patient(whole: str):
    """The `tokenizers` encoder of a whole tokenizer file, loaded where a Python worker first needs it."""
    if whole not in _ENCODER:
        from tokenizers import Tokenizer
        _ENCODER[whole] = Tokenizer.from_file(whole)
    return _ENCODER[whole]


def tokenised(docs: DataFrame, vocabulary: str, pattern: str, special: dict[str, int], end_id: int,
              whole: str) -> DataFrame:
    """Token ids of each document with the end mark, the partition that made them, and the tokens before it there."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()),
                           T.StructField("before", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        fast = encoder(vocabulary, pattern, special)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                return patient(whole).encode(text, add_special_tokens=False).ids

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = [np.array([*encode(x or ""), end_id], "<u4")
                       for x in rows.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + np.cumsum(n) - n),
                    pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "before", "n", "ids"])
                before += int(n.sum())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed(docs: DataFrame, vocabulary: str, pattern: str, whole: str, special: dict[str, int] | None = None,
           window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document, with its place in a sequence and a checksum of its ids; schema ``PIECES``.
    ``vocabulary`` and ``whole`` are two files of one vocabulary: tiktoken's ranks and the `tokenizers` description."""
    tokens = stage(tokenised(docs, vocabulary, pattern, special or {}, end_id, whole), "tokens")
    # Two numbers per partition of the first pass, however many documents it had.
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()
    bases = np.zeros(totals[-1]["part"] + 2 if totals else 1, np.int64)
    bases[[r["part"] + 1 for r in totals]] = [r["total"] for r in totals]
    bases = np.cumsum(bases)
    schema = T._parse_datatype_string(PIECES)
    schema["doc_id"].dataType = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, before, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            place = bases[part] + before
            first, last = place // window, (place + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            within = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            sequence = first[row] + within
            start = np.maximum(sequence * window, place[row])
            stop = np.minimum((sequence + 1) * window, (place + n)[row])
            ids = batch.column(4)
            crc = np.array([zlib.crc32(memoryview(ids[int(r)].as_buffer())[4 * a:4 * b]) for r, a, b in zip(
                row, start - place[row], stop - place[row])], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (
                    start - place[row], stop - start, crc, n[row], sequence, start - sequence * window))],
                schema.names)

    return tokens.mapInArrow(cut, schema)
