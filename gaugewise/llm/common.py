"""What several operators share: written stages, ids of rows, and words of many texts at once in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugewise.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lost executors cost no recomputation of what led here. ``more`` as in
    ``cut``."""
    return cut(df, f"llm-{name}", *more)


def in_passes(df: DataFrame, passes: int, *by: str) -> list[DataFrame]:
    """The rows in so many parts of about the same size; equal ``by`` are in one part."""
    part = F.pmod(F.xxhash64(F.lit("pass"), *by), F.lit(passes))
    return [df.filter(part == i) for i in range(passes)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else, as the word rules of the contracts want it."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, last row + 1, their UTF-8 bytes, and byte bounds of the rows.
    One longer text is a run of its own. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20) + 1
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of a run of texts. ``separators``: the byte values between words; ``lower``: A-Z count as a-z.
    ``first[i]:first[i + 1]`` are the words of text i; ``start`` and ``end`` are byte positions."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: bytes, lower: bool = True) -> None:
        change = np.arange(256, dtype=np.uint8)
        if lower:
            change[65:91] += 32
        self.data = change[data]
        split = np.zeros(256, bool)
        split[list(separators)] = True
        inside = ~split[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.concatenate(([False], inside[:-1]))
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate((inside[1:], [False]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, bounds)
        self._sums: np.ndarray | None = None

    def hashes(self, head: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``head`` bytes."""
        up, down = _powers(len(self.data))
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
                (self.data.astype(np.uint64) + np.uint64(1)) * up[:len(self.data)], dtype=np.uint64)))
        end = self.end if head is None else np.minimum(self.end, self.start + head)
        return mixed((self._sums[end] - self._sums[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


#: The separators of two word rules of the contracts.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
