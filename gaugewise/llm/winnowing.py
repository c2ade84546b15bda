"""Operator 9, document fingerprints by winnowing; DataFrame functions only.

A text's k-grams of code points are hashed; of every window of w consecutive grams the smallest hash is chosen, the
rightmost of equal ones, and kept with its position. Two texts that share w + k - 1 code points in a row share a
chosen hash. A gram's hash and position are one long (hash in the upper bits, position subtracted), so the minimum of
longs is the rightmost minimum, and window minima need two passes over four values each instead of w per window.

The neighbour in doc_id order needs no global window: rows are dealt by doc_id ranges whose bounds are approximate
percentiles, each range also gets the first row of the next one, and ``lead`` works within a range. Texts are shuffled
once, fingerprints are made after that.

The edited text shares its first part with the document, and so do its grams: only windows that reach into the new
part are made anew, which is a quarter of the work.

Cases: null text is empty and has no grams, and two empty texts are alike (1.0), an empty and another one are not (0.0);
a text shorter than k is one gram, fewer grams than w are one window; repeated rows are kept, rows of equal doc_id are
ordered by text; null doc_ids come first; a single row is followed by itself; an empty table gives no rows. Only doc_id
and text are read, so other columns cannot clash. Rows of one doc_id stay in one range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gaugewise.llm.common import text_or_empty

K = 8
WINDOW = 16
RANGE_ROWS = 2_000
_LOW = (1 << 31) - 1


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is neither recomputed nor copied."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gram_hashes(text: Column, k: int = K) -> Column:
    """Per k-gram: its hash in the upper bits, minus its position. UTF-32 makes every code point four bytes."""
    def hashed(units: Column) -> Column:
        n = (F.length(units) / 4).cast("int")
        last = F.greatest(F.lit(0), n - k)
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            F.substring(units, i * 4 + 1, F.lit(4 * k))).bitwiseAND(F.lit(_LOW << 32 | 1 << 31)) - i)
        return F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.encode(text, "UTF-32"), hashed)


def window_minima(grams: Column, window: int = WINDOW) -> Column:
    """The smallest value of every window of ``window`` (a power of 4) grams; of all, if they are fewer."""
    def passes(values: Column, span: int) -> Column:
        if span == window:
            return F.slice(values, F.lit(1), F.greatest(F.lit(1), F.size(values) - window + 1))
        least = F.transform(values, lambda v, i: F.least(v, *(F.get(values, i + j * span) for j in (1, 2, 3))))
        return _bound(least, lambda x: passes(x, span * 4))

    return _bound(grams, lambda x: passes(x, 1))


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint: chosen grams of a text by position, as longs; see ``positions`` and ``hashes``."""
    return F.array_distinct(window_minima(gram_hashes(text, k), window))


def hashes(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda x: F.shiftright(x + F.lit(_LOW), 31)))


def positions(grams: Column) -> Column:
    return F.transform(grams, lambda x: F.shiftleft(F.shiftright(x + F.lit(_LOW), 31), 31) - x)


def alike(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def in_ranges(value: Column, bounds: list[int]) -> Column:
    """The number of sorted bounds at or below value; compares with about twice the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    group = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups)), lambda b: b <= value))
    inner = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group - 1)
    return F.when(group > 0, (group - 1) * step + F.size(F.filter(inner, lambda b: b <= value))).otherwise(0)


def with_next(docs: DataFrame, made: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, the ``made`` columns, and ``next_`` text and made columns of the next row by ascending doc_id;
    the first row follows the last."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    ids = docs.select("doc_id")
    parts = max(1, -(-ids.count() // range_rows))
    bounds = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias(
        "b")).first()["b"] if parts > 1 else None
    bucket = F.coalesce(in_ranges(F.col("doc_id"), sorted(set(bounds or []))), F.lit(0))
    # One row per range: its first doc_id, and the range before it, to which that row is sent as well.
    firsts = ids.groupBy(bucket.alias("b")).agg(F.min(F.struct(F.col("doc_id"))).alias("m"))
    order = Window.orderBy("b")
    firsts = firsts.select("m.doc_id", F.coalesce(F.lag("b").over(order), F.max("b").over(Window.partitionBy())).alias(
        "bucket"))
    firsts = F.broadcast(firsts) if parts < 1_000_000 else firsts
    heads = rows.join(firsts.withColumnRenamed("doc_id", "first_id"), F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select(bucket.alias("bucket"), F.lit(0).alias("head"), "doc_id", "text").unionAll(
        heads.select("bucket", F.lit(1), "doc_id", "text"))
    # Sorted here, so that the window below takes the order as it is, and made columns come after the shuffle.
    both = both.repartition("bucket").sortWithinPartitions("bucket", "head", "doc_id", "text")
    both = both.select("*", *(column.alias(name) for name, column in made.items()))
    after = Window.partitionBy("bucket").orderBy("head", "doc_id", "text")
    return both.select("head", "doc_id", "text", *made, *(
        F.lead(c).over(after).alias(f"next_{c}") for c in ("text", *made))).filter("head = 0").drop("head")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: doc_id, text, edited_text, ``grams`` and ``edited_grams`` (the fingerprints), near_edited, near_next."""
    rows = with_next(docs, {"grams": chosen(F.col("text"), k, window)}, range_rows)
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    kept = n - moved
    # Windows that begin before ``anew`` see only kept code points and have chosen what the document's own chose.
    anew = F.greatest(F.lit(0), kept - k - 2 * window + 3)
    rows = rows.select("doc_id", "text", "grams", "next_grams", anew.alias("anew"), F.concat(
        F.left("text", kept), F.left("next_text", moved)).alias("edited_text"))
    at = F.col("anew")
    tail = F.transform(chosen(F.substring("edited_text", at + 1, F.length("edited_text")), k, window), lambda x: x - at)
    head = F.filter("grams", lambda x: (at > 0) & (
        F.shiftleft(F.shiftright(x + F.lit(_LOW), 31), 31) - x < at + window - 1))
    rows = rows.withColumn("edited_grams", F.array_distinct(F.concat(head, tail)))
    own = hashes(F.col("grams"))

    def near(other: str) -> Column:
        return _bound(own, lambda a: _bound(hashes(F.col(other)), lambda b: alike(a, b)))

    return rows.select("doc_id", "text", "edited_text", "grams", "edited_grams",
                       near("edited_grams").alias("near_edited"), near("next_grams").alias("near_next"))


def digest(grams: Column) -> Column:
    return F.md5(F.array_join(grams.cast("array<string>"), ","))
