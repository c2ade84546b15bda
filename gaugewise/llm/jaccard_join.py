"""Operator 6, n-gram Jaccard join: universe-partition pigeonhole with exact verification.

A document is the set of its distinct word shingles, as 64-bit hashes. Sets of one size band are cut into the same
segments of the hash universe. Two sets that differ in at most H shingles, which the similarity and their sizes bound,
agree on a whole segment if there are more than H segments to agree on. So each set posts one key per segment.

Allocation by cost: segments with fewer than ``floor`` shingles have the longest posting lists and are not posted
(threshold -1) as long as more than H others are left; those are compared for equality (threshold 0). A set that has
too few left posts one-deletion neighbourhoods (threshold 1) of half as many segments, empty ones included, which
covers all differences again. One of the two rules holds for any two linked sets, so no link is lost.

Equal sets are one class from the start, and a task posts a class once, so copies cost nothing. Within a key each class
is first compared with one centre only, the class with most company over all its keys; classes that are in one
component by then need no further comparison. What is left of a key's classes is compared with each other: up to
``SMALL`` of them as pairs (so pairs grow with rows), more of them in blocks, where a task takes two blocks, finds all
links by matrix products and returns only what joins components. Links are verified on whole sets, which are made again
and shipped only for pairs that may be linked by their parities: sets that differ in d elements differ in at most d of them.
So the blocks of a large key first compare parities, and only sets that have a possible link there are compared whole.
Keys are dealt, and pairs verified, in ``PASSES`` or more parts one after the other, so that their shuffle files take less
disk: a part ships no more pairs than there are sets in lists.

Cases: null and empty texts have no shingles, size 0, and are linked with nothing; fewer words than a shingle are one
shingle; repeated rows are kept and linked; null doc_ids are kept and never a component's id unless it has no other;
only doc_id and text are read, so other columns cannot clash; an empty table gives no rows.
Hashes have 64 bits; two different sets with one hash (about n*n / 2**65 for n sets) would count as equal.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from gaugewise.llm.common import SPACES, Words, in_passes, mixed, pieces, stage
from gaugewise.llm.graph import components
from gaugewise.session import discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
SIMILARITY = (85, 100)
#: Bits of the map that tells which documents' sets a verification may need; wrong hits only cost time.
MAP_BITS = 1 << 24
#: Of how many groups of elements a set's parities tell whether it has an odd number.
PARITIES = 1_024
SMALL = 64
BLOCK = 1_024
PASSES = 4


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    step = np.uint64(0xD6E8FEB86659FD93)
    w = words.hashes()
    grams = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for i in range(width):
        grams = grams * step + w[i:len(w) - width + 1 + i] if len(grams) else grams
    grams = mixed(grams)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            yield np.unique(grams[a:b - width + 1])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in w[a:b]:
                    whole = whole * step + x
            yield mixed(np.array([whole]))
        else:
            yield np.empty(0, np.uint64)


class Posting:
    """Keys of a set. Two sets with a Jaccard similarity of ``most[0] / most[1]`` or more share one."""

    def __init__(self, most: tuple[int, int]) -> None:
        self.num, self.den = most
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 3 // 2)))
        self.bounds = np.array(bounds, np.int64)

    def differences(self, sizes: int) -> int:
        """How many elements two similar sets of together ``sizes`` elements can differ in."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def band(self, k: int) -> tuple[int, int, int, int]:
        """Of a size band: its largest size, differences, segments, and smallest segment that is posted."""
        top = int(self.bounds[k + 1]) - 1
        most = self.differences(2 * top)
        segments = most + 1 if most == 0 else -(-23 * (most + 1) // 20)
        floor = 2 if int(self.bounds[k]) * self.num >= 3 * segments * self.den else 1
        return top, most, segments, floor

    def keys(self, elements: np.ndarray) -> np.ndarray:
        n = len(elements)
        if n == 0:
            return elements
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        bands = [own]
        if n * self.den >= self.num * int(self.bounds[own + 1]):
            bands.append(own + 1)
        return np.concatenate([self._band_keys(elements, k) for k in bands])

    def _band_keys(self, elements: np.ndarray, k: int) -> np.ndarray:
        top, most, segments, floor = self.band(k)
        n = len(elements)
        differ = self.differences(n + min(top, n * self.den // self.num))
        segment = ((elements >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        count = np.diff(np.concatenate((at, [n])))
        own = mixed(elements + np.uint64(k))
        total = np.add.reduceat(own, at)
        tag = segment[at] + np.uint64(k << 40)
        posted = count >= floor
        keys = mixed(mixed(total + count.astype(np.uint64)) + tag)[posted]
        if len(keys) > differ:
            return keys
        # Too few segments are left: allow one difference in each of the first ones.
        near = np.arange((most + 2) // 2, dtype=np.uint64)
        sums = np.zeros(segments, np.uint64)
        sums[segment[at]] = total
        covered = segment < len(near)
        deleted = sums[segment[covered]] - own[covered]
        mark = np.uint64((k << 40) + (1 << 39))
        return np.concatenate((keys, mixed(mixed(sums[near]) + near + mark), mixed(
            mixed(deleted) + segment[covered] + mark)))


def parities(elements: np.ndarray) -> np.ndarray:
    """``PARITIES`` bits, as longs: whether an odd number of elements falls into a group."""
    groups = (elements % np.uint64(PARITIES)).astype(np.int64)
    return np.packbits(np.bincount(groups, minlength=PARITIES).astype(np.uint8) & 1).view(np.int64)


def posted(docs: DataFrame, width: int, most: tuple[int, int]) -> DataFrame:
    """Per row: doc_id, text_hash, n, set (hash of the whole set), its parities, and its keys, once per set and task."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField(
        "set", T.LongType()), T.StructField("odd", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posting, seen = Posting(most), set()
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column(2)):
                n, ids, odd, keys = [], [], [], []
                for elements in shingle_sets(Words(data, bounds, SPACES), width):
                    n.append(len(elements))
                    ids.append(int(mixed(elements ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)))
                    odd.append(parities(elements))
                    keys.append(posting.keys(elements) if ids[-1] not in seen else elements[:0])
                    seen.add(ids[-1])
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()),
                    pa.array(ids, pa.int64()), pa.array(odd, pa.list_(pa.int64())), lists], schema.names)

    return rows.mapInArrow(run, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``set`` and ``elements`` of (at least) the wanted documents (``doc_id``, ``text_hash``)."""
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(MAP_BITS))
    bits = wanted.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    known = np.zeros(MAP_BITS // 8, np.uint8)
    for row in bits.collect():  # at most MAP_BITS / 8 bytes in all
        at = (row["b"] - 1) * 4096
        known[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)[:len(known) - at]
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "doc_id", "text").select(bit.alias("bit"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for _, _, data, bounds in pieces(batch.column(1).take(pa.array(hit))):
                sets = list(shingle_sets(Words(data, bounds, SPACES), width))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                ids = [int(mixed(x ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["set", "elements"])

    return rows.mapInArrow(run, "set long, elements array<long>")


def alike(pairs: DataFrame, marks: DataFrame, most: tuple[int, int]) -> DataFrame:
    """The pairs (``u``, ``v``) without those whose ``marks`` (``set``, ``n``, ``odd``) differ in more parities than
    similar sets of their sizes can in elements."""
    a, b = (marks.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    differ = F.aggregate(F.zip_with("odd_u", "odd_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter(differ.cast("long") * (most[0] + most[1]) <= (F.col("n_u") + F.col("n_v")) * (
        most[1] - most[0])).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, most: tuple[int, int]) -> DataFrame:
    """The pairs (``u``, ``v``) that are similar enough, by their whole sets."""
    left = pairs.join(sets.select(F.col("set").alias("u"), F.col("elements").alias("a")), "u")
    both = left.join(sets.select(F.col("set").alias("v"), F.col("elements").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b")).cast("long")
    union = F.size("a") + F.size("b") - F.col("common")
    return both.select("u", "v", "a", "b", common.alias("common")).filter(
        F.col("common") * most[1] >= union * most[0]).select("u", "v")


def joined(sets: list[np.ndarray], most: tuple[int, int]) -> np.ndarray:
    """For each set the first one that links lead to, comparing all of them with each other."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what only one set has is in no intersection
    place = np.cumsum(shared) - 1
    kept = shared[column]
    has = np.zeros((len(sets), int(shared.sum())), np.float32)
    has[np.repeat(np.arange(len(sets)), sizes)[kept], place[column[kept]]] = 1
    common = (has @ has.T).astype(np.int64)
    links = common * most[1] >= (sizes[:, None] + sizes - common) * most[0]
    np.fill_diagonal(links, True)
    root = np.arange(len(sets))
    while True:
        least = np.where(links, root, len(sets)).min(1)
        if (least == root).all():
            return root
        root = least


def in_blocks(rest: DataFrame, *columns: str) -> DataFrame:
    """Rows of large keys, as often as their key has blocks: any two of a key meet in one (``key``, ``lo``, ``hi``)."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("u"), blocks).cast("int")
    rows = rest.select("key", "u", *columns, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "u",
                       *columns).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "u")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first three columns as one table for each value of these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(3)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        keys = [batch.column(i).to_numpy() for i in range(3)]
        at = [0, *np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, batch.num_rows]
        for a, b in zip(at[:-1], at[1:]):
            if a:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def may_link(odd: np.ndarray, n: np.ndarray, root: np.ndarray, most: tuple[int, int], step: int = 64) -> np.ndarray:
    """Which sets have another one of a different root that differs from them in no more parities than similar sets of their
    sizes can in elements."""
    order = np.argsort(n, kind="stable")
    odd, size, root = odd[order], n[order], root[order]
    hit = np.zeros(len(n), bool)
    for a in range(0, len(n), step):
        b = min(a + step, len(n))
        # Only sets of similar sizes, from the first of these on.
        end = int(np.searchsorted(size, size[b - 1] * most[1] // most[0], "right"))
        differ = np.bitwise_count(odd[a:b, None] ^ odd[None, a:end]).sum(2, dtype=np.int64)
        near = (differ * (most[0] + most[1]) <= (size[a:b, None] + size[None, a:end]) * (most[1] - most[0])) & (
            root[a:b, None] != root[None, a:end])
        hit[a:b] |= near.any(1)
        hit[a:end] |= near.any(0)
    out = np.zeros(len(n), bool)
    out[order] = hit
    return out


def hopeful(large: DataFrame, marks: DataFrame, most: tuple[int, int]) -> DataFrame:
    """The rows of large keys that a set of another root in the key may be linked with, by their parities."""
    rows = in_blocks(large.join(marks.select(F.col("set").alias("u"), "odd"), "u"), "n", "root", "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches):
            n, root = (group[c].to_numpy() for c in ("n", "root"))
            lists = group["odd"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            hit = may_link(lists.flatten().to_numpy().view(np.uint64).reshape(len(n), -1), n, root, most)
            yield pa.RecordBatch.from_arrays([pa.array(group[c].to_numpy()[hit]) for c in ("key", "u")], ["key", "u"])

    return large.join(rows.mapInArrow(run, "key long, u long").distinct(), ["key", "u"], "left_semi")


def linked_in_blocks(rest: DataFrame, sets: DataFrame, most: tuple[int, int]) -> DataFrame:
    """Links (``u``, ``v``) that join the classes of large keys as comparing all of a key's classes would."""
    rows = in_blocks(rest.join(sets, rest["u"] == sets["set"]), "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(u: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            root = joined(found, most) if found else np.zeros(0, np.int64)
            u_ = np.array(u, np.int64)
            other = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(u_[other]), pa.array(u_[root[other]])], ["u", "v"])

        now, u, found = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            lists = batch.column(4)
            values, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            for i, (key, id_) in enumerate(zip(keys, batch.column(3).to_pylist())):
                if key != now:
                    yield links(u, found)
                    now, u, found = key, [], []
                u.append(id_)
                found.append(values[ends[i]:ends[i + 1]].copy())
        yield links(u, found)

    return rows.mapInArrow(compare, "u long, v long").distinct()


def linked(docs: DataFrame, width: int = SHINGLE, most: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set, root (the same within a component only), and component_id, the
    smallest doc_id reachable by links."""
    keyed = stage(posted(docs, width, most), "sets")
    key = Window.partitionBy("key")
    lists = keyed.filter(F.size("keys") > 0).select(F.explode("keys").alias("key"), F.col("set").alias("u"), "n")
    first, *more = [part.withColumn("lo", F.min("u").over(key)).withColumn("hi", F.max("u").over(key)).filter(
        "lo < hi").drop("lo", "hi").distinct() for part in in_passes(lists, PASSES, "key")]
    shared = stage(first, "lists", *more)
    rows = stage(keyed.drop("keys"), "rows")
    discard(keyed)
    company = shared.withColumn("c", F.count("*").over(key)).groupBy("u").agg(F.sum("c").alias("w"))
    lists = stage(shared.join(company, "u").withColumn("v", F.max(F.struct("w", "u")).over(key)["u"]).drop("w"), "stars")
    discard(shared)
    # One document of each set that is in a list: where it is needed whole, it is made again from that text.
    nodes = lists.select("u").distinct()
    marks = stage(rows.join(nodes, rows["set"] == nodes["u"], "left_semi").groupBy("set").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("d"), F.any_value("n").alias("n"), F.any_value("odd").alias("odd")),
        "marks")

    def whole(needed: DataFrame, name: str) -> DataFrame:
        needed = needed.distinct()
        wanted = marks.join(needed, marks["set"] == needed["u"], "left_semi").select("d.*")
        return stage(whole_sets(docs, wanted, width).groupBy("set").agg(F.any_value("elements").alias("elements")).join(
            needed, F.col("set") == F.col("u"), "left_semi"), name)

    def in_parts(pairs: DataFrame, sets: DataFrame) -> list[DataFrame]:
        passes = max(PASSES, -(-pairs.count() // max(1, marks.count())))
        return [verified(part, sets, most) for part in in_passes(pairs, passes, "u", "v")]

    ends = F.explode(F.array("u", "v")).alias("u")
    near = stage(alike(lists.filter("u <> v").select("u", "v").distinct(), marks, most), "near")
    sets = whole(near.select(ends), "whole")
    first, *more = in_parts(near, sets)
    first = stage(first, "first", *more)
    discard(near, sets)
    found = components(first)
    # Classes of a key that are not all in one component by now are compared with each other.
    rest = lists.join(found, lists["u"] == found["node"], "left").select(
        "key", "u", "n", F.coalesce("root", "u").alias("root"))
    rest = stage(rest.withColumn("lo", F.min("root").over(key)).withColumn("hi", F.max("root").over(key)).filter(
        "lo < hi").withColumn("c", F.count("*").over(key)).drop("lo", "hi"), "rest")
    discard(lists)
    a, b = rest.filter(F.col("c") <= SMALL).alias("a"), rest.filter(F.col("c") <= SMALL).alias("b")
    similar = (F.least("a.n", "b.n") * most[1] >= F.greatest("a.n", "b.n") * most[0])
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.u") > F.col("b.u")) & (
        F.col("a.root") != F.col("b.root")) & similar).select(F.col("a.u").alias("u"), F.col("b.u").alias("v"))
    near = stage(alike(pairs.distinct(), marks, most), "near-rest")
    large = stage(hopeful(rest.filter(F.col("c") > SMALL), marks, most), "hopeful")
    sets = whole(near.select(ends).unionAll(large.select("u")), "whole-rest")
    second, *more = in_parts(near, sets)
    third = linked_in_blocks(large, sets.select("set", "elements"), most)
    links = stage(first, "all-links", second, *more, third)
    discard(sets, rest, first, near, marks, large)
    roots = components(links)
    rows = rows.join(roots, rows["set"] == roots["node"], "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "set", F.coalesce("root", "set").alias("root"))
    # Written, so that the join below has nothing but rows on either side and a hot root can be split.
    ids = stage(rows.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    return rows.join(ids, "root", "left").select("doc_id", "text_hash", "n_shingles", "set", "root", F.when(
        F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int, most: tuple[int, int]) -> DataFrame:
    """The rows of docs without all but one document of each component; documents without words all stay."""
    rows = stage(linked(docs, width, most), "components")
    # By root: components may share a component_id, as doc_ids may be null or stand at several texts.
    kept = rows.filter("n_shingles > 0").groupBy("root", "doc_id", "text_hash").agg(
        F.count("*").alias("times")).groupBy("root").agg(
            F.min(F.struct("doc_id", "text_hash", "times")).alias("k")).select("k.*")
    empty = rows.filter("n_shingles = 0").select("doc_id", "text_hash").distinct()
    keep = stage(kept.unionAll(empty.withColumn("times", F.lit(1).cast("long"))), "kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "times")
    out = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("h")).join(
        keep, F.col("doc.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_hash")))
    repeated = keep.filter("times > 1").limit(1).count()
    if repeated:  # the same document stands there more than once
        once = out.filter("times > 1").groupBy("kept_id", "h").agg(F.any_value("doc").alias("doc"))
        return out.filter("times = 1").select("doc.*").unionAll(once.select("doc.*"))
    return out.select("doc.*")
