"""Operator 8, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand on a line of words in a seeded random order; the line may be walked up to ``most`` times.
A source's quota is the start of that walk, exactly its target in words, so the last document of a quota may be cut.
The walk is divided into blocks (a document belongs to the block where it starts). A tree over the output shards
splits the exact block quotas: each node draws, without replacement, how many blocks of every source go left. The
permuted blocks of a source then fill the shards' counts, disjointly, and each shard orders its pieces by a seeded hash.

Places on a line are two-level prefix sums: documents are dealt into buckets of a source by their random key, bucket
totals are summed, then places within buckets; a source with a third of all rows is many buckets. The tree sees one
row per source and node, never documents; documents meet their shard by an equi-join on the block. What no shard
takes is not in the mix.

Cases: null text has size 0; a null source is a source of its own, ordered last; a repeated row is drawn on its own;
null doc_ids are kept; all columns of the input ride along in one struct, so names cannot clash; an empty table or one
without words gives targets of 0. Ties of the random key are ordered by doc_id and size, so reruns agree.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gaugewise.llm.common import stage, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SHARD_WORDS = 8_000_000
BLOCK_WORDS = 65_536
BUCKET_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From one row per source (``source``, ``rows``, ``source_size``): its ``target`` in words and its number ``at``.
    No target is above ``most`` times its source; what is above goes to the others by weight, until none is."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("at", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", weight)
    # In order of how soon a source is full, the first that does not fill gives the level of all later ones.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "at")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(
        F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(rest))
    fits = F.col("source_size") * most >= F.col("level") * F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "at", "level"))).over(every)["level"]
    return s.withColumn("target", F.least(F.col("source_size") * most + F.lit(0.0), F.coalesce(
        level * F.col("weight"), F.col("source_size") * most + F.lit(0.0)))).drop("level", "weight")


def _split(levels: int, seed: int):
    """Split a node (an index among the nodes of its depth, with 2**height shards below) ``levels`` times."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        nodes = {(int(rows["node"].iloc[0]), int(rows["height"].iloc[0])): rows["n"].to_numpy(np.int64)}
        for _ in range(min(levels, int(rows["height"].iloc[0]))):
            halves = {}
            for (node, height), n in nodes.items():
                draw = np.random.Generator(np.random.PCG64([seed, height, node]))
                left = draw.multivariate_hypergeometric(n, int(n.sum()) // 2, method="marginals")
                halves[2 * node, height - 1], halves[2 * node + 1, height - 1] = left, n - left
            nodes = halves
        # A source that has no blocks below a node is no row there, so the rows never outnumber the blocks.
        return pd.concat([pd.DataFrame({"node": node, "height": height, "at": rows["at"].to_numpy(), "n": n})[n > 0]
                          for (node, height), n in nodes.items()])
    return run


def shard_quotas(quotas: DataFrame, shards: int, seed: int, levels: int = 2) -> DataFrame:
    """From ``at`` and ``n`` blocks of each source: per source the ``shards`` that get some, and the number ``ends`` of
    places where each one's share ends."""
    height = shards.bit_length() - 1
    if 1 << height != shards:
        raise ValueError("the number of shards is a power of two")
    nodes = quotas.filter("n > 0").select(F.lit(0).cast("long").alias("node"), F.lit(height).alias("height"), "at", "n")
    for _ in range(-(-height // levels)):
        nodes = nodes.groupBy("node").applyInPandas(_split(levels, seed), "node long, height int, at long, n long")
    so_far = Window.partitionBy("at").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    counts = nodes.withColumn("end", F.sum("n").over(so_far)).groupBy("at").agg(
        F.sort_array(F.collect_list(F.struct("end", "node"))).alias("c"))
    return counts.select("at", F.col("c.node").alias("shards"), F.col("c.end").alias("ends"))


def block_shards(sizes: DataFrame, shards: int, seed: str, group: int = BUCKET_ROWS) -> DataFrame:
    """From ``at``, ``source`` and ``n`` blocks of each source: the ``shard`` of each ``block`` (from 0). A source's
    blocks in a seeded random order fill its shards' counts. Places in that order are prefix sums over groups of about
    ``group`` blocks, so no task sees all blocks of a source."""
    ends = shard_quotas(sizes.select("at", "n"), shards, int.from_bytes(seed.encode()[:8], "big"))
    share = ends.select("at", "ends", F.posexplode("shards").alias("i", "shard")).select(
        "at", "shard", F.get("ends", F.col("i") - 1).alias("before"), F.get("ends", "i").alias("end"))
    places = share.select("at", "shard", F.explode(F.sequence(F.coalesce("before", F.lit(0).cast(
        "long")), F.col("end") - 1)).alias("rank"))
    step = F.lit(group).cast("long")
    blocks = sizes.filter("n > 0").select("at", "source", "n", F.explode(F.sequence(F.lit(0).cast(
        "long"), F.floor((F.col("n") - 1) / step))).alias("part"))
    blocks = blocks.select("at", "n", "source", F.explode(F.sequence(F.col("part") * step, F.least(
        F.col("n"), (F.col("part") + 1) * step) - 1)).alias("block"))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "source", "block")).withColumn(
        "part", F.pmod(F.shiftright("h", 20), F.ceil(F.col("n") / step)))
    base = blocks.groupBy("at", "part").agg(F.count("*").alias("rows")).withColumn("base", F.sum("rows").over(
        Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows"))
    within = F.row_number().over(Window.partitionBy("at", "part").orderBy("h", "block"))
    return blocks.withColumn("within", within).join(base, ["at", "part"]).select(
        "at", "block", (F.col("base") + F.col("within") - 1).alias("rank")).join(places, ["at", "rank"]).select(
            "at", "block", "shard")


def _walked(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
            bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Each row of docs with its source's number ``at`` and its ``walks``, and the table of ``block_shards``."""
    size = F.col("n_words") if "n_words" in docs.columns else words(text_or_empty())
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", size.alias("size"), F.md5(
        F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))
    sizes = targets(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")),
                    weights, share, most)
    sizes = sizes.withColumn("quota", F.round("target").cast("long"))
    sizes = stage(sizes.withColumn("n", F.ceil(F.col("quota") / F.lit(block_words)).cast("long")), "sources")
    total = sizes.agg(F.sum("quota")).first()[0] or 0
    shards = 1 << max(0, -(-total // shard_words) - 1).bit_length()
    blocks = stage(block_shards(sizes, shards, seed), "blocks")
    spread = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    rows = rows.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "bucket", F.floor(spread * F.ceil(F.col("rows") / bucket_rows)))
    totals = rows.groupBy("at", "bucket").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("at", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("at", "bucket").orderBy("key", "doc.doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["at", "bucket"])
    rows = rows.withColumn("place", F.col("place") + F.col("base"))

    def walk(i: int) -> Column:
        start = F.lit(i).cast("long") * F.col("source_size") + F.col("place")
        taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start))
        # What takes no words needs no block; negative numbers meet none and do not gather in one task.
        nowhere = -F.lit(1) - F.pmod(F.xxhash64("key", F.lit(i)), F.lit(1 << 20))
        return F.struct(F.lit(i).alias("walk"), taken.alias("words"), F.when(taken > 0, F.floor(
            start / F.lit(block_words))).otherwise(nowhere).alias("block"), F.md5(
                F.concat("key", F.lit(str(i)))).alias("order"))

    return rows.select("doc", "size", "source_size", "target", "at", F.array(*map(walk, range(most))).alias(
        "walks")), blocks


def drawn(docs: DataFrame, **options: object) -> DataFrame:
    """For each row of docs (``doc``, a struct; needs doc_id, source, and text or ``n_words``): ``size``,
    ``source_size``, ``target``, and ``pieces``: for each walk over it the words that a shard takes, the shard, the
    block and the order in the shard."""
    rows, blocks = _walked(docs, **options)
    most = options.get("most", MOST)
    for i in range(most):
        rows = rows.withColumn(f"block_{i}", F.col("walks")[i]["block"]).join(
            blocks.select("at", F.col("block").alias(f"block_{i}"), F.col("shard").alias(f"shard_{i}")),
            ["at", f"block_{i}"], "left")
    pieces = F.array(*(F.struct(*(F.col("walks")[i][c].alias(c) for c in ("walk", "words", "block")), F.col(
        f"shard_{i}").alias("shard"), F.col("walks")[i]["order"].alias("order")) for i in range(most)))
    return rows.select("doc", "size", "source_size", "target", F.filter(
        pieces, lambda p: p["shard"].isNotNull()).alias("pieces"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: a row of docs for each piece, its text cut where the quota ends, and ``shard``; rows lie in
    their shard's order within each partition. n_chars, if there, is that of the text."""
    rows, blocks = _walked(docs, **options)
    pieces = rows.select("doc", "size", "at", F.explode("walks").alias("p")).filter("p.words > 0").withColumn(
        "block", F.col("p.block")).join(blocks, ["at", "block"])
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)),
                               F.lit(1), F.col("p.words").cast("int")), "")
    pieces = pieces.withColumn("text", F.when(F.col("p.words") < F.col("size"), cut).otherwise(F.col("doc.text")))
    out = {c: F.col(f"doc.{c}") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("text").cast("long")
    return pieces.repartition("shard").sortWithinPartitions("shard", "p.order").select(
        *(column.alias(c) for c, column in out.items()), F.col("shard"))
