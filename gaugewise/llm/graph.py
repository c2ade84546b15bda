"""Connected components by alternating large and small stars; every round is a written stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugewise.llm.common import stage
from gaugewise.session import discard


def components(links: DataFrame) -> DataFrame:
    """From links ``u``, ``v`` (longs): ``node`` and ``root``, the smallest node reachable, for each node of a link.

    Each round replaces links by links to the smallest neighbour; a hub's neighbours are combined by a minimum before
    they are shuffled, and no node's neighbours are ever gathered. Ends when a round changes no link."""
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
        "u > v").distinct(), "links")
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(
            F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        done, links = links, stage(small, "links")
        discard(done)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(
            F.expr("xxhash64(v, u)").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
