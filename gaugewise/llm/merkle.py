"""Operator 13, a Merkle manifest of a dataset by slot pivot.

Leaves of a group stand in order; every ``fanout`` consecutive nodes become one parent until one is left. A level is one
aggregation: conditional maxima spread the children of a parent into ``fanout`` slot columns. All slots in a row, hashed,
are the parent; all slots but the own one are a node's siblings. The groups' last nodes, in the order of the groups,
grow a tree of the same kind, whose last node is the root of the manifest.

Upwards, every level is a written stage of a third of the rows below, keyed by (group, parent), so a group with a third of
all documents spreads over all tasks. Downwards, the siblings of a node and those of its parents travel as one path, so
a level's join meets each parent once; no document joins every level on its own. Digests travel as 32 bytes and are hashed
as hex text. The driver learns the root and the largest group's size, nothing else.

Cases: null columns are `-` in a leaf; a null source is a group of its own, first; null doc_ids stand first in their group and
are never tampered with (their crc32 is null); rows of one doc_id stand by their leaf, so equal rows may change places
without changing anything; empty text differs from null; a lone leaf is its subroot, a lone subroot the root, and without
siblings the proof is the hash of nothing; only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugewise.llm.common import stage
from gaugewise.llm.ordered import placed

FANOUT = 3


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, `:`, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _slots(fanout: int) -> list[str]:
    return [f"h{s}" for s in range(fanout)]


def _grown(nodes: DataFrame, name: str, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes ``g``, ``i`` (place in the group), ``n`` (nodes of the group), ``h`` and what rides along as ``x``: the slot
    rows of each level, lowest first, and each group's last node as ``g``, ``height``, ``h``."""
    levels, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.filter("n = 1").select("g", F.lit(len(levels)).alias("height"), "h"))
        if most <= 1:
            return levels, reduce(DataFrame.unionAll, tops)
        spread = [c for c in ("h", "x") if c in nodes.columns]
        slot = F.col("i") % fanout
        level = stage(nodes.filter("n > 1").groupBy("g", "n", F.floor(F.col("i") / fanout).alias("p")).agg(*(
            F.max(F.when(slot == s, F.col(c))).alias(f"{c}{s}") for c in spread for s in range(fanout))), name)
        levels.append(level)
        most = -(-most // fanout)
        nodes = level.select("g", F.col("p").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.unhex(digest(*(
            F.coalesce(_hex(F.col(c)), F.lit("")) for c in _slots(fanout)))).alias("h"))


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """From slot rows and the ``path`` of each group's last node: ``g``, ``i``, ``x``, ``h`` and ``path`` of each lowest node
    of the groups with several. A path holds the siblings ``before`` and ``after`` the own slot, lowest level first."""
    empty = F.lit(b"")
    below = None
    for k in reversed(range(len(levels))):
        above = tops.filter(F.col("height") == k + 1).select("g", F.lit(0).cast("long").alias("p"), "path")
        if below is not None:
            above = above.unionAll(below.select("g", F.col("i").alias("p"), "path"))
        filled = [F.coalesce(F.col(c), empty) for c in _slots(fanout)]

        def child(s: int) -> Column:
            own = F.struct(F.concat(empty, *filled[:s]).alias("before"), F.concat(empty, *filled[s + 1:]).alias("after"))
            rides = [F.col(f"x{s}").alias("x")] if k == 0 else []
            return F.struct((F.col("p") * fanout + s).alias("i"), F.col(f"h{s}").alias("h"), own.alias("own"), *rides)

        children = F.filter(F.array(*map(child, range(fanout))), lambda c: c["h"].isNotNull())
        below = levels[k].join(above, ["g", "p"]).select("g", "path", F.explode(children).alias("c")).select(
            "g", "c.*", F.concat(F.array("c.own"), "path").alias("path")).drop("own")
    return below


def proof(path: Column) -> Column:
    """Hash of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["before"], s["after"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex text) gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: digest(_hex(s["before"]), h, _hex(s["after"])))


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """From ``g`` (a group, never null, in bytewise order), ``key`` (the order in it), ``leaf`` (hex text) and ``x``: ``x``, ``leaf``,
    ``subroot``, ``root`` and ``path`` (see `folded` and `proof`) of each row."""
    start = F.array().cast("array<struct<before:binary,after:binary>>")
    rows = stage(rows.select("g", "key", F.unhex("leaf").alias("h"), "x", F.monotonically_increasing_id().alias("r")),
                 "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("key", "h", "r")]
    # The groups' sizes come with the places; a join on the group alone would bring each group into one task.
    nodes = stage(placed(rows, order, F.lit(1).cast("long"), "leaf-ranges", "g").select(
        "g", F.col("place").alias("i"), F.col("whole").alias("n"), "h", "x"), "places")
    levels, tops = _grown(nodes, "level", fanout)
    tops = stage(tops, "subroots")
    over = placed(tops.select("g", "h", "height"), [F.col("g")], F.lit(1).cast("long"), "subroot-ranges")
    over = over.select(F.lit("").alias("g"), F.col("place").alias("i"), F.col("whole").alias("n"), "h",
                       F.struct("g", "height").alias("x"))
    top_levels, top = _grown(over, "top-level", fanout)
    last = top.first()
    root = F.lit(last["h"].hex() if last else None)
    top = top.withColumn("path", start)
    alone = over.filter("n = 1").select("x", "h", start.alias("path"))
    paths = alone if not top_levels else _paths(top_levels, top, fanout).select("x", "h", "path")
    paths = stage(paths.select("x.g", "x.height", F.col("h").alias("subroot"), "path"), "top-paths")
    found = nodes.filter("n = 1").join(paths.filter("height = 0"), "g").select("g", "x", "h", "path", "subroot")
    if levels:
        inner = _paths(levels, paths.withColumn("path", start), fanout).withColumnRenamed("path", "inner")
        found = found.unionAll(inner.join(paths, "g").select("g", "x", "h", F.concat("inner", "path").alias("path"), "subroot"))
    return found.select("x", _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"),
                        "path")


def documents(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest of documents: doc_id, leaf, subroot, root, path, and ``tampered``, the leaf after tampering: where 2
    divides crc32 of the doc_id, the text's line feeds are gone."""
    columns = ("doc_id", "source", "lang", "n_chars")
    rest = F.concat(*map(encoded, map(F.col, columns)))
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("g"), F.col("doc_id").alias("key"),
        digest(rest, encoded(F.col("text"))).alias("leaf"), F.struct("doc_id", F.unhex(F.when(changed, digest(
            rest, encoded(F.translate("text", "\n", ""))))).alias("tampered")).alias("x"))
    return manifest(rows, fanout).select("x.doc_id", "leaf", "subroot", "root", "path", F.coalesce(
        _hex(F.col("x.tampered")), "leaf").alias("tampered"))


def checked(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Each document's place in the manifest, and whether its row, as tampered with, still folds to the root."""
    rows = documents(docs, fanout).withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (
        F.col("folded_root") == F.col("root")).alias("verified"))
