"""Order-dependent building blocks that never put a sensor's whole history into one task.

A plain ``Window.partitionBy(station).orderBy(ts)`` sorts a station's full history in one task, and a
sliding RANGE frame costs (rows x rows per frame). Both break when one station holds a third of
all rows. The helpers here partition by (key, time chunk) instead and stitch the chunks together
through small per-chunk tables, so results are those of the plain window at O(n log n).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gaugewise.session import cut


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities as NULL: a running sum could never take them out again."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.expr(f"if(isnan(`{c}`) or abs(`{c}`) = double('infinity'), null, `{c}`)")
                           for c in columns if kinds[c] in ("double", "float")})


def rolling_sums(
    df: DataFrame,
    keys: list[str],
    t: str,
    inputs: list[str],
    sums: dict[str, tuple[str, int]],
    bucket_us: int,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, sums over the rows of the same key with time in [t - width, t).

    ``sums`` maps an output name to (SQL expression over ``inputs``, width); each width is a multiple of
    ``bucket_us``. NULL expressions count as 0. Every row enters its own bucket with + and leaves,
    one width later, with -; a bucket starts from the sum of the whole buckets inside the frame.
    One running sum inside (key, bucket) then yields the frame sum, whatever the frame length.
    ``source`` may name a cheaper frame with the same rows for the bucket table, so that the plan behind
    a derived ``df`` is not computed twice.
    """
    bucket = lambda at: f"(({at}) - pmod({at}, {bucket_us})) div {bucket_us}"
    widths = sorted({w for _, w in sums.values()})
    if any(w % bucket_us for w in widths):
        raise ValueError("every width must be a multiple of the bucket")
    payload = [c for c in df.columns if c not in keys]
    types = df.schema
    no_row = T.StructType([types[c] for c in payload])
    by = ", ".join(f"`{k}`" for k in keys)
    value = {name: f"coalesce(cast({e} as double), 0D)" for name, (e, _) in sums.items()}

    # Whole-bucket sums, combined map-side, then summed over the buckets a frame covers in full.
    per_bucket = finite(df if source is None else source, inputs).groupBy(*keys, F.expr(f"{bucket(t)} as _b")).agg(
        *[F.expr(f"sum({e}) as {name}") for name, e in value.items()])
    base = per_bucket.selectExpr(
        *keys, "_b", "cast(null as int) as _leave", f"_b * {2 * bucket_us} - 1 as _o",
        *[f"cast(null as {types[c].dataType.simpleString()}) as `{c}`" for c in inputs],
        *[f"coalesce(sum({name}) over (partition by {by} order by _b range between {w // bucket_us} preceding "
          f"and 1 preceding), 0D) as _base_{name}" for name, (_, w) in sums.items()])

    # Raw inputs, not the many derived terms, travel through the shuffle.
    moves = [f"named_struct('_b', {bucket(t)}, '_leave', 0, '_o', {t} * 2 + 1)"]
    moves += [f"named_struct('_b', {bucket(f'{t} + {w}')}, '_leave', {i}, '_o', ({t} + {w}) * 2 + 1)"
              for i, w in enumerate(widths, start=1)]
    events = finite(df.withColumn("_all", F.struct(*payload)), inputs).select(
        *keys, *inputs, "_all", F.expr(f"explode(array({', '.join(moves)})) as _m"))
    events = events.select(*keys, *inputs, "_m.*", F.expr("if(_m._leave = 0, _all, null) as _row"))
    union = events.unionByName(base.withColumn("_row", F.lit(None).cast(no_row)), allowMissingColumns=True)

    signed = union.repartition(*keys, "_b").selectExpr(
        "*", *[f"case _leave when 0 then 1D when {i} then -1D else 0D end as _s{i}" for i in range(1, len(widths) + 1)])
    signed = signed.selectExpr(
        *keys, *inputs, "_b", "_o", "_leave", "_row",
        *[f"_s{widths.index(w) + 1} * {value[name]} + coalesce(_base_{name}, 0D) as _d_{name}"
          for name, (_, w) in sums.items()])
    run = f"over (partition by {by}, _b order by _o range between unbounded preceding and 1 preceding)"
    out = signed.selectExpr(*keys, *inputs, "_leave", "_row",
                            *[f"coalesce(sum(_d_{name}) {run}, 0D) as {name}" for name in sums])
    rest = [c for c in payload if c not in inputs]
    return out.where("_leave = 0").select(*keys, *[f"_row.{c}" for c in (*inputs, *rest)], *list(sums))


def around_sums(
    probes: DataFrame,
    events: DataFrame,
    keys: list[str],
    t: str,
    tol_us: int,
    sums: dict[str, str],
    bucket_us: int | None = None,
) -> DataFrame:
    """Add to each probe the sums over events of the same key with time in [t - tol, t + tol].

    The same running-sum idea as ``rolling_sums``: an event becomes visible at t - tol and disappears after t + tol,
    and a bucket, an even part of the tolerance, starts with the events that are visible at its start. No probe x event
    pair is ever formed, and a busy key spreads over as many tasks as it has buckets.
    """
    size = bucket_us or tol_us
    wide = tol_us // size
    if tol_us % size:
        raise ValueError("the tolerance must be a multiple of the bucket")
    bucket = lambda at: F.floor(at / F.lit(size)).cast("long")
    names = list(sums)
    ev = finite(events, [c for c in events.columns if c not in (*keys, t)]).selectExpr(
        *keys, t, *[f"coalesce(cast({e} as double), 0D) as {n}" for n, e in sums.items()])
    payload_cols = [c for c in probes.columns if c not in keys]
    types = probes.schema
    no_row = F.lit(None).cast(T.StructType([types[c] for c in payload_cols])).alias("_row")

    at = F.col(t)
    # Time runs in half microseconds, so that an event leaves just after t + tol.
    moves = F.array(
        F.struct(bucket(at - tol_us).alias("_b"), ((at - tol_us) * 2).alias("_o"), F.lit(1.0).alias("_s")),
        F.struct(bucket(at + tol_us).alias("_b"), ((at + tol_us) * 2 + 1).alias("_o"), F.lit(-1.0).alias("_s")))
    moved = ev.select(*keys, *names, F.explode(moves).alias("_m")).select(
        *keys, "_m._b", "_m._o", *[F.expr(f"{n} * _m._s as {n}") for n in names], no_row)
    asked = probes.select(*keys, bucket(at).alias("_b"), (at * 2).alias("_o"), *[F.expr(f"0D as {n}") for n in names],
                          F.struct(*payload_cols).alias("_row"))
    # A bucket that is asked starts with the events of as many buckets on both sides as the tolerance is long.
    totals = ev.groupBy(*keys, bucket(at).alias("_b")).agg(*[F.sum(n).alias(n) for n in names])
    zero = asked.select(*keys, "_b", *names).distinct()
    known = totals.unionByName(zero).groupBy(*keys, "_b").agg(*[F.sum(n).alias(n) for n in names])
    by = ", ".join(keys)
    near = f"over (partition by {by} order by _b range between {wide} preceding and {wide - 1} following)"
    start = known.selectExpr(*keys, "_b", f"_b * {2 * size} - 1 as _o", *[f"sum({n}) {near} as {n}" for n in names])
    union = asked.unionByName(moved).unionByName(start.withColumn("_row", no_row))
    run = f"over (partition by {by}, _b order by _o range between unbounded preceding and current row)"
    out = union.repartition(*keys, "_b").selectExpr(*keys, "_row", *[f"sum({n}) {run} as {n}" for n in names])
    return out.where(F.col("_row").isNotNull()).select(*keys, "_row.*", *names)


def seen_around(
    probes: DataFrame,
    events: DataFrame,
    key: str,
    t: str,
    chunk_us: int,
    seen: dict[str, str],
    order: str,
    ahead: bool = True,
) -> DataFrame:
    """Add to each probe the last event of the same key at or before it and, with ``ahead``, the first at or after it.

    ``seen`` maps a name to an SQL expression over ``events``; an event whose expression is NULL is not seen. The
    results are structs ``_p_<name>`` and ``_n_<name>`` of the event's ``t``, its ``order`` column (the largest wins among
    events of one time) and its value ``x``; NULL where there is none, however long ago it may be.

    A merge in two levels: rows of a key are dealt by chunks of ``chunk_us``, each chunk's last and first event are
    carried over to the chunks after and before it in a table with one row per (key, chunk), and within a chunk a
    running maximum finds the rest. So a key with any share of all rows spreads over all its chunks.
    """
    payload = [c for c in probes.columns if c not in (key, t)]
    kinds = events.select(order, *[F.expr(e).alias(n) for n, e in seen.items()]).schema
    chunk = f"({t} - pmod({t}, {chunk_us})) div {chunk_us}"
    # Maxima over (time, order) look back; maxima over (-time, order) look ahead.
    sides = {"p": ""} | ({"n": "-"} if ahead else {})
    names = [f"_{side}_{n}" for n in seen for side in sides]
    found = {f"_{side}_{n}": f"if(({e}) is null, null, named_struct('at', {sign}{t}, 'id', {order}, 'x', {e}))"
             for n, e in seen.items() for side, sign in sides.items()}
    kind = {f"_{side}_{n}": f"struct<at: bigint, id: {kinds[order].dataType.simpleString()}, "
                            f"x: {kinds[n].dataType.simpleString()}>" for n in seen for side in sides}
    asked = probes.select(key, t, F.expr("1 as _kind"), F.struct(*payload).alias("_row"), *[
        F.lit(None).cast(kind[n]).alias(n) for n in names])
    told = events.selectExpr(key, t, "0 as _kind", *[f"cast({found[n]} as {kind[n]}) as {n}" for n in names])
    both = asked.unionByName(told, allowMissingColumns=True).withColumn("_c", F.expr(chunk))
    own = both.groupBy(key, "_c").agg(*[F.max(n).alias(n) for n in names])
    before = f"over (partition by {key} order by _c rows between unbounded preceding and 1 preceding)"
    after = f"over (partition by {key} order by _c rows between 1 following and unbounded following)"
    carried = own.selectExpr(key, "_c", "-1 as _kind", *[
        f"max({n}) {before if n.startswith('_p_') else after} as {n}" for n in names])
    rows = both.unionByName(carried, allowMissingColumns=True).repartition(key, "_c")
    up_to = "rows between unbounded preceding and current row"
    forward = f"over (partition by {key}, _c order by if(_kind = -1, 0, 1), {t}, _kind {up_to})"
    back = f"over (partition by {key}, _c order by if(_kind = -1, 0, 1), {t} desc, _kind {up_to})"
    rows = rows.selectExpr(key, t, "_row", *[
        f"max({n}) {forward if n.startswith('_p_') else back} as {n}" for n in names]).where("_row is not null")
    return rows.selectExpr(key, t, "_row.*", *[
        f"if({n} is null, null, named_struct('t', {sign}{n}.at, '{order}', {n}.id, 'x', {n}.x)) as {n}"
        for s in seen for side, sign in sides.items() for n in [f"_{side}_{s}"]])


def with_adjacent(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    n: int,
    chunk: Column,
    exprs: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    """Evaluate window expressions that look at most ``n`` rows back or ahead.

    Rows well inside a (key, chunk) see their neighbours locally. Rows within n of a chunk edge are
    recomputed over the thin table of edge rows (at most 4n per chunk). Both branches read one exchange.
    """
    inside = Window.partitionBy(*keys, "_c").orderBy(*order)
    whole = Window.partitionBy(*keys, "_c")
    ranked = (df.withColumn("_c", chunk).repartition(*keys, "_c")
              .withColumn("_r", F.row_number().over(inside))
              .withColumn("_n", F.count(F.lit(1)).over(whole)))
    interior = (F.col("_r") > n) & (F.col("_r") <= F.col("_n") - n)
    edges = ranked.where((F.col("_r") <= 2 * n) | (F.col("_r") > F.col("_n") - 2 * n))
    local = ranked.withColumns(exprs(inside)).where(interior)
    stitched = edges.withColumns(exprs(Window.partitionBy(*keys).orderBy(*order))).where(~interior)
    return local.unionByName(stitched).drop("_c", "_r", "_n")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    specs: dict[str, tuple[str, Column, bool]],
    descending: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running aggregates over a key's whole history, up to (or strictly before) the current row.

    ``specs``: name -> (``sum`` | ``max`` | ``min``, expression, include the current row). ``chunk`` must
    not decrease along ``order``. Each chunk starts from the aggregate of the chunks before it, which
    comes from a table with one row per (key, chunk). With ``descending`` the history runs backwards.
    ``source`` is as in ``rolling_sums``.
    """
    aggs = {"sum": F.sum, "max": F.max, "min": F.min}
    prepare = lambda d: d.withColumn("_c", chunk).withColumns({f"_e_{s}": e for s, (_, e, _) in specs.items()})
    work = prepare(df)
    per_chunk = (work if source is None else prepare(source)).groupBy(*keys, "_c").agg(
        *[aggs[a](f"_e_{s}").alias(f"_e_{s}") for s, (a, _, _) in specs.items()])
    by_chunk = F.col("_c").desc() if descending else F.col("_c").asc()
    earlier = (Window.partitionBy(*keys).orderBy(by_chunk)
               .rowsBetween(Window.unboundedPreceding, -1))
    base = per_chunk.select(*keys, "_c", F.lit(0).alias("_kind"), *[
        aggs[a](f"_e_{s}").over(earlier).alias(f"_e_{s}") for s, (a, _, _) in specs.items()])
    union = work.withColumn("_kind", F.lit(1)).unionByName(base, allowMissingColumns=True)
    by_row = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    spec = Window.partitionBy(*keys, "_c").orderBy("_kind", *by_row)
    last = {True: Window.currentRow, False: -1}
    out = union.withColumns({
        s: aggs[a](f"_e_{s}").over(spec.rowsBetween(Window.unboundedPreceding, last[inc]))
        for s, (a, _, inc) in specs.items()})
    return out.where(F.col("_kind") == 1).drop("_c", "_kind", *[f"_e_{s}" for s in specs])


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A written copy with ``_range``: the number of an evenly filled range of ``order``, a chunk for ``running`` whatever the
    columns' values are. The last column of ``order`` should tell rows apart, so that ties spread too."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], salts: int, how: str = "left",
           spread_by: str = "reading_id") -> DataFrame:
    """Join a fact table with a per-key table without sending a hot key to one task.

    The fact rows of a key are spread over ``salts`` sub-keys and the small side is repeated once per
    sub-key. No broadcast is forced: Spark picks one from the measured size, and otherwise shuffles.
    """
    if salts == 1:
        return big.join(small, keys, how)
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    wide = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(wide, [*keys, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
