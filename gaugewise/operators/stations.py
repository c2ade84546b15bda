"""Neighbouring stations: radius graph, time alignment and inverse-distance consensus."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugewise.config import DEFAULT, VARIABLES, Config
from gaugewise.functions import worker
from gaugewise.functions.columns import safe_div, usable
from gaugewise.functions.physics import haversine_km
from gaugewise.operators.features import centred, per_variable
from gaugewise.operators.timeline import around_sums, finite, lookup, seen_around
from gaugewise.session import cut

# Worker code travels inside the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(worker)

# What readings of a tile and time chunk meet by, and what tells places apart.
MEETING, PLACE = ["_band", "_col", "_c"], ["station_id", "latitude", "longitude"]
KM_PER_DEGREE = 111.0  # fixed value, slightly below the true 111.19 so that cells are never too small


def _cells(band: Column, d_lat: float) -> Column:
    """How many equal longitude cells a latitude band has: as many as are wide enough for the radius anywhere in the
    band. They fill the circle exactly, so that wrapping at the date line meets whole cells."""
    far = F.least(F.greatest(F.abs(band * d_lat), F.abs((band + 1) * d_lat)), F.lit(89.0))
    return F.greatest(F.floor(F.lit(360.0 / d_lat) * F.cos(F.radians(far))).cast("long"), F.lit(1).cast("long"))


def neighbours(stations: DataFrame, km: float) -> DataFrame:
    """Directed pairs of stations within ``km``: an equi-join on grid cells, then the exact distance.

    A station sits in one cell and asks in the cells its circle can touch, so there is no Cartesian
    product; longitude wraps at the date line.
    """
    d_lat = km / KM_PER_DEGREE
    s = stations.select("station_id", "latitude", "longitude")
    cells = lambda b: _cells(b, d_lat)
    column = lambda lon, b: F.floor((lon + 180) * cells(b) / 360).cast("long")
    here = s.withColumn("_band", F.floor(F.col("latitude") / d_lat).cast("long"))
    placed = here.select(
        F.col("station_id").alias("neighbour_id"), F.col("latitude").alias("_nlat"),
        F.col("longitude").alias("_nlon"), "_band",
        F.pmod(column(F.col("longitude"), F.col("_band")), cells(F.col("_band"))).alias("_col"))
    reach = F.least(F.abs("latitude") + d_lat, F.lit(90.0))
    d_lon = F.when(reach >= 89.0, 180.0).otherwise(F.lit(d_lat) / F.cos(F.radians(reach)))
    asks = here.select("*", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)).alias("_b"),
                       d_lon.alias("_dlon"))
    asked = asks.select(
        "station_id", "latitude", "longitude", F.col("_b").alias("_band"),
        F.explode(F.array_distinct(F.transform(
            F.sequence(column(F.col("longitude") - F.col("_dlon"), F.col("_b")),
                       column(F.col("longitude") + F.col("_dlon"), F.col("_b"))),
            lambda c: F.pmod(c, cells(F.col("_b")))))).alias("_col"))
    dist = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_nlat"), F.col("_nlon"))
    return (asked.join(placed, ["_band", "_col"])
            .where(F.col("station_id") != F.col("neighbour_id"))
            .withColumn("km", dist).where(F.col("km") <= km)
            .select("station_id", "neighbour_id", "km"))


def tiles(stations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each place of a station once for each tile its circle of ``radius_km`` can touch, ``_home`` in the tile it lies in.

    A tile is some radii wide, so most places are in one tile only. ``_times``: how often ``stations`` has that place."""
    d_lat = cfg.radius_km / KM_PER_DEGREE
    size = d_lat * cfg.tile_radii
    column = lambda lon, b: F.floor((lon + 180) * _cells(b, size) / 360).cast("long")
    band = lambda lat: F.floor(lat / size).cast("long")
    places = stations.where("station_id is not null and latitude is not null and longitude is not null").groupBy(
        *PLACE).agg(F.count(F.lit(1)).alias("_times"))
    reach = F.least(F.abs("latitude") + d_lat, F.lit(90.0))
    d_lon = F.when(reach >= 89.0, 180.0).otherwise(F.lit(d_lat) / F.cos(F.radians(reach)))
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = places.select("*", band(lat).alias("_own"), d_lon.alias("_dlon"), F.explode(
        F.sequence(band(lat - d_lat), band(lat + d_lat))).alias("_band"))
    b = F.col("_band")
    rows = rows.select("*", F.explode(F.array_distinct(F.transform(
        F.sequence(column(lon - F.col("_dlon"), b), column(lon + F.col("_dlon"), b)),
        lambda c: F.pmod(c, _cells(b, size))))).alias("_col"))
    home = (b == F.col("_own")) & (F.col("_col") == F.pmod(column(lon, b), _cells(b, size)))
    return rows.withColumn("_home", home).drop("_own", "_dlon")


def _asked(df: DataFrame, edges: DataFrame, cfg: Config, *columns: Column) -> DataFrame:
    """Each reading once for each neighbour of its station."""
    return lookup(df.select("reading_id", "station_id", "t", *columns), edges, ["station_id"], cfg.salts, how="inner")


def _own() -> list[Column]:
    return [F.col(v).alias(f"own_{v}") for v in VARIABLES]


def align_neighbours(df: DataFrame, edges: DataFrame | None, cfg: Config = DEFAULT, stations: DataFrame | None = None
                     ) -> DataFrame:
    """Per reading and neighbour: count, sum and square sum of each variable's usable values within +-``time_tol``.

    Every reading asks each neighbour's timeline once, so the cost is readings x neighbours and does
    not grow with the reporting rate as an interval join of readings with readings would. With ``stations`` in place of
    ``edges`` the neighbours are those of ``neighbours`` and no row per reading and neighbour is shuffled (``paired``).
    """
    if stations is not None:
        return paired(df, stations, cfg, nearest=False)
    seen = df.select(F.col("station_id").alias("neighbour_id"), "t", *VARIABLES)
    sums: dict[str, str] = {}
    for v in VARIABLES:
        x = centred(v, cfg)
        sums |= {f"an_{v}": f"if({usable(v, cfg)} is null, 0, 1)", f"as_{v}": x, f"ass_{v}": f"{x} * {x}"}
    out = around_sums(_asked(finite(df, list(VARIABLES)), edges, cfg, *_own()), seen, ["neighbour_id"], "t",
                      cfg.time_tol_us, sums, cfg.align_us)
    return out.where(" or ".join(f"an_{v} > 0" for v in VARIABLES))


def nearest_neighbours(df: DataFrame, edges: DataFrame | None, cfg: Config = DEFAULT, told: DataFrame | None = None,
                       stations: DataFrame | None = None) -> DataFrame:
    """Per reading and neighbour: the neighbour's usable value nearest in time within +-``time_tol``, per variable
    (an earlier value wins a tie). Same columns as ``align_neighbours``, with counts 0 or 1.

    A missing value, a NaN or a sentinel out of bounds is not seen, so the value before or after it is; readings ask
    the neighbour's timeline by ``seen_around``, so again no reading x reading pair is formed and a busy neighbour
    spreads over its chunks. ``told``: where the neighbours' values come from, if not from the readings that ask.
    ``stations`` as in ``align_neighbours``.
    """
    if stations is not None:
        return paired(df, stations, cfg, told, nearest=True)
    tol = cfg.time_tol_us
    seen = (df if told is None else told).select(F.col("station_id").alias("neighbour_id"), "t", "reading_id", *VARIABLES)
    near = seen_around(_asked(finite(df, list(VARIABLES)), edges, cfg, *_own()).withColumnRenamed("reading_id", "_asks"),
                       seen, "neighbour_id", "t", cfg.align_us, {v: usable(v, cfg) for v in VARIABLES}, "reading_id")
    out = ["_asks as reading_id", "station_id", "t", "km", *[f"own_{v}" for v in VARIABLES]]
    for v in VARIABLES:
        before, after = f"if(t - _p_{v}.t <= {tol}, t - _p_{v}.t, null)", f"if(_n_{v}.t - t <= {tol}, _n_{v}.t - t, null)"
        out.append(f"case when {after} < {before} or {before} is null then if({after} is null, null, _n_{v}.x) "
                   f"else _p_{v}.x end as _x_{v}")
    near = near.selectExpr(*out)
    return near.where(" or ".join(f"_x_{v} is not null" for v in VARIABLES)).selectExpr(
        "reading_id", "station_id", "t", *[f"own_{v}" for v in VARIABLES], "km", *[e for v in VARIABLES for e in (
            f"if(_x_{v} is null, 0, 1) as an_{v}", f"coalesce(_x_{v} - {cfg.centre[v]}D, 0D) as as_{v}",
            f"coalesce((_x_{v} - {cfg.centre[v]}D) * (_x_{v} - {cfg.centre[v]}D), 0D) as ass_{v}")])


#: The chunk of readings without a time.
NEVER = -(1 << 63)


def dealt(df: DataFrame, stations: DataFrame, cfg: Config = DEFAULT, told: DataFrame | None = None, timeless: bool = False
          ) -> DataFrame:
    """Readings by tile and time chunk (``MEETING``): those that ask there (``_ask``) and those that are told (``_tell``),
    which also lie in the tile's margin or within the tolerance of the chunk. ``timeless``: those without a time, too, as a
    chunk of their own."""
    c, tol = cfg.tile_us, cfg.time_tol_us
    chunk = lambda at: f"(({at}) - pmod({at}, {c})) div {c}"
    around = tiles(stations, cfg)
    home = F.coalesce(F.expr(chunk("t")), F.lit(NEVER))
    near = F.explode(F.coalesce(F.sequence(F.expr(chunk(f"t - {tol}")), F.expr(chunk(f"t + {tol}"))), F.array(
        F.lit(NEVER)))).alias("_c")
    own = lambda d: finite(d, list(VARIABLES)).where(F.lit(timeless) | F.col("t").isNotNull()).select(
        "reading_id", "station_id", "t", *[F.col(v).cast("double").alias(v) for v in VARIABLES])
    rows = lookup(own(df if told is None else told), around, ["station_id"], cfg.salts, how="inner").select("*", near)
    if told is None:
        rows = rows.withColumn("_ask", F.col("_home") & (F.col("_c") == home)).withColumn("_tell", F.lit(True))
    else:
        asks = lookup(own(df), around.where("_home"), ["station_id"], cfg.salts, how="inner")
        rows = rows.withColumns({"_ask": F.lit(False), "_tell": F.lit(True)}).unionByName(asks.withColumns(
            {"_c": home, "_ask": F.lit(True), "_tell": F.lit(False)}))
    return rows.select(*MEETING, *PLACE, "_times", "t", "reading_id", "_ask", "_tell", *VARIABLES)


def paired(df: DataFrame, stations: DataFrame, cfg: Config = DEFAULT, told: DataFrame | None = None, nearest: bool = False
           ) -> DataFrame:
    """What ``align_neighbours`` or ``nearest_neighbours`` give over the pairs of ``neighbours``, made where readings of a
    tile and time chunk meet (``dealt``, ``worker.PairScan``): readings are shuffled about twice each, pairs are not."""
    rows = dealt(df, stations, cfg, told, timeless=not nearest).repartition(*MEETING).sortWithinPartitions(
        *MEETING, *PLACE, "t", "reading_id")
    kinds = rows.schema
    sums = [f"{p}_{v}" for v in VARIABLES for p in ("an", "as", "ass")]
    schema = T.StructType([kinds["reading_id"], kinds["station_id"], T.StructField("neighbour_id", kinds["station_id"].dataType),
                           kinds["t"], *[T.StructField(f"own_{v}", T.DoubleType()) for v in VARIABLES],
                           *[T.StructField(n, T.DoubleType()) for n in ("km", *sums)]])
    return rows.mapInArrow(worker.PairScan(
        VARIABLES, [cfg.bounds[v] for v in VARIABLES], [cfg.centre[v] for v in VARIABLES], cfg.time_tol_us, cfg.radius_km,
        cfg.radius_km / KM_PER_DEGREE, nearest, schema.names), schema)


def nearest_sums(df: DataFrame, stations: DataFrame, cfg: Config = DEFAULT, told: DataFrame | None = None) -> DataFrame:
    """What ``consensus`` sums per reading over ``nearest_neighbours``, without a row per reading and neighbour.

    ``worker.NearestScan`` lets each value of a tile and time chunk meet the readings it is nearest to. So a reading
    travels about twice, however many neighbours its station has, and a busy area spreads over its chunks. ``told`` as
    in ``nearest_neighbours``."""
    rows = dealt(df, stations, cfg, told).repartition(*MEETING).sortWithinPartitions(*MEETING, *PLACE, "t", "reading_id")
    names = [f"_{p}_{v}" for v in VARIABLES for p in ("ws", "w", "n", "agree", "s", "ss")]
    schema = T.StructType([rows.schema["reading_id"], *[T.StructField(n, T.DoubleType()) for n in names]])
    scan = worker.NearestScan(
        VARIABLES, [cfg.bounds[v] for v in VARIABLES], [cfg.centre[v] for v in VARIABLES],
        [cfg.station_scale[v] for v in VARIABLES], cfg.time_tol_us, cfg.radius_km, cfg.radius_km / KM_PER_DEGREE, cfg.min_km,
        cfg.idw_power, names)
    return rows.mapInArrow(scan, schema).groupBy("reading_id").agg(*[F.sum(n).alias(n) for n in names])


def aligned_view(df: DataFrame, edges: DataFrame | None, cfg: Config = DEFAULT, stations: DataFrame | None = None
                 ) -> DataFrame:
    """Readable form of ``align_neighbours``: aligned count and mean of each variable."""
    return align_neighbours(df, edges, cfg, stations).select(
        "reading_id", "station_id", "neighbour_id", "km",
        *[F.col(f"an_{v}").cast("long").alias(f"n_{v}") for v in VARIABLES],
        *[(cfg.centre[v] + safe_div(F.col(f"as_{v}"), F.col(f"an_{v}"))).alias(f"mean_{v}")
          for v in VARIABLES])


def asof_neighbours(df: DataFrame, edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per reading and neighbour: the neighbour's latest reading with any usable value at or before it, at most tol
    old. Values that are not usable are NULL."""
    values = {v: usable(v, cfg) for v in VARIABLES}
    any_value = " or ".join(f"{x} is not null" for x in values.values())
    whole = f"if({any_value}, named_struct({', '.join(f'{v!r}, {x}' for v, x in values.items())}), null)"
    seen = df.select(F.col("station_id").alias("neighbour_id"), "t", "reading_id", *VARIABLES)
    found = seen_around(_asked(df, edges, cfg).withColumnRenamed("reading_id", "_asks"), seen, "neighbour_id", "t",
                        cfg.align_us, {"seen": whole}, "reading_id", ahead=False)
    return found.where(F.col("t") - F.col("_p_seen.t") <= cfg.time_tol_us).select(
        F.col("_asks").alias("reading_id"), "station_id", "neighbour_id", "km",
        F.col("_p_seen.reading_id").alias("neighbour_reading_id"), (F.col("t") - F.col("_p_seen.t")).alias("age_us"),
        *[F.col(f"_p_seen.x.{v}").alias(f"neighbour_{v}") for v in VARIABLES])


def consensus(aligned: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Inverse-distance consensus per reading, wide over the variables.

    ``idw`` weights every aligned value by 1 / km^p; ``nn`` counts neighbours that reported, ``agree``
    those within ``station_scale`` of the reading, ``spread`` is the sample std of the aligned values.
    """
    w = 1 / F.pow(F.greatest(F.col("km"), F.lit(cfg.min_km)), F.lit(cfg.idw_power))
    aggs = []
    for v in VARIABLES:
        n, s = F.col(f"an_{v}"), F.col(f"as_{v}")
        gap = F.abs(cfg.centre[v] + safe_div(s, n) - F.col(f"own_{v}"))
        aggs += [F.sum(w * s).alias(f"_ws_{v}"), F.sum(w * n).alias(f"_w_{v}"),
                 F.count_if(n > 0).alias(f"nn_{v}"),
                 F.count_if(F.coalesce(gap <= cfg.station_scale[v], F.lit(False))).alias(f"agree_{v}"),
                 F.sum(n).alias(f"_n_{v}"), F.sum(s).alias(f"_s_{v}"),
                 F.sum(f"ass_{v}").alias(f"_ss_{v}")]
    return _consensus_of(aligned.groupBy("reading_id").agg(*aggs), cfg)


def _consensus_of(g: DataFrame, cfg: Config) -> DataFrame:
    """The consensus columns from sums per reading."""
    out = ["reading_id"]
    for v in VARIABLES:
        n, s, ss = F.col(f"_n_{v}"), F.col(f"_s_{v}"), F.col(f"_ss_{v}")
        var = F.greatest(safe_div(ss - s * safe_div(s, n), n - 1), F.lit(0.0))
        out += [(cfg.centre[v] + safe_div(F.col(f"_ws_{v}"), F.col(f"_w_{v}"))).alias(f"idw_{v}"),
                F.col(f"nn_{v}"), F.col(f"agree_{v}"), F.when(n > 1, F.sqrt(var)).alias(f"spread_{v}")]
    return g.select(*out)


def cross_station(v: str, cfg: Config) -> Column:
    """1 at consensus, 0 at ``station_scale`` away; NULL under ``min_neighbours``."""
    gap = F.abs(F.col(v) - F.col(f"idw_{v}")) / cfg.station_scale[v]
    return F.when((F.col(f"nn_{v}") >= cfg.min_neighbours) & gap.isNotNull(),
                  F.greatest(F.lit(0.0), 1 - gap))


def with_consensus(df: DataFrame, stations: DataFrame, cfg: Config = DEFAULT, source: DataFrame | None = None,
                   edges: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """Attach the consensus columns; ``source`` may be a cheaper frame with the same readings, ``edges`` a station
    graph other than that of ``neighbours``, ``told`` as in ``nearest_neighbours``."""
    source = df if source is None else source
    if edges is None:
        sums = nearest_sums(source, stations, cfg, told)
        found = _consensus_of(sums.withColumns({f"{new}_{v}": F.col(f"{old}_{v}").cast("long") for v in VARIABLES
                                                for new, old in (("nn", "_n"), ("agree", "_agree"))}), cfg)
    else:
        found = consensus(nearest_neighbours(source, edges, cfg, told), cfg)
    # Written, so that what was dealt is gone when whole rows are shuffled to meet it.
    found = cut(found, "consensus")
    out = finite(df, list(VARIABLES)).join(found, "reading_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for v in VARIABLES
                            for c in (f"nn_{v}", f"agree_{v}")})


def idw_consensus(df: DataFrame, stations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Long form: consensus, neighbour counts, spread and cross-station score per variable."""
    wide = with_consensus(df, stations, cfg)
    return per_variable(wide, {v: {
        "x": F.col(v), "idw": F.col(f"idw_{v}"), "n_neighbours": F.col(f"nn_{v}"),
        "n_agree": F.col(f"agree_{v}"), "spread": F.col(f"spread_{v}"),
        "cross_station": cross_station(v, cfg)} for v in VARIABLES}, ["reading_id", "station_id"])
