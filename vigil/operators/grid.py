"""Sparse-grid hotspot prediction.

The prediction bins points on a lattice that starts one resolution step below
the minimum coordinate (numpy ``arange`` edges, ``histogram2d`` bin rules),
keeps the cells whose count reaches the 75th percentile of the occupied cells,
and describes every hot cell by its modal place and category shares.

Only occupied cells ever exist here: the lattice is never materialised, so the
cost is bounded by the number of incidents, not by the extent of the map.

Job shape (the raw incidents are read twice, narrowly: min/max, then the
aggregate):

1. extent — a one-row min/max aggregate fetched to the driver and used as
   literals (``assign_cells`` also accepts a lazy extent frame, read through
   a scalar subquery);
2. ``(i, j, place, category) -> n`` — hash aggregate with map-side partial
   aggregation, so a cell holding a third of all rows still ships one row per
   (map task, place, category); the aggregated rows are checkpointed to the
   shared folder;
3. threshold and max — one row from the checkpoint (``percentile`` keeps a
   value→frequency map, bounded by the distinct counts);
4. cell totals, modal place and shares from the checkpoint: only the small
   aggregate is shuffled again, never the raw incidents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions.geo import valid_point
from vigil.functions.numeric import round_half_even
from vigil.session import materialize


def grid_extent(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                resolution: float = FV.GRID_RESOLUTION, ts: str | None = None) -> DataFrame:
    """One row: start, step, second edge and edge count per axis.

    Edges follow numpy ``arange(min - r, max + r, r)``: ``e0 = s``,
    ``e1 = s + r`` and ``ek = s + k * ((s + r) - s)``; the edge count is
    ``ceil(((max + r) - s) / r)``.
    """
    r = F.lit(float(resolution))
    pts = df.filter(valid_point(lat, lon))
    aggs = [(F.min(lat) - r).alias("lat_s"), (F.max(lat) + r).alias("lat_stop"),
            (F.min(lon) - r).alias("lon_s"), (F.max(lon) + r).alias("lon_stop")]
    if ts:
        aggs.append(F.to_date(F.max(ts)).alias("last_day"))
    e = pts.agg(*aggs)
    cols = []
    for ax in ("lat", "lon"):
        s, stop = F.col(f"{ax}_s"), F.col(f"{ax}_stop")
        cols += [s.alias(f"{ax}_s"), (s + r).alias(f"{ax}_e1"), ((s + r) - s).alias(f"{ax}_d"),
                 F.ceil((stop - s) / r).cast("bigint").alias(f"{ax}_n")]
    if ts:
        cols.append(F.col("last_day"))
    return e.select(*cols)


def _edge(k: Column, s: Column, e1: Column, d: Column) -> Column:
    return F.when(k == 1, e1).otherwise(s + k.cast("double") * d)


def _in_lattice(x: Column, ax: Column) -> Column:
    """``e0 <= x <= e_last``: the points ``histogram2d`` keeps on this axis."""
    s, e1, d, n_edges = (ax.getField(f) for f in ("s", "e1", "d", "n"))
    return (x >= s) & (x <= _edge(n_edges - 1, s, e1, d))


def _bin(x: Column, ax: Column) -> Column:
    """``searchsorted(edges, x, 'right') - 1``, last edge closed.

    Assumes :func:`_in_lattice`. ``floor((x - s) / d)`` is corrected by one
    step against the exact edge values, then the last edge folds into the
    last bin. Plain arithmetic, no nested CASE, so the expression stays small
    when the optimizer inlines it.
    """
    s, e1, d, n_edges = (ax.getField(f) for f in ("s", "e1", "d", "n"))
    k0 = F.floor((x - s) / d).cast("bigint")
    k1 = (k0 - (x < _edge(k0, s, e1, d)).cast("bigint")
          + (x >= _edge(k0 + 1, s, e1, d)).cast("bigint"))
    return F.least(k1, n_edges - 2)


_EXTENT_TYPES = {"lat_s": "double", "lat_e1": "double", "lat_d": "double", "lat_n": "bigint",
                 "lon_s": "double", "lon_e1": "double", "lon_d": "double", "lon_n": "bigint",
                 "last_day": "date"}


def extent_values(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                  resolution: float = FV.GRID_RESOLUTION, ts: str | None = None) -> dict:
    """The one-row extent fetched to the driver (a distributed min/max)."""
    row = grid_extent(df, lat, lon, resolution, ts=ts).first()
    return row.asDict()


def _extent_scalar(extent) -> Column:
    """Extent as a struct column: typed literals for fetched values (folded
    into the plan as constants), or a scalar subquery for a lazy frame."""
    if isinstance(extent, DataFrame):
        return extent.select(F.struct(*[F.col(c) for c in extent.columns])).scalar()
    return F.struct(*[F.lit(v).cast(_EXTENT_TYPES[k]).alias(k) for k, v in extent.items()])


def _axis(x: Column, ax: str) -> Column:
    return F.struct(x.getField(f"{ax}_s").alias("s"), x.getField(f"{ax}_e1").alias("e1"),
                    x.getField(f"{ax}_d").alias("d"), x.getField(f"{ax}_n").alias("n"))


def assign_cells(df: DataFrame, extent, lat: str = "latitude",
                 lon: str = "longitude") -> DataFrame:
    """Add ``i``/``j`` cell indices; rows outside the lattice are dropped.

    The extent enters the plan once, as one scalar-subquery column; every
    edge expression then reads fields of that column.
    """
    cols = df.columns
    x = F.col("_grid")
    ax_lat, ax_lon = _axis(x, "lat"), _axis(x, "lon")
    return (df.withColumn("_grid", _extent_scalar(extent))
            .filter(valid_point(lat, lon) & _in_lattice(F.col(lat), ax_lat)
                    & _in_lattice(F.col(lon), ax_lon))
            .select(*cols, _bin(F.col(lat), ax_lat).alias("i"),
                    _bin(F.col(lon), ax_lon).alias("j")))


def cell_centres(cells: DataFrame, extent) -> DataFrame:
    """Add ``lat``/``lon`` = midpoint of the cell's edges."""
    x = F.col("_grid")

    def mid(k, ax):
        s, e1, d = (x.getField(f"{ax}_{f}") for f in ("s", "e1", "d"))
        return (_edge(F.col(k), s, e1, d) + _edge(F.col(k) + 1, s, e1, d)) / 2

    return (cells.withColumn("_grid", _extent_scalar(extent))
            .select(*cells.columns, mid("i", "lat").alias("lat"), mid("j", "lon").alias("lon")))


def grid_histogram(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                   resolution: float = FV.GRID_RESOLUTION) -> DataFrame:
    """Sparse 2-D histogram ``(i, j, n)`` over occupied cells only."""
    ext = extent_values(df, lat, lon, resolution)
    return (assign_cells(df.select(lat, lon), ext, lat, lon)
            .groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")))


def cell_threshold(cells: DataFrame, pct: float = FV.HOT_PERCENTILE) -> DataFrame:
    """One row: exact linear-interpolated percentile of counts, and the max."""
    return cells.agg(F.percentile(F.col("n"), F.lit(pct)).alias("threshold"),
                     F.max("n").alias("max_n"))


def _cell_place_category_counts(df: DataFrame, extent, lat: str, lon: str,
                                place: str | None, category: str | None) -> DataFrame:
    p = F.col(place) if place else F.lit(None).cast("string")
    c = F.col(category) if category else F.lit(None).cast("string")
    base = assign_cells(df.select(lat, lon, p.alias("place"), c.alias("category")),
                        extent, lat, lon)
    # partial + final aggregate; the result is far smaller than the incidents
    return base.groupBy("i", "j", "place", "category").agg(F.count(F.lit(1)).alias("n"))


def hotspot_frames(df: DataFrame, *, as_of: str | None = None, days: int = FV.PREDICTION_DAYS,
                   resolution: float = FV.GRID_RESOLUTION, pct: float = FV.HOT_PERCENTILE,
                   lat: str = "latitude", lon: str = "longitude",
                   place: str | None = "location_name", category: str | None = "category",
                   ts: str | None = "date") -> tuple[DataFrame, DataFrame]:
    """Hot cells and their category shares (long form).

    Returns ``(hotspots, hotspot_types)``:

    * ``hotspot_id, i, j, n, lat, lon, location, risk_score, start, end``
    * ``hotspot_id, category, share``

    ``as_of`` is the first day of the prediction window; when omitted it is
    the day of the latest incident. ``end = as_of + days``.

    A phased job: (1) the one-row extent is fetched; (2) the incidents are
    aggregated once to ``(i, j, place, category) -> n`` and checkpointed to
    the shared folder (the raw table is not read again); (3) the one-row
    threshold/max is fetched from that aggregate; (4) hot cells, modal place
    and shares are computed from the checkpoint.
    """
    place = place if place in df.columns else None
    category = category if category in df.columns else None
    ts = ts if ts and ts in df.columns else None
    ext = extent_values(df, lat, lon, resolution, ts=ts if as_of is None else None)
    g = materialize(_cell_place_category_counts(df, ext, lat, lon, place, category))

    cells = g.groupBy("i", "j").agg(F.sum("n").alias("n"))
    stats = cell_threshold(cells, pct).first()
    thr = F.lit(stats["threshold"]).cast("double")
    top = F.lit(stats["max_n"]).cast("bigint")
    hot = cells.filter(F.col("n") >= thr).withColumn("max_n", top)

    by_place = (g.filter(F.col("place").isNotNull())
                .groupBy("i", "j", "place").agg(F.sum("n").alias("pn"))
                .groupBy("i", "j")
                .agg(F.min_by("place", F.struct((-F.col("pn")).alias("k"), F.col("place")))
                     .alias("location")))
    by_cat = (g.filter(F.col("category").isNotNull())
              .groupBy("i", "j", "category").agg(F.sum("n").alias("cn")))

    if as_of is None:
        start = F.lit(ext.get("last_day")).cast("date") if ts else F.current_date()
    else:
        start = F.lit(as_of).cast("date")
    hid = F.concat(F.lit("hotspot_"), F.col("i").cast("string"), F.lit("_"),
                   F.col("j").cast("string"))
    hot = cell_centres(hot, ext)
    hotspots = (hot.join(by_place, ["i", "j"], "left")
                .select(hid.alias("hotspot_id"), "i", "j", "n", "lat", "lon",
                        F.coalesce("location", F.lit(FV.UNKNOWN_LOCATION)).alias("location"),
                        round_half_even(F.col("n") / F.col("max_n"), 2).alias("risk_score"),
                        F.date_format(start, "yyyy-MM-dd").alias("start"),
                        F.date_format(F.date_add(start, days), "yyyy-MM-dd").alias("end")))
    types = (hot.select("i", "j", "n").join(by_cat, ["i", "j"], "inner")
             .select(hid.alias("hotspot_id"), "category",
                     round_half_even(F.col("cn") / F.col("n"), 2).alias("share")))
    return hotspots, types


def hotspots(df: DataFrame, **kw) -> DataFrame:
    """Flat hot-cell table (see :func:`hotspot_frames`)."""
    return hotspot_frames(df, **kw)[0]


def hotspots_nested(df: DataFrame, **kw) -> DataFrame:
    """Hotspot records in document form: ``hotspot_id, location,
    coordinates{lat,lon}, prediction{risk_score, crime_types, timeframe}``.

    ``crime_types`` is a map over the categories present in the cell (a closed
    vocabulary), built per hotspot after the shares are computed.
    """
    hs, types = hotspot_frames(df, **kw)
    m = (types.groupBy("hotspot_id")
         .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "share"))))
              .alias("crime_types")))
    return (hs.join(m, "hotspot_id", "left")
            .select("hotspot_id", "location",
                    F.struct(F.col("lat"), F.col("lon")).alias("coordinates"),
                    F.struct(F.col("risk_score"),
                             F.coalesce("crime_types", F.create_map().cast("map<string,double>"))
                             .alias("crime_types"),
                             F.struct(F.col("start"), F.col("end")).alias("timeframe"))
                    .alias("prediction")))


def hotspot_members(df: DataFrame, *, resolution: float = FV.GRID_RESOLUTION,
                    pct: float = FV.HOT_PERCENTILE, lat: str = "latitude",
                    lon: str = "longitude", id_col: str = "incident_id") -> DataFrame:
    """Incidents that fall in a hot cell: the per-cell range lookup rewritten
    as an equi-join on the computed ``(i, j)``."""
    ext = extent_values(df, lat, lon, resolution)
    cells = assign_cells(df.select(id_col, lat, lon), ext, lat, lon)
    counts = cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    thr = cell_threshold(counts, pct).first()["threshold"]
    hot = counts.filter(F.col("n") >= F.lit(thr).cast("double"))
    hid = F.concat(F.lit("hotspot_"), F.col("i").cast("string"), F.lit("_"),
                   F.col("j").cast("string"))
    return cells.join(hot, ["i", "j"], "left_semi").select(hid.alias("hotspot_id"), id_col)
