"""Distance joins between points (incidents) and targets (hotspot centres).

The distance join is rewritten from "every point against every target" into
an equi-join on a uniform bucket grid:

* each target is replicated into the 3×3 buckets around its own bucket;
* a point meets only the targets replicated into its bucket.

With bucket size ``B``, every target within distance ``B`` of a point is
guaranteed to meet it. The join keys are bucket coordinates, so a dense
bucket meets at most the targets of a 3B×3B square on the build side; the
probe side is streamed (AQE splits a skewed probe partition or turns the join
into a broadcast join when the target side measures small).

The great-circle join (``within_km``) has latitude bands instead, each cut
into bins of longitude whose width follows the latitude and that close into a
ring: the date line and the poles are no special places.

The nearest target is found by branch and bound over cells (``nearest``), in
degrees or, for great circles, on the points of the sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions.geo import EARTH_RADIUS_KM, earth_point, euclidean, floor_bin, haversine_km, on_earth, valid_point
from vigil.session import materialize


def _neighbourhood(targets: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    """Targets replicated into the 3×3 buckets around their own bucket."""
    offs = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return (targets.filter(valid_point(lat, lon))
            .withColumn("_di", F.explode(offs)).withColumn("_dj", F.explode(offs))
            .withColumn("_bi", floor_bin(lat, size) + F.col("_di"))
            .withColumn("_bj", floor_bin(lon, size) + F.col("_dj"))
            .drop("_di", "_dj"))


def _bucketed(points: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    return (points.withColumn("_bi", floor_bin(lat, size))
            .withColumn("_bj", floor_bin(lon, size)))


def within_distance(points: DataFrame, targets: DataFrame, *, max_dist: float = FV.HIT_DISTANCE,
                    how: str = "semi", lat: str = "latitude", lon: str = "longitude",
                    t_lat: str = "lat", t_lon: str = "lon") -> DataFrame:
    """Points with (``semi``) / without (``anti``) a target strictly closer
    than ``max_dist`` (planar degrees). Points with missing coordinates are
    never within distance, so they appear in the ``anti`` result."""
    assert how in ("semi", "anti")
    t = _neighbourhood(targets.select(F.col(t_lat).alias("_tlat"), F.col(t_lon).alias("_tlon")),
                       "_tlat", "_tlon", max_dist)
    p = _bucketed(points, lat, lon, max_dist)
    cond = ((p["_bi"] == t["_bi"]) & (p["_bj"] == t["_bj"])
            & (euclidean(p[lat], p[lon], t["_tlat"], t["_tlon"]) < F.lit(max_dist)))
    return p.join(t, cond, "left_semi" if how == "semi" else "left_anti").drop("_bi", "_bj")


def _reach(lat: Column, rho: float) -> Column:
    """Degrees of longitude, to either side, that a circle of ``rho`` radians
    around a point of this latitude (in radians) covers; 180 around a pole."""
    return F.when(F.abs(lat) + rho >= math.pi / 2, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(math.sin(rho)) / F.cos(lat), F.lit(1.0)))))


def _ring_bins(band: Column, size: float, rho: float) -> Column:
    """Bins of longitude of a latitude band: about as wide as a circle's reach there."""
    top = F.radians(F.greatest(F.abs(band), F.abs(band + 1)) * size)
    return F.greatest(F.lit(1), F.floor(360 / _reach(top, rho))).cast("bigint")


def within_km(points: DataFrame, targets: DataFrame, *, max_km: float, how: str = "semi", lat: str = "latitude",
              lon: str = "longitude", t_lat: str = "lat", t_lon: str = "lon") -> DataFrame:
    """Points with (``semi``) / without (``anti``) a target whose great-circle
    distance is less than ``max_km``.

    A target is copied into the bins its circle meets in three latitude bands
    (about nine; at most a dozen a band next to a pole). Longitudes wrap;
    points with missing coordinates or a latitude beyond a pole are never
    within distance, such targets are never met.
    """
    assert how in ("semi", "anti")
    rho = min(max_km / EARTH_RADIUS_KM, math.pi) * (1 + 1e-9) + 1e-15
    size = math.degrees(rho)
    t = (targets.select(F.col(t_lat).cast("double").alias("_tlat"), F.col(t_lon).cast("double").alias("_tlon"))
         .filter(on_earth("_tlat", "_tlon"))
         .withColumn("_band", F.explode(F.array(*[floor_bin("_tlat", size) + k for k in (-1, 0, 1)])))
         .withColumn("_bins", _ring_bins(F.col("_band"), size, rho)))
    side = _reach(F.radians("_tlat"), rho) * (1 + 1e-9) + 1e-9
    # the circle's first and last bin, on a ring that is not yet closed
    first, last = (F.floor((F.pmod(F.col("_tlon") + 180, F.lit(360.0)) + s * side) * F.col("_bins") / 360).cast("bigint") for s in (-1, 1))
    ring = F.when(last - first + 1 >= F.col("_bins"), F.sequence(F.lit(0).cast("bigint"), F.col("_bins") - 1)).otherwise(
        F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.col("_bins"))))
    t = t.withColumn("_bin", F.explode(ring)).drop("_bins")
    band = floor_bin(lat, size)
    bins = _ring_bins(band, size, rho)
    own = F.least(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) * bins / 360).cast("bigint"), bins - 1)
    placed = on_earth(lat, lon)
    p = points.withColumn("_pband", F.when(placed, band)).withColumn("_pbin", F.when(placed, own))
    cond = ((p["_pband"] == t["_band"]) & (p["_pbin"] == t["_bin"])
            & (haversine_km(p[lat], p[lon], t["_tlat"], t["_tlon"]) < F.lit(float(max_km))))
    return p.join(t, cond, "left_semi" if how == "semi" else "left_anti").drop("_pband", "_pbin")


#: Cells of a level that one cell of the next coarser one holds, per axis.
_FAN_BITS = 2
#: Cells of the great-circle search, in km.
CELL_KM = 5.0


def _axes(df: DataFrame, prefix: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit())


def _names(prefix: str, axes: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(axes)]


def _box(at: list[str], low: str, high: str) -> list[Column]:
    return [f(c).alias(f"{n}{k}") for k, c in enumerate(at) for n, f in ((low, F.min), (high, F.max))]


def _least_and_most(axes: int) -> tuple[Column, Column]:
    """Least and greatest distance between a point of box ``pl..ph`` and one of
    box ``tl..th``."""
    least = most = F.lit(0.0)
    for k in range(axes):
        pl, ph, tl, th = (F.col(f"{n}{k}") for n in ("pl", "ph", "tl", "th"))
        gap = F.greatest(F.lit(0.0), tl - ph, pl - th)
        span = F.greatest(ph - tl, th - pl)
        least, most = least + gap * gap, most + span * span
    return F.sqrt(least), F.sqrt(most)


def candidate_cells(point_cells: DataFrame, target_cells: DataFrame, depth: int, slack: float = 1e-12) -> DataFrame:
    """``p0.., t0..``: for each cell of points the target cells that can hold
    the nearest target of one of its points.

    Branch and bound, cell against cell: from the root of a pyramid of target
    cells, every kept cell is replaced by its children; a child goes when its
    least distance exceeds the smallest greatest distance of all children of
    the cell of points (some target is that close to each of its points) by
    more than ``slack``. ``point_cells`` (p0..) and ``target_cells`` (t0.., from 0 on)
    carry the bounding boxes of what they hold (pl0, ph0.. and tl0, th0..).
    """
    cell = _axes(point_cells, "p")
    axes = len(cell)
    kept = cell + _names("pl", axes) + _names("ph", axes)
    at, child, target = _names("a", axes), _names("c", axes), _names("t", axes)
    now = point_cells.select(*kept, *[F.lit(0).cast("bigint").alias(c) for c in at])
    boxes = [f(f"{n}{k}").alias(f"{n}{k}") for k in range(axes) for n, f in (("tl", F.min), ("th", F.max))]
    bound = Window.partitionBy(*cell)
    for level in reversed(range(depth)):
        down = target_cells.groupBy(*[F.shiftright(t, _FAN_BITS * level).alias(c) for t, c in zip(target, child, strict=True)]).agg(*boxes)
        least, most = _least_and_most(axes)
        now = (now.join(down, [F.col(a) == F.shiftright(c, _FAN_BITS) for a, c in zip(at, child, strict=True)])
               .withColumn("least", least).withColumn("bound", F.min(most).over(bound))
               # a hair's breadth for rounding
               .filter(F.col("least") <= F.col("bound") * (1 + 1e-9) + slack)
               .select(*kept, *[F.col(c).alias(a) for a, c in zip(at, child, strict=True)]))
    return now.select(*cell, *[F.col(a).alias(t) for a, t in zip(at, target, strict=True)])


def _celled(pts: DataFrame, tgt: DataFrame, axes: int, size: float, slack: float):
    """Points (x0..) and targets (y0..) with their cells, and the candidate
    cells; None without targets. One aggregate row (the targets' extent) is fetched."""
    x, y, p, t = (_names(n, axes) for n in "xypt")
    pts = materialize(pts.select("*", *[floor_bin(c, size).alias(n) for c, n in zip(x, p, strict=True)]))
    extent = tgt.agg(*[f(c) for c in y for f in (F.min, F.max)]).first()
    if extent[0] is None:
        return pts, tgt, None
    tgt = materialize(tgt.select("*", *[F.floor((F.col(c) - F.lit(low)) / F.lit(size)).cast("bigint").alias(n)
                                        for c, low, n in zip(y, extent[0::2], t, strict=True)]))
    cells = int(max(high - low for low, high in zip(extent[0::2], extent[1::2], strict=True)) / size) + 1
    depth = max(1, -(-cells.bit_length() // _FAN_BITS))
    leaves = materialize(tgt.groupBy(*t).agg(*_box(y, "tl", "th")))
    return pts, tgt, candidate_cells(pts.groupBy(*p).agg(*_box(x, "pl", "ph")), leaves, depth, slack)


def _searched(points: DataFrame, targets: DataFrame, id_col: str, target_id: str, lat: str, lon: str, t_lat: str, t_lon: str,
              size: float | None, metric: str):
    """Points and targets with their cells, the candidate cells (None without
    targets), the number of axes and the distance to a target at (lat, lon)."""
    assert metric in ("planar", "great_circle")
    p_at = [F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")]
    t_at = [F.col(t_lat).cast("double").alias("_tlat"), F.col(t_lon).cast("double").alias("_tlon")]
    if metric == "planar":
        valid, axes, of, slack = valid_point, 2, lambda a, b: [F.col(a), F.col(b)], 1e-12
        dist = lambda a, b: euclidean("_lat", "_lon", a, b)
        size = size or FV.HIT_DISTANCE
    else:
        valid, axes, of, slack = on_earth, 3, earth_point, 1e-8
        # equal to the micrometre is equal
        dist = lambda a, b: F.round(haversine_km("_lat", "_lon", a, b), 9)
        size = size or CELL_KM
    pts = points.select(id_col, *p_at).filter(valid("_lat", "_lon"))
    pts = pts.select("*", *[c.alias(n) for c, n in zip(of("_lat", "_lon"), _names("x", axes), strict=True)])
    tgt = targets.select(target_id, *t_at).filter(valid("_tlat", "_tlon"))
    tgt = tgt.select("*", *[c.alias(n) for c, n in zip(of("_tlat", "_tlon"), _names("y", axes), strict=True)])
    return *_celled(pts, tgt, axes, size, slack), axes, dist


def nearest_pairs(points: DataFrame, targets: DataFrame, *, id_col: str = "incident_id", target_id: str = "hotspot_id",
                  lat: str = "latitude", lon: str = "longitude", t_lat: str = "lat", t_lon: str = "lon",
                  size: float | None = None, metric: str = "planar") -> DataFrame:
    """``id, target_id, dist`` of every point and every target of its candidate
    cells; the nearest target is among them."""
    pts, tgt, cells, axes, dist = _searched(points, targets, id_col, target_id, lat, lon, t_lat, t_lon, size, metric)
    if cells is None:
        none = F.lit(None).cast(tgt.schema[target_id].dataType)
        return pts.select(id_col, none.alias(target_id), F.lit(0.0).alias("dist")).filter(F.lit(False))
    return (pts.join(materialize(cells), _names("p", axes)).join(tgt, _names("t", axes))
            .select(id_col, target_id, dist("_tlat", "_tlon").alias("dist")))


def nearest(points: DataFrame, targets: DataFrame, *, id_col: str = "incident_id",
            target_id: str = "hotspot_id", lat: str = "latitude", lon: str = "longitude",
            t_lat: str = "lat", t_lon: str = "lon", base: float | None = None, metric: str = "planar") -> DataFrame:
    """Exact nearest target per point: ``id, target_id, dist``; ties go to the
    smaller id. Points without valid coordinates are left out. ``metric`` is
    "planar" (degrees) or "great_circle" (km, to the micrometre).

    Points and targets are put into cells of ``base``; only the targets of a
    point cell's candidate cells are measured, however far away they lie, so
    the work follows the points, not points times targets. A cell's targets
    travel as one array: a point has a row for each candidate cell, which
    holds the best of it, not one for each target.
    """
    pts, tgt, cells, axes, dist = _searched(points, targets, id_col, target_id, lat, lon, t_lat, t_lon, base, metric)
    if cells is None:
        none = F.lit(None).cast(tgt.schema[target_id].dataType)
        return pts.select(id_col, none.alias(target_id), F.lit(0.0).alias("dist")).filter(F.lit(False))
    held = tgt.groupBy(*_names("t", axes)).agg(F.collect_list(F.struct(F.col(target_id).alias("id"), "_tlat", "_tlon")).alias("_targets"))
    best = F.array_min(F.transform("_targets", lambda t: F.struct(dist(t["_tlat"], t["_tlon"]).alias("dist"), t["id"].alias("id"))))
    return (pts.join(materialize(cells.join(held, _names("t", axes))), _names("p", axes))
            .select(id_col, best.alias("m")).groupBy(id_col).agg(F.min("m").alias("m"))
            .select(id_col, F.col("m.id").alias(target_id), F.col("m.dist").alias("dist")))
