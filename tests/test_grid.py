"""Hotspot grid: numpy edge parity, percentile threshold, micro fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF01
from vigil.operators import grid
from vigil.sources import bindings as B

SCHEMA = "incident_id long, date timestamp, category string, location_name string, latitude double, longitude double"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _numpy_cells(lat, lon, r):
    lat_bins = np.arange(min(lat) - r, max(lat) + r, r)
    lon_bins = np.arange(min(lon) - r, max(lon) + r, r)
    H, _, _ = np.histogram2d(lat, lon, bins=[lat_bins, lon_bins])
    return {(int(i), int(j)): int(H[i, j]) for i, j in zip(*np.nonzero(H))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sparse_histogram_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    lat = np.round(rng.uniform(-1, 1, n), 3 + seed % 2)
    lon = np.round(rng.uniform(10, 11, n), 2 + seed % 2)
    rows = [(k, None, "theft", "x", float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))]
    got = {(r.i, r.j): r.n for r in grid.grid_histogram(_df(spark, rows)).collect()}
    assert got == _numpy_cells(lat, lon, 0.01)


def test_point_on_last_edge_is_counted(spark):
    # lattice data whose maximum falls on an edge
    lat = [0.0, 0.01, 0.02, 0.03]
    lon = [0.0, 0.0, 0.0, 0.0]
    rows = [(k, None, "theft", "x", a, b) for k, (a, b) in enumerate(zip(lat, lon))]
    got = {(r.i, r.j): r.n for r in grid.grid_histogram(_df(spark, rows)).collect()}
    assert got == _numpy_cells(lat, lon, 0.01)
    assert sum(got.values()) == sum(_numpy_cells(lat, lon, 0.01).values())


def test_one_incident_one_hot_cell(spark):
    hs = grid.hotspots(_df(spark, [(1, None, "theft", "A", 10.0, 20.0)]), as_of="2024-01-01").collect()
    assert len(hs) == 1 and hs[0].risk_score == 1.0 and hs[0].location == "A"
    assert (hs[0].start, hs[0].end) == ("2024-01-01", "2024-01-08")


def test_percentile_threshold(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 10)], "i long, j long, n long")
    row = grid.cell_threshold(cells).first()
    assert row.threshold == pytest.approx(4.75) and row.max_n == 10


def test_empty_input_gives_empty_output(spark):
    assert grid.hotspots(_df(spark, []), as_of="2024-01-01").count() == 0


def test_modal_location_ties_to_smallest_name(spark):
    rows = [(1, None, "theft", "B", 1.0, 1.0), (2, None, "theft", "A", 1.0, 1.0),
            (3, None, "assault", "A", 1.0, 1.0), (4, None, "assault", "B", 1.0, 1.0)]
    hs, types = grid.hotspot_frames(_df(spark, rows), as_of="2024-01-01")
    assert hs.first().location == "A"
    assert sorted((r.category, r.share) for r in types.collect()) == [("assault", 0.5), ("theft", 0.5)]


def test_known_answers_sf001(spark):
    hs = grid.hotspots(B.incidents(spark, SF01), as_of="2024-01-31").orderBy("i", "j")
    rows = hs.collect()
    assert len(rows) == 352
    assert [(r.i, r.j, r.n, r.risk_score) for r in rows[:3]] == [
        (1, 1, 21, 0.62), (1, 20, 18, 0.53), (1, 23, 12, 0.35)]


def test_members_are_exactly_hot_cell_incidents(spark):
    inc = B.incidents(spark, SF01)
    members = grid.hotspot_members(inc)
    hot = grid.hotspots(inc, as_of="2024-01-31")
    total = hot.agg(F.sum("n")).first()[0]
    assert members.count() == total
