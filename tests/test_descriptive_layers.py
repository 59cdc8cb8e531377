"""Descriptive sections and map-layer frames on hand-made rows."""

import datetime as dt

import pytest

from vigil.operators import descriptive as D
from vigil.operators import layers as L

SCHEMA = ("incident_id long, date timestamp, category string, location_name string, latitude double, "
          "longitude double, description string, source string")


def _rows(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, t(1, 10), "theft", "A", 1.0, 2.0, "x" * 250, "S"),      # Monday
            (2, t(1, 10), "theft", "B", 1.0, 2.0, "", None),
            (3, t(2, 11), "murder", "A", None, None, None, "S"),        # Tuesday
            (4, t(8, 10), None, None, 3.0, 4.0, "short", "S")]          # Monday
    return spark.createDataFrame(rows, SCHEMA)


def test_summary_sections(spark):
    s = {(r.section, r.key): r.n for r in D.analysis_summary(_rows(spark), k=1).collect()}
    assert s[("total_incidents", None)] == 4
    assert s[("by_category", "theft")] == 2 and ("by_category", None) not in s
    assert [k for (sec, k) in s if sec == "top_locations"] == ["A"]          # top-1, ties by name
    assert s[("hourly_distribution", "10")] == 3
    assert s[("daily_distribution", "Monday")] == 3
    doc = D.summary_document(D.analysis_summary(_rows(spark))).first()
    assert doc.total_incidents == 4 and doc.by_category == {"theft": 2, "murder": 1}


def test_amplifiers_and_shares(spark):
    amp = {(r.dimension, r.key): r.risk_score for r in D.risk_amplifiers(_rows(spark)).collect()}
    assert amp[("hourly", "10")] == 1.0 and amp[("hourly", "11")] == pytest.approx(1 / 3)
    assert amp[("category", "theft")] == 0.5 and amp[("category", "murder")] == 0.25
    assert amp[("location", "B")] == 0.5
    empty = D.risk_amplifiers(_rows(spark).limit(0))
    assert empty.count() == 0


def test_popups_markers_and_center(spark):
    p = {r.incident_id: r for r in L.popup_records(_rows(spark)).collect()}
    assert p[1].description == "x" * 200 + "..."
    assert p[2].description == "No description available" and p[2].source == "Unknown Source"
    assert p[4].category == "Unknown Category" and p[4].location == "Unknown Location"
    m = {r.incident_id: r.marker for r in L.incident_markers(_rows(spark)).collect()}
    assert m == {1: "blue", 2: "blue", 4: "red"}            # null coordinates are not drawn
    c = L.map_center(_rows(spark)).first()
    assert c.center_lat == pytest.approx(5 / 3)
