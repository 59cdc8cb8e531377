"""Validation metrics: micro fixtures, bucketed joins vs brute force, known run."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF01
from vigil.operators import grid, spatial
from vigil.operators import validation as V
from vigil.sources import bindings as B

HS = "hotspot_id string, i long, j long, lat double, lon double, risk_score double"
ACT = "incident_id long, latitude double, longitude double, category string"


def test_distance_exactly_threshold_is_not_a_hit(spark):
    hs = spark.createDataFrame([("h", 0, 0, 0.0, 0.0, 1.0)], HS)
    act = spark.createDataFrame([(1, 0.05, 0.0, "theft"), (2, 0.049, 0.0, "theft")], ACT)
    assert V.spatial_accuracy(hs, act).first()[0] == pytest.approx(0.5)


def test_null_coordinates_count_but_never_hit(spark):
    hs = spark.createDataFrame([("h", 0, 0, 0.0, 0.0, 1.0)], HS)
    act = spark.createDataFrame([(1, 0.0, 0.0, "theft"), (2, None, None, "theft")], ACT)
    assert V.spatial_accuracy(hs, act).first()[0] == pytest.approx(0.5)
    misses = spatial.within_distance(act, hs, how="anti").select("incident_id").collect()
    assert [r[0] for r in misses] == [2]


def test_no_hotspots(spark):
    hs = spark.createDataFrame([], HS)
    act = spark.createDataFrame([(1, 0.0, 0.0, "theft")], ACT)
    assert V.spatial_accuracy(hs, act).first()[0] == 0.0
    assert V.false_positive_rate(hs, act).first()[0] == 1.0


def test_correlation_edge_cases(spark):
    act = spark.createDataFrame([(1, 0.001, 0.001, "t"), (2, 0.021, 0.001, "t"), (3, 0.021, 0.001, "t")], ACT)
    const = spark.createDataFrame([("a", 0, 0, 0.001, 0.001, 0.5), ("b", 0, 1, 0.021, 0.001, 0.5)], HS)
    assert V.risk_correlation(const, act).first()[0] == 0.0
    neg = spark.createDataFrame([("a", 0, 0, 0.001, 0.001, 0.9), ("b", 0, 1, 0.021, 0.001, 0.1)], HS)
    assert V.risk_correlation(neg, act).first()[0] == 0.0
    one = spark.createDataFrame([(1, 0.001, 0.001, "t")], ACT)
    assert V.risk_correlation(neg, one).first()[0] == 0.0


def test_two_hotspots_in_one_cell_last_wins(spark):
    hs = spark.createDataFrame([("a", 1, 1, 0.0011, 0.0011, 0.2), ("b", 1, 2, 0.0012, 0.0012, 0.9)], HS)
    act = spark.createDataFrame([(1, 0.001, 0.001, "t")], ACT)
    assert V.risk_grid(hs, act).first().predicted_risk == 0.9


def test_bucketed_semi_join_equals_naive(spark):
    rng = np.random.default_rng(7)
    pts = [(k, float(a), float(b), "t") for k, (a, b) in enumerate(rng.uniform(0, 0.5, (500, 2)))]
    tg = [(f"h{k}", 0, k, float(a), float(b), 0.5) for k, (a, b) in enumerate(rng.uniform(0, 0.5, (60, 2)))]
    act, hs = spark.createDataFrame(pts, ACT), spark.createDataFrame(tg, HS)
    for d in (0.01, 0.05):
        naive = {p[0] for p in pts if any(math.hypot(p[1] - t[3], p[2] - t[4]) < d for t in tg)}
        got = {r[0] for r in spatial.within_distance(act, hs, max_dist=d).select("incident_id").collect()}
        assert got == naive


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(k, float(a), float(b), "t") for k, (a, b) in enumerate(rng.uniform(0, 3, (300, 2)))]
    tg = [(f"h{k:02d}", 0, k, float(a), float(b), 0.5) for k, (a, b) in enumerate(rng.uniform(1, 1.2, (10, 2)))]
    got = {r.incident_id: (r.hotspot_id, r.dist) for r in
           spatial.nearest(spark.createDataFrame(pts, ACT), spark.createDataFrame(tg, HS)).collect()}
    assert len(got) == len(pts)
    for p in pts:
        best = min(((math.hypot(p[1] - t[3], p[2] - t[4]), t[0]) for t in tg))
        assert got[p[0]][0] == best[1] and got[p[0]][1] == pytest.approx(best[0])


def test_known_validation_run_sf001(spark):
    train, actual = B.train_actual(spark, SF01)
    hs, types = grid.hotspot_frames(train, as_of="2024-01-24")
    assert hs.count() == 349
    r = V.validation_run(hs, types, actual).first()
    assert r.spatial_accuracy == pytest.approx(1.0)
    assert r.type_accuracy == pytest.approx(0.998714, abs=1e-6)
    assert r.risk_correlation == pytest.approx(0.107675, abs=1e-6)
    assert r.false_positive_rate == pytest.approx(0.335244, abs=1e-6)
    assert r.overall_accuracy == pytest.approx(0.787625, abs=1e-6)
    assert r.passed is True


def test_improvement_rules(spark):
    runs = spark.createDataFrame([(1, 0.8, 0.3), (2, 0.9, 0.3), (3, 0.7, 0.1)],
                                 "run_no long, prediction_accuracy double, false_positive_rate double")
    res = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.1), ("b", 0.1), ("b", 0.2)],
                                "type string, effectiveness double")
    rules = {(r.rule, r.subject): r.message for r in V.improvement_rules(runs, res).collect()}
    assert ("accuracy_decline", "model") in rules
    assert ("low_effectiveness", "a") not in rules            # only 2 results
    assert rules[("low_effectiveness", "b")].startswith("The 'b' intervention has low effectiveness (0.13)")
    assert ("high_false_positive_rate", "model") not in rules  # exactly 2 runs


def test_effectiveness_rules_both_formulas(spark):
    from vigil.operators.interventions import tracker_effectiveness, validator_effectiveness
    df = spark.createDataFrame([(10, 5), (0, 3), (5, 10)], "b long, a long")
    got = df.select(tracker_effectiveness("b", "a").alias("t"), validator_effectiveness("b", "a").alias("v")).collect()
    assert [(r.t, r.v) for r in got] == [(0.5, 0.5), (0.5, 0.0), (0.0, 0.0)]
    assert F is not None


def _scatter(spark, n_points, n_targets, far, seed):
    import random
    r = random.Random(seed)
    pts = [(k, 40 + far + r.random(), -far + r.random()) for k in range(n_points)] + [(10 ** 6, 40.5, 0.5), (10 ** 6 + 1, None, 1.0)]
    tgt = [(f"h{k:04d}", 40 + r.randrange(50) / 100, r.randrange(50) / 100) for k in range(n_targets)]
    return pts, tgt, spark.createDataFrame(pts, "incident_id long, latitude double, longitude double"), \
        spark.createDataFrame(tgt, "hotspot_id string, lat double, lon double")


def test_nearest_of_far_points_meets_few_targets(spark):
    import math
    pts, tgt, points, targets = _scatter(spark, 2000, 349, 7.0, 1)
    pairs = spatial.nearest_pairs(points, targets).count()
    assert pairs < 0.1 * len(pts) * len(tgt)
    want = {i: min((math.sqrt((a - x) ** 2 + (b - y) ** 2), t) for t, x, y in tgt) for i, a, b in pts if a is not None}
    got = {r.incident_id: (r.dist, r.hotspot_id) for r in spatial.nearest(points, targets).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-12 for i in want)


@pytest.mark.parametrize(("n_targets", "far"), [(1, 0.0), (3, 300.0), (200, 0.1)])
def test_nearest_of_points_all_around(spark, n_targets, far):
    import math
    pts, tgt, points, targets = _scatter(spark, 150, n_targets, far, n_targets)
    got = {r.incident_id: (r.dist, r.hotspot_id) for r in spatial.nearest(points, targets, base=0.02).collect()}
    for i, a, b in pts:
        if a is not None:
            d, t = min((math.sqrt((a - x) ** 2 + (b - y) ** 2), t) for t, x, y in tgt)
            assert got[i][1] == t and abs(got[i][0] - d) < 1e-9


def test_nearest_without_points_or_targets(spark):
    _, _, points, targets = _scatter(spark, 5, 5, 0.0, 9)
    assert spatial.nearest(points, targets.limit(0)).count() == 0
    assert spatial.nearest(points.limit(0), targets).count() == 0


def _km(a, b, c, d):
    p, q, dl = math.radians(a), math.radians(c), math.radians(d) - math.radians(b)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1.0)))


def _around(lat, lon, spread, n, seed):
    """Points about a place; longitudes spread with the latitude and wrap past 180 or not, as they come."""
    rng = np.random.default_rng(seed)
    wide = spread / max(math.cos(math.radians(lat)), 0.01)
    return [(float(np.clip(lat + a, -90, 90)), float(lon + b)) for a, b in zip(rng.uniform(-spread, spread, n), rng.uniform(-wide, wide, n), strict=True)]


@pytest.mark.parametrize(("lat", "lon"), [(60.0, 10.0), (0.0, 180.0), (-65.0, -180.0), (89.7, 30.0), (-90.0, 0.0)])
def test_great_circle_joins_equal_brute_force(spark, lat, lon):
    pts = [(k, *p) for k, p in enumerate(_around(lat, lon, 0.5, 150, 1))]
    # the same places from the other side of the date line
    tgt = [(f"h{k:03d}", a, b - 360 if k % 2 else b) for k, (a, b) in enumerate(_around(lat, lon, 0.5, 40, 2))]
    odd = [(1000, None, lon), (1001, lat, None), (1002, 91.0, lon), (1003, float("nan"), lon)]
    points = spark.createDataFrame(pts + odd, "incident_id long, latitude double, longitude double")
    targets = spark.createDataFrame([*tgt, ("bad", None, 1.0), ("far", 95.0, lon)], "hotspot_id string, lat double, lon double")
    for km in (2.0, 15.0, 9000.0):
        want = {i for i, a, b in pts if any(_km(a, b, x, y) < km for _, x, y in tgt)}
        got = [r[0] for r in spatial.within_km(points, targets, max_km=km).select("incident_id").collect()]
        assert sorted(got) == sorted(want)
        left = [r[0] for r in spatial.within_km(points, targets, max_km=km, how="anti").select("incident_id").collect()]
        assert sorted(left) == sorted({i for i, *_ in pts + odd} - want)
    got = {r.incident_id: (r.dist, r.hotspot_id) for r in spatial.nearest(points, targets, metric="great_circle").collect()}
    assert got.keys() == {i for i, *_ in pts}
    for i, a, b in pts:
        d, t = min((round(_km(a, b, x, y), 8), t) for t, x, y in tgt)
        assert got[i][0] == pytest.approx(d, abs=1e-7) and got[i][1] == t


def test_great_circle_targets_are_copied_few_times(spark):
    targets = spark.range(500).selectExpr("cast(id as string) as hotspot_id", "id * 179.9 / 500 - 89.95 as lat", "id * 7.3 as lon")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "incident_id long, latitude double, longitude double")
    far = spatial.nearest_pairs(points, targets, metric="great_circle").count()
    assert far < 50
    hits = spatial.within_km(points, targets.limit(0), max_km=1.0)
    assert hits.count() == 0 and spatial.within_km(points, targets.limit(0), max_km=1.0, how="anti").count() == 1


def test_history_of_stamped_runs(spark, tmp_dir):
    import os

    from vigil.sources import files
    path = os.path.join(tmp_dir, "history")
    hs = spark.createDataFrame([("h", 0, 0, 0.0, 0.0, 1.0)], HS)
    types = spark.createDataFrame([("h", "theft", 1.0)], "hotspot_id string, category string, share double")
    act = spark.createDataFrame([(1, 0.0, 0.0, "theft"), (2, 9.0, 0.0, "theft")], ACT)

    def run(ts, rows):
        files.put_validation_run(V.validation_run(hs, types, rows, run_ts=ts), path)
        series = V.accuracy_series(files.read_validation_runs(spark, path), order="ts", value="spatial_accuracy")
        return [(r.run_number, str(r.ts)[:10], r.value) for r in series.orderBy("run_number").collect()]

    assert run("2024-01-02 00:00:00", act) == [(1, "2024-01-02", 0.5)]
    assert run("2024-01-01 00:00:00", act) == [(1, "2024-01-01", 0.5), (2, "2024-01-02", 0.5)]
    assert run("2024-01-01 00:00:00", act.limit(0)) == [(1, "2024-01-01", 0.0), (2, "2024-01-02", 0.5)]


def test_trend_over_many_runs(spark):
    runs = spark.createDataFrame([(k, (k * 37 % 101) / 101, None if k % 5 == 0 else 0.1) for k in range(300)],
                                 "run_no long, prediction_accuracy double, false_positive_rate double")
    got = {r.run_no: (r.value_2_before, r.declining) for r in V.accuracy_trend(runs).collect()}
    acc = [(k * 37 % 101) / 101 for k in range(300)]
    assert got == {k: (acc[k - 2], acc[k - 2] > acc[k]) if k > 1 else (None, False) for k in range(300)}
    fpr = {r.run_no: (r.run_number, r.value) for r in V.fpr_series(runs).collect()}
    assert fpr == {k: (k + 1, 1.0 if k % 5 == 0 else 0.1) for k in range(300)}


@pytest.mark.parametrize("metric", ["planar", "great_circle"])
def test_nearest_aggregates_a_row_for_each_cell_not_each_target(spark, metric):
    points = spark.createDataFrame([(1, 40.001, 0.001), (1, 40.001, 0.001), (2, 41.0, 0.0)], "incident_id long, latitude double, longitude double")
    targets = spark.createDataFrame([(f"h{k:03d}", 40.0 + k * 1e-5, 0.0) for k in range(200)], "hotspot_id string, lat double, lon double")
    near = spatial.nearest(points, targets, metric=metric)
    assert "array_min" in near._jdf.queryExecution().optimizedPlan().toString()
    assert {r.incident_id: r.hotspot_id for r in near.collect()} == {1: "h100", 2: "h199"}
