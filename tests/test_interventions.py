"""Banding, rule lookup, scoring and the distributed trailing mean."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paths import SF01
from vigil.operators import interventions as I
from vigil.operators.sequence import rank_within
from vigil.sources import bindings as B

HS = "hotspot_id string, location string, risk_score double"
TY = "hotspot_id string, category string, share double"
AMP = "dimension string, key string, incident_count long, risk_score double"


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.7,), (0.4,), (0.39,)], "s double")
    assert [r[0] for r in df.select(I.risk_band("s")).collect()] == ["high", "medium", "low"]


def test_unknown_type_gets_default_pair_and_no_peaks(spark):
    hs = spark.createDataFrame([("h1", "X", 0.5)], HS)
    ty = spark.createDataFrame([("h1", "robbery", 1.0)], TY)
    amp = spark.createDataFrame([("hourly", "3", 1, 0.5)], AMP)
    recs = I.recommendations(hs, ty, amp).orderBy("ord").collect()
    assert [r.type for r in recs] == ["police_patrol", "community_outreach"]
    assert recs[0].priority == "medium" and recs[0].effectiveness == pytest.approx(0.75 * 0.8)


def test_peak_rule_adds_targeted_enforcement(spark):
    hs = spark.createDataFrame([("h1", "X", 0.9)], HS)
    ty = spark.createDataFrame([("h1", "theft", 1.0)], TY)
    amp = spark.createDataFrame([("hourly", "13", 5, 1.0), ("hourly", "3", 4, 0.8),
                                 ("daily", "Monday", 5, 1.0), ("daily", "Friday", 1, 0.2)], AMP)
    recs = I.recommendations(hs, ty, amp).orderBy("ord").collect()
    assert [r.type for r in recs] == ["police_patrol", "environmental_modification", "targeted_enforcement"]
    assert recs[2].specific_actions == ["Focus resources during peak hours: 3, 13",
                                        "Increase coverage on high-risk days: Monday"]


def test_history_blend(spark):
    hs = spark.createDataFrame([("h1", "X", 0.5)], HS)
    ty = spark.createDataFrame([("h1", "assault", 1.0)], TY)
    hist = spark.createDataFrame([("police_patrol", 0.4)], "intervention_type string, recent double")
    r = I.recommendations(hs, ty, None, hist).filter(F.col("type") == "police_patrol").first()
    assert r.effectiveness == pytest.approx(0.5)


def test_primary_type_ties_and_empty(spark):
    hs = spark.createDataFrame([("h1", "X", 0.5), ("h2", "Y", 0.1)], HS)
    ty = spark.createDataFrame([("h1", "theft", 0.5), ("h1", "assault", 0.5)], TY)
    recs = {r.hotspot_id: r.primary_crime_type for r in I.recommendations(hs, ty).collect()}
    assert recs == {"h1": "assault", "h2": "unknown"}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_rank_and_trailing_mean_match_pandas(spark, parts):
    rng = np.random.default_rng(parts)
    n = 600
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
                        "t": rng.integers(0, 50, n), "id": np.arange(n),
                        "v": rng.uniform(0, 1, n)})
    df = spark.createDataFrame(pdf)
    ranked = rank_within(df, "k", ["t", "id"], partitions=parts).toPandas()
    exp = pdf.sort_values(["k", "t", "id"]).assign(seq=lambda d: d.groupby("k").cumcount() + 1)
    assert dict(zip(ranked.id, ranked.seq)) == dict(zip(exp.id, exp.seq))
    from vigil.operators.sequence import trailing_mean
    tm = trailing_mean(df, "k", ["t", "id"], "v", 5, id_col="id", block_rows=7 * parts).toPandas()
    exp["m"] = exp.groupby("k")["v"].transform(lambda s: s.rolling(5, min_periods=1).mean())
    got = dict(zip(tm.id, tm.trailing_mean))
    for i, m in zip(exp.id, exp.m):
        assert got[i] == pytest.approx(m)


def test_latest_recent_known_answers(spark):
    t = I.tracking_records(B.follow_up(spark, SF01))
    got = {r.intervention_type: r.recent for r in I.latest_recent_effectiveness(t).collect()}
    exp = {"community_outreach": 0.331838, "environmental_modification": 0.286576,
           "police_patrol": 0.400877, "public_awareness": 0.173333, "targeted_enforcement": 0.490833}
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_exact_quantiles_match_numpy(spark):
    from vigil.operators.sequence import exact_quantiles
    rng = np.random.default_rng(11)
    n = 700
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
                        "id": np.arange(n), "v": np.round(rng.uniform(0, 1, n), 2)})
    got = {(r.k, r.q): r.quantile for r in
           exact_quantiles(spark.createDataFrame(pdf), "k", "v", [0.25, 0.5, 0.75], id_col="id").collect()}
    for k, grp in pdf.groupby("k"):
        for q in (0.25, 0.5, 0.75):
            assert got[(k, q)] == pytest.approx(np.percentile(grp["v"], q * 100))
