"""Environment factors, text dates, two-level documents, sparse one-hot, model sets."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from vigil.functions import temporal as T
from vigil.operators import descriptive as D
from vigil.operators import learn as M
from vigil.operators import validation as V


def test_environment_factors_are_listed_by_impact(spark):
    ext = spark.createDataFrame([(1, {"lighting": 0.5, "poverty": 0.9}), (2, {"lighting": 0.1}), (3, {"noise": None}), (4, None)],
                                "id int, factors map<string, double>")
    got = [(r.factor, r.value) for r in D.environment_factors(ext).orderBy(F.desc("value"), "factor").collect()]
    assert got == [("poverty", 0.9), ("lighting", pytest.approx(0.3))]
    inc = spark.createDataFrame([], "date timestamp, location_name string, category string")
    amp = D.risk_amplifiers(inc, external=D.environment_factors(ext)).collect()
    assert {(r.dimension, r.key) for r in amp if r.dimension == "environment"} == {("environment", "poverty"), ("environment", "lighting")}


@pytest.mark.parametrize(("text", "want"), [
    ("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"), ("2024-02-03 04:05:06", "2024-02-03 04:05:06"),
    (" 03/02/2024 04:05 ", "2024-02-03 04:05:00"), ("2024-02-03", "2024-02-03 00:00:00"),
    ("2024-13-03", None), ("soon", None), ("", None), (None, None)])
def test_text_dates(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(F.date_format(T.parse_text_date("t"), "yyyy-MM-dd HH:mm:ss").alias("d")).first()
    assert row.d == want


def test_two_level_follow_up_documents(spark):
    rows = [(k, f"h{k % 3}", "patrol" if k % 2 else None, k % 5, 1) for k in range(40)]
    fu = spark.createDataFrame(rows, "record_id long, hotspot_id string, intervention_type string, before_incidents long, after_incidents long")
    docs = V.follow_up_document(fu, records=16)
    assert docs.count() == 3
    deep = docs.select(F.from_json("document", V.FOLLOW_UP_TYPE).alias("d")).selectExpr("explode(d)").selectExpr("size(value) as n")
    assert deep.agg(F.min("n")).first()[0] > 1
    bad = docs.unionByName(spark.createDataFrame([(9, "{broken"), (10, None)], "part long, document string"))
    got = {(r.hotspot_id, int(r.intervention_id), r.type, r.effectiveness) for r in V.explode_follow_up(bad).collect()}
    odd = spark.createDataFrame([(1, None, "a", 2, 1), (1, None, "a", 2, 1), (None, "h", "a", 2, 1)], fu.schema)
    assert [(r.hotspot_id, r.intervention_id) for r in V.explode_follow_up(V.follow_up_document(odd)).collect()] == [("unknown", "1")]
    want = {(r.hotspot_id, r.intervention_id, r.type, r.effectiveness) for r in V.intervention_results(fu).collect()}
    assert got == want


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "b", "y")], "incident_id long, place string, source string")
    got = sorted(map(tuple, M.one_hot_long(df, ["place", "source"]).collect()))
    assert got == [(1, "place", 1), (1, "source", 0), (2, "place", 0), (3, "source", 0), (4, "place", 1), (4, "source", 1)]
    levels = {(r.column, r.level): (r.n, r.level_id) for r in M.one_hot_levels(df, ["place", "source"]).collect()}
    assert levels == {("place", "a"): (1, 0), ("place", "b"): (2, 1), ("source", "x"): (2, 0), ("source", "y"): (1, 1)}


def test_model_set_loads_what_exists(spark, tmp_dir):
    import datetime as dt
    rows = [(k, dt.datetime(2024, 1, 1 + k % 28, k % 24), ("murder", "theft")[k % 2], f"p{k % 3}", 1.0 * (k % 7), 2.0, "s") for k in range(60)]
    f = M.feature_frame(spark.createDataFrame(rows, "incident_id long, date timestamp, category string, location_name string, "
                                                    "latitude double, longitude double, source string"))
    path, names = os.path.join(tmp_dir, "models"), ["violent", "baseline", "other"]
    assert not M.load_models(spark, path, names)
    model = M.train_violent(f, "logreg")
    M.save_models({"violent": model, "baseline": model}, path)
    assert set(M.load_models(spark, path, names)) == {"violent", "baseline"}
    shutil.rmtree(os.path.join(path, "baseline"))
    loaded = M.load_models(spark, path, names)
    assert set(loaded) == {"violent"} and loaded["violent"].transform(f).count() == 60
