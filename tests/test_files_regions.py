"""Sources/sinks (CSV quoting, encodings, append logs) and region upkeep."""

import json
import os

from pyspark.sql import functions as F

from vigil.operators import regions as R
from vigil.sources import files


def test_csv_quoted_newlines_and_doubled_quotes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "inc.csv")
    with open(p, "w") as f:
        f.write("date,title,description,category,location_name,latitude,longitude,source\n")
        f.write('2024-01-01T10:00:00Z,"A ""quoted"" title","line one\nline two",theft,Here,1.5,2.5,Wire\n')
        f.write('2024-01-02T11:00:00Z,plain,,assault,There,3.0,4.0,Desk\n')
        f.write('2024-01-03T12:00:00Z,"multi\n\nline",x,murder,Else,5.0,6.0,"Src, Inc"\n')
    df = files.read_incident_csv(spark, p)
    rows = df.orderBy("date").collect()
    assert len(rows) == 3
    assert rows[0].title == 'A "quoted" title' and rows[0].description == "line one\nline two"
    assert rows[2].source == "Src, Inc"
    out = os.path.join(tmp_dir, "inc_out")
    files.write_incidents(df, out)
    assert spark.read.parquet(out).count() == 3


def test_json_any_encoding(spark, tmp_dir):
    doc = {"total_incidents": 3, "by_category": {"théft": 2}}
    for name, enc in (("a.json", "utf-8"), ("b.json", "utf-16"), ("c.json", "latin-1")):
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(json.dumps(doc, ensure_ascii=False).encode(enc))
    got = files.read_json_any_encoding(spark, tmp_dir + "/*.json",
                                       "total_incidents long, by_category map<string,long>").collect()
    assert len(got) == 3
    assert all(r.doc.total_incidents == 3 and r.doc.by_category == {"théft": 2} for r in got)


def test_corrupt_json_is_a_row_not_a_failure(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "bad.json"), "w") as f:
        f.write("{not json")
    df = files.read_json_document(spark, tmp_dir + "/bad.json",
                                  files.T.StructType([files.T.StructField("x", files.T.LongType())]))
    rows = df.select("x", "_corrupt_record").collect()
    assert len(rows) == 1 and rows[0].x is None and rows[0]._corrupt_record == "{not json"


def test_tracking_append_keeps_history(spark, tmp_dir):
    from vigil.operators import interventions as I
    rec = spark.createDataFrame([(1, "h1", "police_patrol", "2024-01-01", 0.5, 10, 5, "")], files.TRACKING_SCHEMA)
    p = os.path.join(tmp_dir, "tracking")
    assert files.read_tracking(spark, p).count() == 0
    files.append_tracking(rec, p)
    files.append_tracking(rec.withColumn("record_id", F.lit(2).cast("long")).withColumn("effectiveness", F.lit(1.0)), p)
    got = {r.record_id: r.recent for r in I.recent_effectiveness(files.read_tracking(spark, p)).collect()}
    assert got == {1: 0.5, 2: 0.75}


def test_missing_inputs_have_defaults(spark, tmp_dir):
    gone = os.path.join(tmp_dir, "gone")
    assert files.read_validation_runs(spark, gone).count() == 0
    assert files.read_json_document(spark, gone + ".json", files.T.StructType(
        [files.T.StructField("x", files.T.LongType())])).count() == 0
    assert R.load_similarity(spark, gone).first().similar_regions == ["global"]
    run = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, 0.5, False, None)], files.VALIDATION_RUN_SCHEMA)
    files.append_validation_runs(run, gone)
    files.append_validation_runs(run, gone)
    assert files.read_validation_runs(spark, gone).count() == 2


def test_spikes_look_back_over_calendar_days(spark):
    import datetime as dt
    day = dt.date(2024, 1, 1)
    counts = spark.createDataFrame([("x", "t", day + dt.timedelta(k), n) for k, n in ((0, 7), (2, 7), (20, 5))],
                                   "location_name string, category string, day date, n long")
    got = {r.day.day: (r.mean, r.alert) for r in R.spike_alerts(counts).collect()}
    assert got == {1: (None, False), 3: (1.0, False), 21: (None, False)}


def test_region_upsert_idempotent_and_parse(spark):
    cur = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.5), ("b", "a", 1.0)],
                                "region string, similar_region string, weight double")
    new = spark.createDataFrame([("a", "d", 0.9)], "region string, similar_region string, weight double")
    once = sorted(R.upsert_regions(cur, new).collect())
    twice = sorted(R.upsert_regions(R.upsert_regions(cur, new), new).collect())
    assert once == twice and len(once) == 2
    form = spark.createDataFrame([("x", "r1\n r2 \n\n", "0.8\n0.6\n0.5")], "region string, regions_text string, weights_text string")
    p = R.parse_region_form(form).first()
    assert p.similar_regions == ["r1", "r2"] and p.weights == [0.8, 0.6, 0.5] and p.valid is False
    docs = R.region_docs(cur)
    assert sorted(R.region_edges(docs).collect()) == sorted(cur.collect())
    assert R.default_similarity(spark).first().similar_regions == ["global"]


def test_landed_articles_prune_by_day(spark, tmp_dir):
    import datetime as dt
    from vigil.operators import extraction as X
    rows = [(k, dt.datetime(2024, 1, 1 + k % 10, 12), "t", "d", "en", ("s",)) for k in range(50)]
    df = spark.createDataFrame(rows, "article_id long, published_at timestamp, title string, description string, "
                                     "lang string, source struct<name:string>")
    p = os.path.join(tmp_dir, "landed")
    files.land_articles(df, p)
    win = X.article_window(files.read_landed_articles(spark, p), start="2024-01-03", end="2024-01-04")
    assert win.count() == 10
    plan = win._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_day" in plan


def test_parse_and_haversine(spark):
    from vigil.functions import geo, temporal
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("not a date",)], "s string")
    got = [r[0] for r in df.select(temporal.parse_ts("s")).collect()]
    assert got[0] is not None and got[1] is None
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(d - 111.19) < 0.1


def test_recommendations_partitioned_by_band(spark, tmp_dir):
    from vigil.operators import interventions as I
    hs = spark.createDataFrame([("h1", "X", 0.9), ("h2", "Y", 0.5), ("h3", "Z", 0.1)],
                               "hotspot_id string, location string, risk_score double")
    ty = spark.createDataFrame([("h1", "theft", 1.0)], "hotspot_id string, category string, share double")
    p = os.path.join(tmp_dir, "recs")
    files.write_recommendations(I.recommendations(hs, ty), p)
    assert {"risk_level=high", "risk_level=medium", "risk_level=low"} <= set(os.listdir(p))
    high = spark.read.parquet(p).filter(F.col("risk_level") == "high")
    assert high.count() == 2
    assert "PartitionFilters: [isnotnull(risk_level" in high._jdf.queryExecution().executedPlan().toString()
