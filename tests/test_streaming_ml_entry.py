"""Streaming (late data, restart, state), ML behaviour, and the driver entry."""

import os

import pytest
from pyspark.sql import functions as F

from paths import SF001
from vigil.operators import learn as M
from vigil.streaming import jobs as S


def _write(spark, rows, path):
    spark.createDataFrame(rows, "incident_id long, date timestamp, category string").write.mode("append").parquet(path)


def test_late_row_dropped_across_restart(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    base = os.path.join(tmp_dir, "job")
    import datetime as dt
    t = lambda h: dt.datetime(2024, 1, 1, h)
    _write(spark, [(1, t(1), "theft"), (2, t(1), "theft")], src + "/p1")

    def run():
        stream = spark.readStream.schema("incident_id long, date timestamp, category string").parquet(src + "/*")
        counts = (stream.withWatermark("date", "1 hour").dropDuplicatesWithinWatermark(["incident_id"])
                  .groupBy(F.window("date", "1 hour").alias("w"), "category").agg(F.count("*").alias("n"))
                  .select(F.date_format("w.start", "HH").alias("h"), "category", "n"))
        return S.run_available(counts, name="late", mode="append", base=base)

    run()
    # a later batch moves the watermark far ahead; then a late row and a duplicate arrive
    _write(spark, [(3, t(10), "theft")], src + "/p2")
    run()
    _write(spark, [(4, t(1), "theft"), (3, t(10), "theft"), (5, t(12), "theft")], src + "/p3")
    res = {r.h: r.n for r in run().collect()}
    assert res.get("01") == 2          # the late row for 01:00 never counted
    assert "10" in res and res["10"] == 1   # duplicate of id 3 dropped


def _backlog(spark, tmp_dir, days=(20, 1, 9, 4)):
    """Incidents landed in one file a day, newest not last; two a trigger would hide the order."""
    import datetime as dt
    src, rows = os.path.join(tmp_dir, "src"), []
    for f, d in enumerate(days):
        part = [(100 * f + h, dt.datetime(2024, 1, d, h, 30), ("theft", "murder")[h % 2], 40.0 + h / 50, h / 70) for h in range(0, 24, 3)]
        rows += part
        spark.createDataFrame(part, "incident_id long, date timestamp, category string, latitude double, longitude double") \
            .coalesce(1).write.mode("append").parquet(src)
    schema = "incident_id long, date timestamp, category string, latitude double, longitude double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    return rows, stream, spark.read.schema(schema).parquet(src)


def test_backlog_out_of_order_loses_nothing(spark, tmp_dir):
    rows, stream, table = _backlog(spark, tmp_dir)
    panes, dropped = S.pane_counts(stream, pane="1 hour", keys=["category"], name="backlog", base=tmp_dir + "/job")
    want = table.groupBy(F.date_trunc("hour", "date").alias("pane_start"), "category").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, panes.collect())) == sorted(map(tuple, want.collect())) and dropped.count() == 0
    slid = S.windows_of(panes, keys=["category"], duration="1 day", slide="1 hour")
    direct = table.groupBy(F.window("date", "1 day", "1 hour").getField("start").alias("w"), "category").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, slid.collect())) == sorted(map(tuple, direct.collect()))
    # a second run over the same sources counts nothing twice
    again, _ = S.pane_counts(stream, pane="1 hour", keys=["category"], name="backlog", base=tmp_dir + "/job")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_counted_apart(spark, tmp_dir):
    rows, stream, table = _backlog(spark, tmp_dir)
    panes, dropped = S.pane_counts(stream, pane="1 day", keys=["category"], name="late", lateness="12 days", base=tmp_dir + "/job")
    total = lambda df: {(r.pane_start.day, r.category): r.n for r in df.collect()}
    kept, gone = total(panes), total(dropped)
    every = {(d, c): 4 for d in (1, 4, 9, 20) for c in ("theft", "murder")}
    assert sum(kept.values()) + sum(gone.values()) == len(rows)
    assert {**kept, **gone} == every and not kept.keys() & gone.keys() and {k[0] for k in kept} >= {9, 20} and gone
    assert {k[0] for k in gone} <= {1, 4}


def test_rows_without_a_time_are_dropped_and_counted(spark, tmp_dir):
    schema = "date timestamp, category string"
    spark.sql("select timestamp'1969-12-31 23:10:00' as date, 'a' as category union all select null, 'a' union all select null, null") \
        .write.parquet(tmp_dir + "/src")
    stream = spark.readStream.schema(schema).parquet(tmp_dir + "/src")
    panes, dropped = S.pane_counts(stream, pane="1 hour", keys=["category"], name="nulls", base=tmp_dir + "/job")
    assert [(str(r.pane_start), r.category, r.n) for r in panes.collect()] == [("1969-12-31 23:00:00", "a", 1)]
    assert sorted((str(r.pane_start), str(r.category), r.n) for r in dropped.collect()) == [("None", "None", 1), ("None", "a", 1)]


def test_retried_batch_replaces_its_rows(spark, tmp_dir):
    rows, stream, table = _backlog(spark, tmp_dir)
    args = dict(pane="1 day", keys=["category"], name="retry", base=tmp_dir + "/job")
    S.pane_counts(stream, **args)
    # the last batch is committed again, as after a crash between the write and the commit
    commits = sorted((f for f in os.listdir(tmp_dir + "/job/checkpoint/commits") if f.isdigit()), key=int)
    os.remove(f"{tmp_dir}/job/checkpoint/commits/{commits[-1]}")
    crc = f"{tmp_dir}/job/checkpoint/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    panes, _ = S.pane_counts(stream, **args)
    assert sum(r.n for r in panes.collect()) == len(rows)


def test_grid_windows_roll_up_from_daily_panes(spark, tmp_dir):
    rows, stream, table = _backlog(spark, tmp_dir)
    got = S.rolling_grid_counts(stream, name="grid", base=tmp_dir + "/job")
    cells = S.grid_events(table)
    want = cells.groupBy(F.window("date", "7 days", "1 day").getField("start").alias("w"), "i", "j").agg(F.count("*").alias("n")) \
        .select(F.date_format("w", "yyyy-MM-dd"), "i", "j", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recent_effectiveness_survives_restarts_without_python(spark, tmp_dir):
    import datetime as dt
    schema = "intervention_type string, record_id long, implementation_date timestamp, before_incidents long, after_incidents long"
    src, base = tmp_dir + "/fu", tmp_dir + "/job"
    rows = [("ab"[k % 2], k, dt.datetime(2024, 1, 1 + (k * 7) % 28), 10, k % 10) for k in range(24)]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for part in (rows[:8], rows[8:16], rows[16:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = S.recent_effectiveness_table(stream(), name="fu", base=base)
    for r in out.collect():
        mine = sorted(((d, i, max(0.0, 1 - a / b)) for t, i, d, b, a in rows if t == r.intervention_type), reverse=True)[:5]
        assert r.recent == pytest.approx(sum(v for _, _, v in mine) / 5) and r.seen == 12
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()


def test_stateful_last5_matches_batch(spark, tmp_dir):
    import pandas as pd
    rows = [(k % 3 == 0 and "a" or "b", k, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)).to_pydatetime(), k % 7, k % 5)
            for k in range(40)]
    df = spark.createDataFrame(rows, "intervention_type string, record_id long, implementation_date timestamp, "
                                     "before_incidents long, after_incidents long")
    path = os.path.join(tmp_dir, "fu")
    df.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.recent_effectiveness_table(stream, name="st6")
    got = {r.intervention_type: (r.recent, r.seen) for r in out.collect()}
    from vigil.operators import interventions as I
    t = df.withColumn("effectiveness", I.tracker_effectiveness("before_incidents", "after_incidents"))
    exp = {r.intervention_type: r.recent for r in I.latest_recent_effectiveness(t).collect()}
    for k in exp:
        assert got[k][0] == pytest.approx(exp[k])
    assert sum(v[1] for v in got.values()) == 40


def test_classifier_beats_majority_on_planted_signal(spark):
    import datetime as dt
    rows = []
    for k in range(800):
        violent = k % 2 == 0
        rows.append((k, dt.datetime(2024, 1, 1 + k % 28, 22 if violent else 9), "murder" if violent else "theft",
                     "P" + str(k % 4), 1.0 + (0.5 if violent else 0.0) + (k % 10) / 100, 2.0, "s"))
    df = spark.createDataFrame(rows, "incident_id long, date timestamp, category string, location_name string, "
                                     "latitude double, longitude double, source string")
    f = M.feature_frame(df)
    train, test = M.hash_split(f)
    for kind in ("logreg", "rf"):
        acc = M.accuracy(M.train_violent(train, kind).transform(test))
        assert acc > 0.9


def test_split_follows_the_id_alone(spark):
    import hashlib
    df = spark.range(2000).withColumnRenamed("id", "incident_id")
    df = df.unionByName(spark.createDataFrame([(None,), (7,)], "incident_id long"))
    train, test = M.hash_split(df.repartition(5))
    kept = [r[0] for r in train.collect()]
    want = [k for k in [*range(2000), 7] if int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:8], 16) % 100 < 80]
    assert sorted(k for k in kept if k is not None) == sorted(want) and None in kept
    assert len(kept) + test.count() == 2002


def test_transfer_stages_and_model_roundtrip(spark, tmp_dir):
    import datetime as dt
    rows = [(k, dt.datetime(2024, 1, 1 + k % 20, k % 24), "murder" if k % 3 else "theft", "P", 1.0 + k % 7, 2.0, "s")
            for k in range(300)]
    df = spark.createDataFrame(rows, "incident_id long, date timestamp, category string, location_name string, "
                                     "latitude double, longitude double, source string")
    f = M.feature_frame(df)
    feats, model, stages = M.transfer_train(f, [f.limit(100)], base_iter=5, tune_iter=3)
    assert [s[0] for s in stages] == ["base", "fine_tune_1", "retune_own"]
    path = os.path.join(tmp_dir, "model")
    m = M.train_violent(f, "logreg")
    M.save_model(m, path)
    assert M.load_model(path).transform(f).count() == f.count()


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert "hotspots" in o
