"""Registered streaming jobs, each run to completion (availableNow) over
the landed tables and compared with the equivalent batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.plans.ingest import KEYWORDS, TERMS, ctes
from vigil.plans.registry import query
from vigil.plans.sql_bindings import FOLLOW_UP, INCIDENTS, VALIDATION_HISTORY
from vigil.sources import bindings as B
from vigil.sources.tables import read_table
from vigil.streaming import jobs as S

_W = f"with inc as ({INCIDENTS})"


def _incident_stream(spark, sf):
    ev = S.table_stream(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return B.incidents_from(ev, read_table(spark, sf, "nation", "n_nationkey", "n_name"))


def _shown(counts, start, *columns):
    return counts.select(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"), *(columns or ("category", "n")))


@query("stream_hourly_counts", f"""{_W} select strftime(date_trunc('hour', date), '%Y-%m-%d %H:%M:%S') as window_start,
category, count(*) as n from inc group by 1, 2""")
def q_stream_hourly(spark, sf):
    return _shown(S.pane_counts(_incident_stream(spark, sf), pane="1 hour", keys=["category"], name="hourly")[0], "pane_start")


@query("stream_daily_counts", f"""{_W} select strftime(date_trunc('day', date), '%Y-%m-%d %H:%M:%S') as window_start,
category, count(*) as n from inc group by 1, 2""")
def q_stream_daily(spark, sf):
    return _shown(S.pane_counts(_incident_stream(spark, sf), pane="1 day", keys=["category"], name="daily")[0], "pane_start")


@query("stream_sliding_counts", f"""{_W}, x as (select category, date_trunc('hour', date) - to_hours(k) as ws
from inc, (select unnest(range(0, 24)) as k) r)
select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, category, count(*) as n from x group by 1, 2""")
def q_stream_sliding(spark, sf):
    panes, _ = S.pane_counts(_incident_stream(spark, sf), pane="1 hour", keys=["category"], name="sliding")
    return _shown(S.windows_of(panes, keys=["category"], duration="1 day", slide="1 hour"), "window_start")


@query("stream_grid_counts", f"""{_W}, x as (select cast(floor(latitude/0.01e0) as bigint) as i,
cast(floor(longitude/0.01e0) as bigint) as j, date_trunc('day', date) - to_days(k) as ws
from inc, (select unnest(range(0, 7)) as k) r where latitude is not null and longitude is not null)
select strftime(ws, '%Y-%m-%d') as window_start, i, j, count(*) as n from x group by 1, 2, 3""")
def q_stream_grid(spark, sf):
    return S.rolling_grid_counts(_incident_stream(spark, sf), name="grid")


@query("stream_dedup_fanout", f"with {ctes()} select article_id, category, relevance from fan")
def q_stream_dedup(spark, sf):
    s = S.dedup_fanout_stream(S.article_stream(spark, sf), TERMS)
    return S.run_available(s, name="dedup", mode="append")


@query("stream_incident_build", f"""with {ctes()} select f.article_id, strftime(w.published_at, '%Y-%m-%d') as date,
w.title, w.description, f.category, l.location_name, g.latitude, g.longitude, coalesce(w.source_name, 'Unknown') as source
from fan f join loc l on l.article_id = f.article_id join gaz g on g.gram = lower(l.location_name)
join win w on w.article_id = f.article_id""")
def q_stream_incidents(spark, sf):
    t = S.incident_stream_transform(B.gazetteer(spark), TERMS, KEYWORDS)
    return S.run_available(S.article_stream(spark, sf), name="incidents", mode="append", transform=t)


@query("stream_recent_effectiveness", f"""with fu as ({FOLLOW_UP}),
trk as (select intervention_type, record_id, implementation_date,
        case when before_incidents > 0 then greatest(0e0, 1e0 - after_incidents*1e0/before_incidents) else 0.5e0 end as e from fu)
select intervention_type, round(avg(e) filter (where rn <= 5), 6) as recent, count(*) as seen from (
select *, row_number() over (partition by intervention_type order by implementation_date desc, record_id desc) as rn from trk) z
group by intervention_type""")
def q_stream_recent(spark, sf):
    o = S.table_stream(spark, sf, "orders", maxFilesPerTrigger=1)
    fu = o.select(F.col("o_orderkey").alias("record_id"),
                  F.substring("o_orderpriority", 1, 1).alias("p"), "o_orderdate", "o_custkey")
    fu = fu.select("record_id",
                   F.when(F.col("p") == "1", "police_patrol").when(F.col("p") == "2", "community_outreach")
                   .when(F.col("p") == "3", "environmental_modification")
                   .when(F.col("p") == "4", "public_awareness").otherwise("targeted_enforcement")
                   .alias("intervention_type"),
                   F.col("o_orderdate").alias("implementation_date"),
                   (F.col("record_id") % 20).alias("before_incidents"),
                   (F.col("o_custkey") % 15).alias("after_incidents"))
    return S.recent_effectiveness_table(fu, name="recent").select("intervention_type", F.round("recent", 6).alias("recent"), "seen")


@query("stream_validation_history", f"""with vh as ({VALIDATION_HISTORY}) select run_no,
round(prediction_accuracy, 9) as prediction_accuracy, round(false_positive_rate, 9) as false_positive_rate from vh""")
def q_stream_history(spark, sf):
    o = S.table_stream(spark, sf, "orders")
    r = S.run_available(S.validation_history_stream(o), name="history", keys=["run_no"])
    return r.select("run_no", F.round(F.col("finished") / F.col("n"), 9).alias("prediction_accuracy"),
                    F.round(F.col("urgent") / F.col("n"), 9).alias("false_positive_rate"))


@query("stream_spike_feed", f"""{_W}, x as (select category, date_trunc('hour', date) - to_hours(k) as ws
from inc, (select unnest(range(0, 24)) as k) r),
c as (select ws, category, count(*) as n from x group by 1, 2),
d as (select category, cast(date as date) as day, count(*) as n from inc group by 1, 2),
b as (select category, avg(n) as mean, stddev_samp(n) as sd from d group by 1)
select strftime(c.ws, '%Y-%m-%d %H:%M:%S') as window_start, c.category, c.n, round(b.mean, 6) as mean,
round(b.sd, 6) as sd, coalesce(c.n > b.mean + 3e0*b.sd, false) as alert
from c left join b on b.category = c.category""")
def q_stream_spike_feed(spark, sf):
    panes, _ = S.pane_counts(_incident_stream(spark, sf), pane="1 hour", keys=["category"], name="spikes")
    r = _shown(S.spike_feed(panes, keys=["category"]), "window_start", "category", "n", "mean", "sd", "alert")
    return r.select("window_start", "category", "n", F.round("mean", 6).alias("mean"),
                    F.round("sd", 6).alias("sd"), "alert")


@query("stream_hot_cells", f"""{_W}, x as (select cast(floor(latitude/0.01e0) as bigint) as i,
cast(floor(longitude/0.01e0) as bigint) as j, date_trunc('day', date) - to_days(k) as ws
from inc, (select unnest(range(0, 7)) as k) r where latitude is not null and longitude is not null),
c as (select strftime(ws, '%Y-%m-%d') as window_start, i, j, count(*) as n from x group by 1, 2, 3),
t as (select window_start, quantile_cont(n, 0.75) as threshold from c group by 1)
select c.window_start, c.i, c.j, c.n from c join t on t.window_start = c.window_start where c.n >= t.threshold""")
def q_stream_hot_cells(spark, sf):
    return S.hot_window_cells(S.rolling_grid_counts(_incident_stream(spark, sf), name="grid_hot"))
