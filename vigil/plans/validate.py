"""Registered validation queries (train/actual time split, FIXTURES.md).

Hotspots are predicted on incidents before 2024-01-24 and validated against
the incidents from that day on. The DuckDB oracles use brute-force pairs
(every incident against every hotspot), independent of the bucketed joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions.numeric import round6
from vigil.operators import grid, spatial
from vigil.operators import validation as V
from vigil.plans.registry import query
from vigil.plans.sql_bindings import ACTUAL, FOLLOW_UP, TRAIN, VALIDATION_HISTORY, hotspot_sql
from vigil.session import checkpoint_dir
from vigil.sources import bindings as B
from vigil.sources import files

TRAIN_AS_OF = "2024-01-24"
FINE = 0.005
#: Of the great-circle queries, in km.
HIT_KM = 0.4
#: Days whose runs the stored history holds.
RUN_DAYS = ("2024-01-23", TRAIN_AS_OF)

_BASE = f"""with {hotspot_sql(TRAIN, as_of=TRAIN_AS_OF)},
act as ({ACTUAL}),
ag as (select cast(trunc(latitude/0.01e0) as bigint) as lat_bin, cast(trunc(longitude/0.01e0) as bigint) as lon_bin,
       count(*) as actual_count from act where latitude is not null and longitude is not null group by 1, 2),
pg as (select lat_bin, lon_bin, risk_score as predicted_risk from (select cast(trunc(lat/0.01e0) as bigint) as lat_bin,
       cast(trunc(lon/0.01e0) as bigint) as lon_bin, risk_score,
       row_number() over (partition by cast(trunc(lat/0.01e0) as bigint), cast(trunc(lon/0.01e0) as bigint)
                          order by i desc, j desc) as rn from hs) z where rn = 1),
rg as (select a.lat_bin, a.lon_bin, a.actual_count, coalesce(p.predicted_risk, 0e0) as predicted_risk
       from ag a left join pg p on p.lat_bin = a.lat_bin and p.lon_bin = a.lon_bin),
pc as (select distinct cast(trunc(lat/0.01e0) as bigint) as lat_bin, cast(trunc(lon/0.01e0) as bigint) as lon_bin from hs),
acs as (select lat_bin, lon_bin from ag),
ac as (select category, count(*) as actual from act where category is not null group by 1),
pm as (select category, sum(share) as predicted from hs_types where category is not null group by 1),
tv as (select coalesce(ac.category, pm.category) as category, coalesce(ac.actual, 0) as actual,
       coalesce(pm.predicted, 0e0) as predicted from ac full outer join pm on ac.category = pm.category)"""


def _pairs(d: str) -> str:
    return f"""hits as (select distinct a.incident_id from act a join hs h
   on sqrt((a.latitude - h.lat)*(a.latitude - h.lat) + (a.longitude - h.lon)*(a.longitude - h.lon)) < {d})"""


def _spatial_sql(d: str) -> str:
    return f"""{_BASE}, {_pairs(d)}
select case when (select count(*) from hs) > 0 and (select count(*) from act) > 0
       then (select count(*) from hits)*1e0/(select count(*) from act) else 0e0 end as spatial_accuracy"""


_TYPE = """case when sum(actual*actual) > 0 and sum(predicted*predicted) > 0
  then sum(actual*predicted)/sqrt(sum(actual*actual)*sum(predicted*predicted)) else 0e0 end"""
_CORR = """case when count(*) >= 2 then greatest(coalesce(covar_pop(actual_count, predicted_risk)
  / nullif(stddev_pop(actual_count)*stddev_pop(predicted_risk), 0e0), 0e0), 0e0) else 0e0 end"""
_FPR = """case when (select count(*) from pc) > 0 then (select count(*) from (select * from pc except select * from acs) z)*1e0
  / (select count(*) from pc) else 1e0 end"""


def _split(spark, sf):
    """Predict on *train*, validate on *actual*. The prediction's cell
    aggregate is checkpointed inside ``hotspot_frames``, so every metric plan
    starts from that short lineage rather than from the raw incidents."""
    train, actual = B.train_actual(spark, sf)
    hs, types = grid.hotspot_frames(train, as_of=TRAIN_AS_OF)
    return hs, types, actual


@query("spatial_accuracy", _spatial_sql("0.05e0"))
def q_spatial(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.spatial_accuracy(hs, act)


@query("spatial_accuracy_fine", _spatial_sql("0.005e0"))
def q_spatial_fine(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.spatial_accuracy(hs, act, max_dist=FINE)


@query("spatial_hits", f"{_BASE}, {_pairs('0.005e0')} select incident_id from hits")
def q_hits(spark, sf):
    hs, _, act = _split(spark, sf)
    return spatial.within_distance(act, hs, max_dist=FINE, how="semi").select("incident_id")


@query("spatial_misses", f"{_BASE}, {_pairs('0.005e0')} select incident_id from act where incident_id not in (select incident_id from hits)")
def q_misses(spark, sf):
    hs, _, act = _split(spark, sf)
    return spatial.within_distance(act, hs, max_dist=FINE, how="anti").select("incident_id")


@query("nearest_hotspot", f"""{_BASE} select incident_id, hotspot_id, round(dist, 9) as dist from (
select a.incident_id, h.hotspot_id,
 sqrt((a.latitude - h.lat)*(a.latitude - h.lat) + (a.longitude - h.lon)*(a.longitude - h.lon)) as dist,
 row_number() over (partition by a.incident_id order by
   sqrt((a.latitude - h.lat)*(a.latitude - h.lat) + (a.longitude - h.lon)*(a.longitude - h.lon)), h.hotspot_id) as rn
from act a cross join hs h where a.latitude is not null and a.longitude is not null) z where rn = 1""")
def q_nearest(spark, sf):
    hs, _, act = _split(spark, sf)
    n = spatial.nearest(act, hs)
    return n.select("incident_id", "hotspot_id", F.round("dist", 9).alias("dist"))


_KM = """round(2*6371.0088e0*asin(sqrt(least(sin((radians(h.lat) - radians(a.latitude))/2)*sin((radians(h.lat) - radians(a.latitude))/2)
  + cos(radians(a.latitude))*cos(radians(h.lat))
  * sin((radians(h.lon) - radians(a.longitude))/2)*sin((radians(h.lon) - radians(a.longitude))/2), 1e0))), 9)"""


@query("great_circle_hits", f"{_BASE} select distinct a.incident_id from act a join hs h on {_KM} < {HIT_KM}e0")
def q_km_hits(spark, sf):
    hs, _, act = _split(spark, sf)
    return spatial.within_km(act, hs, max_km=HIT_KM).select("incident_id")


@query("great_circle_accuracy", f"""{_BASE}, hits as (select distinct a.incident_id from act a join hs h on {_KM} < {HIT_KM}e0)
select case when (select count(*) from hs) > 0 and (select count(*) from act) > 0
       then (select count(*) from hits)*1e0/(select count(*) from act) else 0e0 end as spatial_accuracy""")
def q_km_accuracy(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.spatial_accuracy(hs, act, max_km=HIT_KM)


@query("nearest_hotspot_km", f"""{_BASE} select incident_id, hotspot_id, round(km, 6) as km from (
select incident_id, hotspot_id, km, row_number() over (partition by incident_id order by km, hotspot_id) as rn from (
select a.incident_id, h.hotspot_id, {_KM} as km from act a cross join hs h
where a.latitude is not null and a.longitude is not null) y) z where rn = 1""")
def q_nearest_km(spark, sf):
    hs, _, act = _split(spark, sf)
    n = spatial.nearest(act, hs, metric="great_circle")
    return n.select("incident_id", "hotspot_id", round6("dist").alias("km"))


@query("predicted_type_mass", f"""{_BASE} select category, round(predicted, 6) as mass,
round(predicted/(select sum(predicted) from pm), 6) as normalised from pm""")
def q_type_mass(spark, sf):
    hs, types, _ = _split(spark, sf)
    m = V.predicted_type_mass(types)
    return m.select("category", round6("mass").alias("mass"), round6("normalised").alias("normalised"))


@query("type_vectors", f"{_BASE} select category, actual, round(predicted, 6) as predicted from tv")
def q_type_vectors(spark, sf):
    hs, types, act = _split(spark, sf)
    return V.type_vectors(types, act).withColumn("predicted", round6("predicted"))


@query("type_accuracy", f"{_BASE} select round({_TYPE}, 6) as type_accuracy from tv")
def q_type_accuracy(spark, sf):
    hs, types, act = _split(spark, sf)
    return V.type_accuracy(types, act).select(round6("type_accuracy").alias("type_accuracy"))


@query("actual_grid", f"{_BASE} select * from ag")
def q_actual_grid(spark, sf):
    return V.actual_grid(B.train_actual(spark, sf)[1])


@query("risk_grid", f"{_BASE} select * from rg")
def q_risk_grid(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.risk_grid(hs, act)


@query("risk_correlation", f"{_BASE} select round({_CORR}, 6) as risk_correlation from rg")
def q_risk_corr(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.risk_correlation(hs, act).select(round6("risk_correlation").alias("risk_correlation"))


@query("true_positive_cells", f"{_BASE} select * from pc intersect select * from acs")
def q_tp(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.true_positive_cells(hs, act)


@query("false_positive_cells", f"{_BASE} select * from pc except select * from acs")
def q_fp(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.false_positive_cells(hs, act)


@query("false_positive_rate", f"{_BASE} select round({_FPR}, 6) as false_positive_rate")
def q_fpr(spark, sf):
    hs, _, act = _split(spark, sf)
    return V.false_positive_rate(hs, act).select(round6("false_positive_rate").alias("false_positive_rate"))


_RUN_SQL = f"""{_BASE}, {_pairs('0.05e0')},
m as (select (case when (select count(*) from hs) > 0 and (select count(*) from act) > 0
              then (select count(*) from hits)*1e0/(select count(*) from act) else 0e0 end) as s,
             (select {_TYPE} from tv) as t, (select {_CORR} from rg) as c, {_FPR} as f)
select round(s, 6) as spatial_accuracy, round(t, 6) as type_accuracy, round(c, 6) as risk_correlation,
       round(f, 6) as false_positive_rate, round(0.4e0*s + 0.3e0*t + 0.2e0*c + 0.1e0*(1e0 - f), 6) as overall_accuracy,
       (0.4e0*s + 0.3e0*t + 0.2e0*c + 0.1e0*(1e0 - f)) > 0.7e0 as passed from m"""


@query("validation_run", _RUN_SQL)
def q_validation_run(spark, sf):
    hs, types, act = _split(spark, sf)
    r = V.validation_run(hs, types, act)
    return r.select(*[round6(c).alias(c) for c in ("spatial_accuracy", "type_accuracy",
                                                   "risk_correlation", "false_positive_rate",
                                                   "overall_accuracy")], "passed")


def _stored_sql(day: str) -> str:
    return f"select '{day}' as run, overall_accuracy as value from ({_RUN_SQL.replace(TRAIN_AS_OF, day)}) r_{day[-2:]}"


@query("stored_accuracy_series", f"""select row_number() over (order by run) as run_number, run, value,
0.7e0 as threshold, value <= 0.7e0 as below_threshold from ({' union all '.join(map(_stored_sql, RUN_DAYS))}) runs""")
def q_stored_series(spark, sf):
    """Each day's run is stamped, put into the history and read back from it."""
    history = f"{checkpoint_dir(spark).rstrip('/')}/history/{uuid.uuid4().hex}"
    for day in RUN_DAYS:
        train, actual = B.train_actual(spark, sf, day)
        hs, types = grid.hotspot_frames(train, as_of=day)
        files.put_validation_run(V.validation_run(hs, types, actual, run_ts=f"{day} 00:00:00"), history)
    series = V.accuracy_series(files.read_validation_runs(spark, history), order="ts", value="overall_accuracy")
    return series.select("run_number", F.date_format("ts", "yyyy-MM-dd").alias("run"), round6("value").alias("value"),
                         "threshold", "below_threshold")


@query("overall_accuracy", f"""{_RUN_SQL.rsplit('select round(s, 6)', 1)[0]} select
round(0.4e0*s + 0.3e0*t + 0.2e0*c + 0.1e0*(1e0 - f), 6) as overall_accuracy from m""")
def q_overall(spark, sf):
    return q_validation_run(spark, sf).select("overall_accuracy")


# ---------------------------------------------------------------- interventions

_FU = f"""with fu as ({FOLLOW_UP}),
res as (select hotspot_id, record_id as intervention_id, intervention_type as type,
        case when before_incidents > 0 then least(greatest((before_incidents - after_incidents)*1e0/before_incidents, 0e0), 1e0)
             else 0e0 end as effectiveness, before_incidents, after_incidents from fu)"""


@query("intervention_results", f"{_FU} select * from res")
def q_intervention_results(spark, sf):
    return V.intervention_results(B.follow_up(spark, sf))


@query("follow_up_explode", f"{_FU} select hotspot_id, cast(intervention_id as varchar) as intervention_id, type, effectiveness from res")
def q_follow_up_explode(spark, sf):
    return V.explode_follow_up(V.follow_up_document(B.follow_up(spark, sf)))


@query("avg_effectiveness", f"""{_FU} select type, round(avg(effectiveness), 6) as avg_effectiveness, count(*) as results,
round(avg(effectiveness)*100e0, 6) as avg_effectiveness_pct from res group by type""")
def q_avg_eff(spark, sf):
    a = V.avg_effectiveness(V.intervention_results(B.follow_up(spark, sf)))
    return a.select("type", round6("avg_effectiveness").alias("avg_effectiveness"), "results",
                    round6("avg_effectiveness_pct").alias("avg_effectiveness_pct")
                    ).orderBy(F.desc("avg_effectiveness"), "type")                  # T8


@query("effectiveness_quartiles", f"""{_FU} select type, min(effectiveness) as min,
round(quantile_cont(effectiveness, 0.25), 9) as q1, round(quantile_cont(effectiveness, 0.5), 9) as median,
round(quantile_cont(effectiveness, 0.75), 9) as q3, max(effectiveness) as max from res group by type""")
def q_quartiles(spark, sf):
    q = V.effectiveness_quartiles(V.intervention_results(B.follow_up(spark, sf)))
    return q.select("type", "min", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3")], "max")


# ---------------------------------------------------------------- history

_VH = f"with vh as ({VALIDATION_HISTORY})"


@query("accuracy_series", f"""{_VH} select row_number() over (order by run_no) as run_number, run_no,
prediction_accuracy as value, 0.7e0 as threshold, prediction_accuracy <= 0.7e0 as below_threshold from vh""")
def q_accuracy_series(spark, sf):
    return V.accuracy_series(B.validation_history(spark, sf))


@query("fpr_series", f"""{_VH} select row_number() over (order by run_no) as run_number, run_no,
coalesce(false_positive_rate, 1e0) as value, 0.2e0 as threshold, coalesce(false_positive_rate, 1e0) > 0.2e0 as breach from vh""")
def q_fpr_series(spark, sf):
    return V.fpr_series(B.validation_history(spark, sf))


@query("accuracy_trend", f"""{_VH} select run_no, prediction_accuracy as value,
lag(prediction_accuracy, 2) over (order by run_no) as value_2_before,
coalesce(lag(prediction_accuracy, 2) over (order by run_no) > prediction_accuracy, false) as declining from vh""")
def q_accuracy_trend(spark, sf):
    return V.accuracy_trend(B.validation_history(spark, sf))


@query("validation_flags", f"""{_VH} select run_no, prediction_accuracy > 0.7e0 as passed,
false_positive_rate > 0.2e0 as high_fpr from vh""")
def q_validation_flags(spark, sf):
    return V.validation_flags(B.validation_history(spark, sf))


@query("improvement_rules", f"""{_VH}, {_FU[5:]},
l3 as (select * from vh order by run_no desc limit 3),
tr as (select count(*) as k, arg_max(prediction_accuracy, run_no) as latest, arg_min(prediction_accuracy, run_no) as oldest from l3),
ae as (select type, avg(effectiveness) as a, count(*) as n from res group by type)
select 'accuracy_decline' as rule, 'model' as subject, latest as value,
  'Prediction accuracy is declining. Consider model retraining with recent data.' as message
  from tr where k >= 3 and oldest > latest
union all
select 'low_effectiveness', type, round(a, 6), 'The ''' || type || ''' intervention has low effectiveness ('
  || printf('%.2f', round_even(a*100e0, 0)/100e0) || '). Consider adjusting strategy or implementation.'
  from ae where n >= 3 and a < 0.3e0
union all
select 'high_false_positive_rate', 'model', cast(count(*) as double),
  'High false positive rate detected. Consider adjusting model sensitivity and adding more features.'
  from vh where coalesce(false_positive_rate, 0e0) > 0.2e0 having count(*) >= 3""")
def q_improvement_rules(spark, sf):
    r = V.improvement_rules(B.validation_history(spark, sf),
                            V.intervention_results(B.follow_up(spark, sf)))
    return r.withColumn("value", F.when(F.col("rule") == "low_effectiveness", round6("value"))
                        .otherwise(F.col("value")))


@query("model_performance_log", f"""{_VH} select 'hotspot_grid' as model_name, run_no as ts, metric, value from (
select run_no, 'prediction_accuracy' as metric, prediction_accuracy as value from vh
union all select run_no, 'false_positive_rate', false_positive_rate from vh) z""")
def q_model_perf(spark, sf):
    vh = B.validation_history(spark, sf).withColumnRenamed("run_no", "ts")
    return V.model_performance_log(vh, "hotspot_grid", metric_cols=["prediction_accuracy",
                                                                    "false_positive_rate"])


@query("validation_run_detail", f"""{_VH} select row_number() over (order by run_no) as run_number, run_no,
'Validation Run #' || cast(row_number() over (order by run_no) as varchar) || ' - ' || cast(run_no as varchar) as label,
printf('%.2f', round_even(prediction_accuracy*100e0, 0)/100e0) as accuracy_text,
printf('%.2f', round_even(false_positive_rate*100e0, 0)/100e0) as false_positive_rate_text from vh""")
def q_validation_run_detail(spark, sf):
    return V.validation_run_detail(B.validation_history(spark, sf))
