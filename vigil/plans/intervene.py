"""Registered intervention queries (banding, rules, scoring, tracking)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions.numeric import round6
from vigil.operators import descriptive as D
from vigil.operators import grid
from vigil.operators import interventions as I
from vigil.plans.registry import query
from vigil.plans.sql_bindings import FOLLOW_UP, INCIDENTS, hotspot_sql
from vigil.sources import bindings as B

AS_OF = "2024-01-31"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_values() -> str:
    rows, seen = [], {}
    for crime, kind, actions in FV.INTERVENTION_RULES:
        seen[crime] = seen.get(crime, 0) + 1
        rows.append(f"({_q(crime)}, {seen[crime]}, {_q(kind)}, {_q('; '.join(actions))})")
    return "select * from (values " + ", ".join(rows) + ") r(crime_type, ord, type, actions)"


def _types_values() -> str:
    rows = [f"({_q(t)}, {_q(d)}, {b!r}e0)" for t, d, b in FV.INTERVENTION_TYPES]
    return "select * from (values " + ", ".join(rows) + ") t(type, description, base_effectiveness)"


_RULE_KEYS = ", ".join(_q(c) for c in sorted({c for c, _, _ in FV.INTERVENTION_RULES if c != "*"}))

# hotspots + amplifier peaks + rule lookup, as CTEs ending in ``scored``
_RECS_CTES = f"""{hotspot_sql(INCIDENTS)},
inc as ({INCIDENTS}),
bands as (select hotspot_id, location, case when risk_score >= 0.7e0 then 'high'
          when risk_score >= 0.4e0 then 'medium' else 'low' end as risk_level from hs),
prim as (select hotspot_id, category as primary_crime_type from (select *, row_number() over
         (partition by hotspot_id order by share desc, category asc) as rn from hs_types
         where category is not null) z where rn = 1),
recs as (select b.*, coalesce(p.primary_crime_type, 'unknown') as primary_crime_type
         from bands b left join prim p on p.hotspot_id = b.hotspot_id),
rules as ({_rules_values()}),
types as ({_types_values()}),
hc as (select cast(hour(date) as integer) as hour, count(*) as n from inc where date is not null group by 1),
dc as (select dayname(date) as day, count(*) as n from inc where date is not null group by 1),
ph as (select string_agg(cast(hour as varchar), ', ' order by hour) as s from hc
       where n*1e0/(select max(n) from hc) > 0.7e0),
pd as (select string_agg(day, ', ' order by day) as s from dc
       where n*1e0/(select max(n) from dc) > 0.7e0),
peak as (select concat_ws('; ',
           case when ph.s is not null then 'Focus resources during peak hours: ' || ph.s end,
           case when pd.s is not null then 'Increase coverage on high-risk days: ' || pd.s end) as actions
         from ph cross join pd),
picked as (select r.hotspot_id, r.location, r.risk_level, r.primary_crime_type, u.ord, u.type, u.actions
           from recs r join rules u on u.crime_type = case when r.primary_crime_type in ({_RULE_KEYS})
                then r.primary_crime_type else '*' end
           union all
           select r.hotspot_id, r.location, r.risk_level, r.primary_crime_type, 3, 'targeted_enforcement',
                  p.actions from recs r cross join peak p where p.actions <> ''),
scored as (select p.hotspot_id, p.location, p.risk_level, p.primary_crime_type, p.ord, p.type,
                  coalesce(t.description, 'Custom intervention') as description, p.risk_level as priority,
                  coalesce(t.base_effectiveness, 0.5e0) * case p.risk_level when 'high' then 1.0e0
                       when 'medium' then 0.8e0 else 0.6e0 end as effectiveness,
                  p.actions
           from picked p left join types t on t.type = p.type)"""

_FOLLOW_CTES = f"""fu as ({FOLLOW_UP}),
trk as (select record_id, intervention_type, implementation_date,
        case when before_incidents > 0 then greatest(0e0, 1e0 - after_incidents*1e0/before_incidents)
             else 0.5e0 end as effectiveness from fu)"""


def _inc(spark, sf):
    return B.incidents(spark, sf)


def _recs(spark, sf, history=None):
    inc = _inc(spark, sf)
    hs, types = grid.hotspot_frames(inc, as_of=AS_OF)
    return I.recommendations(hs, types, D.risk_amplifiers(inc), history)


def _flat(df):
    return df.select("hotspot_id", "location", "risk_level", "primary_crime_type", "ord", "type",
                     "description", "priority", round6("effectiveness").alias("effectiveness"),
                     F.array_join("specific_actions", "; ").alias("actions"))


@query("risk_band", f"""with {hotspot_sql(INCIDENTS)} select hotspot_id, risk_score,
case when risk_score >= 0.7e0 then 'high' when risk_score >= 0.4e0 then 'medium' else 'low' end as risk_level from hs""")
def q_risk_band(spark, sf):
    hs = grid.hotspots(_inc(spark, sf), as_of=AS_OF)
    return hs.select("hotspot_id", "risk_score", I.risk_band("risk_score").alias("risk_level"))


@query("primary_type", f"with {_RECS_CTES} select hotspot_id, primary_crime_type from recs")
def q_primary_type(spark, sf):
    inc = _inc(spark, sf)
    hs, types = grid.hotspot_frames(inc, as_of=AS_OF)
    return (hs.select("hotspot_id").join(I.primary_type(types), "hotspot_id", "left")
            .select("hotspot_id", F.coalesce("primary_crime_type", F.lit("unknown"))
                    .alias("primary_crime_type")))


@query("peak_actions", f"with {_RECS_CTES} select actions from peak")
def q_peak_actions(spark, sf):
    return I.peak_actions(D.risk_amplifiers(_inc(spark, sf))).select(
        F.array_join("actions", "; ").alias("actions"))


@query("recommendations", f"""with {_RECS_CTES} select hotspot_id, location, risk_level, primary_crime_type,
ord, type, description, priority, round(effectiveness, 6) as effectiveness, actions from scored""")
def q_recommendations(spark, sf):
    return _flat(_recs(spark, sf))


@query("top2_interventions", f"""with {_RECS_CTES} select hotspot_id, ord, type,
upper(risk_level) as risk_label, round(effectiveness*100e0, 6) as effectiveness_pct from scored where ord <= 2""")
def q_top2(spark, sf):
    r = _recs(spark, sf).filter(F.col("ord") <= 2)
    return r.select("hotspot_id", "ord", "type", F.upper("risk_level").alias("risk_label"),
                    round6(F.col("effectiveness") * 100).alias("effectiveness_pct"))


@query("recs_by_band", f"""with {_RECS_CTES} select risk_level, count(distinct hotspot_id) as hotspots,
count(*) as interventions from scored group by risk_level""")
def q_recs_by_band(spark, sf):
    return (_recs(spark, sf).groupBy("risk_level")
            .agg(F.countDistinct("hotspot_id").alias("hotspots"),
                 F.count(F.lit(1)).alias("interventions")))


@query("recs_by_location", f"""with {_RECS_CTES},
first_hs as (select location, min(hotspot_id) as hotspot_id from (select s.location, s.hotspot_id,
             row_number() over (partition by s.location order by h.i, h.j) as rn
             from bands s join hs h on h.hotspot_id = s.hotspot_id) z where rn = 1 group by location)
select f.location, f.hotspot_id, s.ord, s.type from first_hs f join scored s on s.hotspot_id = f.hotspot_id""")
def q_recs_by_location(spark, sf):
    inc = _inc(spark, sf)
    hs, types = grid.hotspot_frames(inc, as_of=AS_OF)
    first = (hs.groupBy("location")
             .agg(F.min_by("hotspot_id", F.struct("i", "j")).alias("hotspot_id")))
    recs = I.recommendations(hs, types, D.risk_amplifiers(inc))
    return first.join(recs.select("hotspot_id", "ord", "type"), "hotspot_id").select(
        "location", "hotspot_id", "ord", "type")


@query("tracking_records", f"""with {_FOLLOW_CTES} select f.record_id, f.hotspot_id, f.intervention_type,
strftime(f.implementation_date, '%Y-%m-%d') as implementation_date, t.effectiveness,
f.before_incidents, f.after_incidents, '' as notes from fu f join trk t on t.record_id = f.record_id""")
def q_tracking(spark, sf):
    return I.tracking_records(B.follow_up(spark, sf))


@query("recent_effectiveness", f"""with {_FOLLOW_CTES} select record_id, intervention_type,
round(avg(effectiveness) over (partition by intervention_type order by implementation_date, record_id
rows between 4 preceding and current row), 6) as recent from trk""")
def q_recent(spark, sf):
    t = I.tracking_records(B.follow_up(spark, sf))
    return I.recent_effectiveness(t).select("record_id", "intervention_type", round6("recent").alias("recent"))


@query("recent_effectiveness_latest", f"""with {_FOLLOW_CTES} select intervention_type,
round(avg(effectiveness), 6) as recent from (select *, row_number() over (partition by intervention_type
order by implementation_date desc, record_id desc) as rn from trk) z where rn <= 5 group by intervention_type""")
def q_recent_latest(spark, sf):
    t = I.tracking_records(B.follow_up(spark, sf))
    return I.latest_recent_effectiveness(t).select("intervention_type", round6("recent").alias("recent"))


@query("intervention_score", f"""with {_RECS_CTES}, {_FOLLOW_CTES},
hist as (select intervention_type, avg(effectiveness) as recent from (select *, row_number() over
         (partition by intervention_type order by implementation_date desc, record_id desc) as rn from trk) z
         where rn <= 5 group by intervention_type)
select s.hotspot_id, s.ord, s.type, s.risk_level,
       round(case when h.recent is not null then (s.effectiveness + h.recent)/2 else s.effectiveness end, 6)
       as effectiveness
from scored s left join hist h on h.intervention_type = s.type""")
def q_intervention_score(spark, sf):
    hist = I.latest_recent_effectiveness(I.tracking_records(B.follow_up(spark, sf)))
    r = _recs(spark, sf, history=hist)
    return r.select("hotspot_id", "ord", "type", "risk_level",
                    round6("effectiveness").alias("effectiveness"))


@query("recommendations_nested")
def q_recommendations_nested(spark, sf):
    return I.recommendations_nested(_recs(spark, sf))


@query("peak_hours", f"with {_RECS_CTES} select coalesce(s, '') as peak_hours from ph")
def q_peak_hours(spark, sf):
    amp = D.risk_amplifiers(_inc(spark, sf))
    hot = amp.filter((F.col("dimension") == "hourly") & (F.col("risk_score") > 0.7))
    return hot.agg(F.array_join(F.array_sort(F.collect_list(F.col("key").cast("int"))).cast("array<string>"), ", ")
                   .alias("peak_hours"))


@query("peak_days", f"with {_RECS_CTES} select coalesce(s, '') as peak_days from pd")
def q_peak_days(spark, sf):
    amp = D.risk_amplifiers(_inc(spark, sf))
    hot = amp.filter((F.col("dimension") == "daily") & (F.col("risk_score") > 0.7))
    return hot.agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("peak_days"))
