"""Registered descriptive queries (counts, distributions, amplifiers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import temporal as T
from vigil.functions.numeric import round6
from vigil.operators import descriptive as D
from vigil.plans.registry import query
from vigil.plans.sql_bindings import ARTICLES, INCIDENTS
from vigil.sources import bindings as B

_W = f"with inc as ({INCIDENTS})"


def _inc(spark, sf):
    return B.incidents(spark, sf)


@query("total_incidents", f"{_W} select count(*) as total_incidents from inc")
def q_total(spark, sf):
    return D.total_incidents(_inc(spark, sf))


@query("by_category", f"{_W} select category, count(*) as n from inc where category is not null group by category")
def q_by_category(spark, sf):
    return D.count_by(_inc(spark, sf), "category")


@query("top_locations", f"""{_W} select location_name, count(*) as n from inc
where location_name is not null group by location_name order by n desc, location_name asc limit 10""")
def q_top_locations(spark, sf):
    return D.top_k(_inc(spark, sf), "location_name", 10)


@query("hourly_distribution", f"{_W} select cast(hour(date) as integer) as hour, count(*) as n from inc where date is not null group by 1")
def q_hourly(spark, sf):
    return D.hourly_distribution(_inc(spark, sf)).orderBy("hour")            # T2


@query("daily_distribution", f"""{_W} select dayname(date) as day, cast(isodow(date) - 1 as integer) as weekday,
count(*) as n from inc where date is not null group by 1, 2""")
def q_daily(spark, sf):
    return D.daily_distribution(_inc(spark, sf)).orderBy("weekday")         # T3 calendar order


@query("date_parts", f"""{_W} select incident_id, cast(hour(date) as integer) as hour, dayname(date) as day,
cast(isodow(date) - 1 as integer) as day_of_week, cast(month(date) as integer) as month from inc""")
def q_date_parts(spark, sf):
    return D.date_parts(_inc(spark, sf))


_SUMMARY_SQL = f"""{_W}, b as (select category, location_name as place, cast(hour(date) as integer) as hour,
                   dayname(date) as day from inc)
select 'total_incidents' as section, cast(null as varchar) as key, count(*) as n from b
union all select 'by_category', category, count(*) from b where category is not null group by category
union all (select 'top_locations', place, count(*) from b where place is not null group by place
           order by count(*) desc, place asc limit 10)
union all select 'hourly_distribution', cast(hour as varchar), count(*) from b where hour is not null group by hour
union all select 'daily_distribution', day, count(*) from b where day is not null group by day"""


@query("analysis_summary", _SUMMARY_SQL)
def q_summary(spark, sf):
    return D.analysis_summary(_inc(spark, sf))


@query("hourly_risk", f"""{_W}, c as (select cast(hour(date) as integer) as hour, count(*) as n from inc
where date is not null group by 1)
select cast(hour as varchar) as key, n as incident_count, n*1e0/(select max(n) from c) as risk_score from c""")
def q_hourly_risk(spark, sf):
    return D.hourly_risk(_inc(spark, sf))


@query("daily_risk", f"""{_W}, c as (select dayname(date) as day, count(*) as n from inc
where date is not null group by 1)
select day as key, n as incident_count, n*1e0/(select max(n) from c) as risk_score from c""")
def q_daily_risk(spark, sf):
    return D.daily_risk(_inc(spark, sf))


@query("location_risk", f"""{_W}, c as (select location_name as place, count(*) as n from inc
where location_name is not null group by 1)
select place as key, n as incident_count, n*1e0/(select max(n) from c) as risk_score from c""")
def q_location_risk(spark, sf):
    return D.location_risk(_inc(spark, sf)).orderBy(F.desc("risk_score"), "key")   # T4


@query("category_share", f"""{_W} select category, count(*) as incident_count,
round_even(count(*)*1e0/(select count(*) from inc)*100e0, 0)/100e0 as share
from inc where category is not null group by category""")
def q_category_share(spark, sf):
    return D.category_share(_inc(spark, sf)).orderBy(F.desc("share"), "category")   # T5


_AMP_SQL = f"""{_W},
h as (select cast(cast(hour(date) as integer) as varchar) as key, count(*) as n from inc where date is not null group by 1),
d as (select dayname(date) as key, count(*) as n from inc where date is not null group by 1),
l as (select location_name as key, count(*) as n from inc where location_name is not null group by 1),
c as (select category as key, count(*) as n from inc where category is not null group by 1)
select 'hourly' as dimension, key, n as incident_count, n*1e0/(select max(n) from h) as risk_score from h
union all select 'daily', key, n, n*1e0/(select max(n) from d) from d
union all select 'location', key, n, n*1e0/(select max(n) from l) from l
union all select 'category', key, n, round_even(n*1e0/(select count(*) from inc)*100e0, 0)/100e0 from c
union all select 'environment', c_mktsegment, null, round(avg(c_acctbal/10000e0), 6) from customer group by 2"""


@query("risk_amplifiers", _AMP_SQL)
def q_risk_amplifiers(spark, sf):
    return D.risk_amplifiers(_inc(spark, sf), external=_environment(spark, sf))


def _environment(spark, sf):
    return D.environment_factors(B.environment(spark, sf)).withColumn("value", round6("value"))


@query("environment_factors", "select c_mktsegment as factor, round(avg(c_acctbal/10000e0), 6) as value from customer group by 1")
def q_environment(spark, sf):
    return _environment(spark, sf).orderBy(F.desc("value"), "factor")       # T7


@query("text_dates", f"""{_W} select incident_id, case incident_id % 4 when 3 then null when 2 then strftime(date, '%Y-%m-%d %H:%M:00')
else strftime(date, '%Y-%m-%d %H:%M:%S') end as date from inc""")
def q_text_dates(spark, sf):
    return B.text_dated(spark, sf).select("incident_id", F.date_format(T.parse_text_date("date_text"), "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("fill_defaults", f"""with a as ({ARTICLES})
select article_id, title, coalesce(description, 'No description available') as description,
       coalesce(source_name, 'Unknown Source') as source from a""")
def q_fill_defaults(spark, sf):
    a = B.articles(spark, sf).select("article_id", "title", "description",
                                     F.col("source.name").alias("source"))
    return D.fill_defaults(a)


def _ordered_map(src: str) -> str:
    return f"(select map_from_entries(list(struct_pack(k := key, v := n) order by n desc, key)) from {src})"


_JSON_SQL = f"""{_W},
c as (select category as key, count(*) as n from inc where category is not null group by 1),
l as (select location_name as key, count(*) as n from inc where location_name is not null group by 1
      order by n desc, key limit 10),
h as (select cast(cast(hour(date) as integer) as varchar) as key, count(*) as n from inc where date is not null group by 1),
d as (select dayname(date) as key, count(*) as n from inc where date is not null group by 1)
select cast(to_json(struct_pack(total_incidents := (select count(*) from inc), by_category := {_ordered_map('c')},
  top_locations := {_ordered_map('l')}, hourly_distribution := {_ordered_map('h')},
  daily_distribution := {_ordered_map('d')})) as varchar) as analysis_json"""


@query("analysis_json", _JSON_SQL)
def q_analysis_json(spark, sf):
    """JSON-edge document of the summary (int keys become strings)."""
    doc = D.summary_document(D.analysis_summary(_inc(spark, sf)))
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("analysis_json"))


@query("overview_metrics", f"""{_W}, c as (select category as key, count(*) as n from inc where category is not null group by 1),
l as (select location_name as key, count(*) as n from inc where location_name is not null group by 1),
tc as (select key, n from c order by n desc, key limit 1), tl as (select key, n from l order by n desc, key limit 1)
select (select count(*) from inc) as total_incidents, tc.key as top_category, tc.n as top_category_n,
  tc.key || ' (' || cast(tc.n as varchar) || ')' as top_category_text,
  tl.key as top_location, tl.n as top_location_n, tl.key || ' (' || cast(tl.n as varchar) || ')' as top_location_text
from tc cross join tl""")
def q_overview(spark, sf):
    return D.overview_metrics(D.analysis_summary(_inc(spark, sf)))
