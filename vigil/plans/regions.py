"""Registered region-similarity, risk-index and spike-alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round6
from vigil.operators import regions as R
from vigil.plans.registry import query
from vigil.plans.sql_bindings import INCIDENTS, REGION_EDGES
from vigil.sources import bindings as B
from vigil.sources.tables import read_table

_E = f"with e as ({REGION_EDGES})"


def _edges(spark, sf):
    return B.region_similarity_edges(spark, sf)


@query("region_edges", f"{_E} select region, similar_region, weight from e")
def q_region_edges(spark, sf):
    return R.region_edges(R.region_docs(_edges(spark, sf)))


@query("region_docs", f"""{_E} select region, string_agg(similar_region, ',' order by similar_region) as similar_regions,
count(*) as n_similar, round(sum(weight), 9) as weight_sum from e group by region""")
def q_region_docs(spark, sf):
    d = R.region_docs(_edges(spark, sf))
    return d.select("region", F.array_join("similar_regions", ",").alias("similar_regions"),
                    F.size("similar_regions").cast("bigint").alias("n_similar"),
                    F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 9).alias("weight_sum"))


@query("region_upsert", f"""{_E}, n as (select region, similar_region, weight*0.5e0 as weight from e where region = 'ASIA')
select * from e where region not in (select region from n) union all select * from n""")
def q_region_upsert(spark, sf):
    e = _edges(spark, sf)
    new = e.filter(F.col("region") == "ASIA").withColumn("weight", F.col("weight") * 0.5)
    return R.upsert_regions(R.upsert_regions(e, new), new)   # applying twice == once


@query("region_parse", f"""{_E} select region, count(*) as n_regions, count(*) as n_weights, true as valid,
round(sum(weight), 9) as weight_sum from e group by region""")
def q_region_parse(spark, sf):
    d = R.region_docs(_edges(spark, sf))
    form = d.select("region", F.array_join("similar_regions", "\n").alias("regions_text"),
                    F.array_join(F.transform("weights", lambda w: F.format_string("%.17g", w)), "\n ")
                    .alias("weights_text"))
    p = R.parse_region_form(form)
    return p.select("region", F.size("similar_regions").cast("bigint").alias("n_regions"),
                    F.size("weights").cast("bigint").alias("n_weights"), "valid",
                    F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 9).alias("weight_sum"))


def _incident_regions(spark, sf):
    inc = B.incidents(spark, sf, with_source=False)
    nation = read_table(spark, sf, "nation", "n_name", "n_regionkey")
    region = read_table(spark, sf, "region", "r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("location_name"), F.col("r_name").alias("region"))
    # nation/region: fixed 25/5-row TPC-H dimensions
    return inc.join(F.broadcast(geo), "location_name")


@query("region_training_set", f"""{_E}, inc as ({INCIDENTS}),
ir as (select i.incident_id, r.r_name as region from inc i join nation n on n.n_name = i.location_name
       join region r on r.r_regionkey = n.n_regionkey)
select region as target_region, incident_id, 1e0 as weight from ir
union all select e.region, ir.incident_id, e.weight from ir join e on e.similar_region = ir.region""")
def q_region_training_set(spark, sf):
    return R.region_training_set(_incident_regions(spark, sf), _edges(spark, sf))


_FACTORS_SQL = """f as (select n.n_name as nation, count(c.c_custkey)/100e0 as population_density,
  avg(case when c.c_acctbal < 0 then 1e0 else 0e0 end) as poverty_rate,
  avg(case when c.c_mktsegment = 'HOUSEHOLD' then 1e0 else 0e0 end) as unemployment
  from nation n join customer c on c.c_nationkey = n.n_nationkey group by n.n_name),
s as (select n.n_name as nation, count(*)/10e0 as police_presence from nation n join supplier s
  on s.s_nationkey = n.n_nationkey group by n.n_name)"""


def nation_factors(spark, sf):
    """Per-nation factor columns derived from customer and supplier."""
    nation = F.broadcast(read_table(spark, sf, "nation", "n_nationkey", "n_name"))
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    s = read_table(spark, sf, "supplier", "s_nationkey")
    cf = (c.join(nation, c.c_nationkey == nation.n_nationkey).groupBy(F.col("n_name").alias("nation"))
          .agg((F.count("c_custkey") / 100.0).alias("population_density"),
               F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0)).alias("poverty_rate"),
               F.avg(F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1.0).otherwise(0.0)).alias("unemployment")))
    sf_ = (s.join(nation, s.s_nationkey == nation.n_nationkey).groupBy(F.col("n_name").alias("nation"))
           .agg((F.count("*") / 10.0).alias("police_presence")))
    return cf.join(sf_, "nation", "full_outer")


@query("risk_factor_index", f"""with {_FACTORS_SQL}
select coalesce(f.nation, s.nation) as nation, round(0.25e0*coalesce(f.population_density, 0e0) + 0.2e0*coalesce(f.poverty_rate, 0e0)
  + 0.15e0*coalesce(f.unemployment, 0e0) - 0.15e0*coalesce(s.police_presence, 0e0), 6) as risk_index
from f full outer join s on s.nation = f.nation""")
def q_risk_index(spark, sf):
    r = R.risk_factor_index(nation_factors(spark, sf), id_col="nation",
                            factor_cols=["population_density", "poverty_rate", "unemployment",
                                         "police_presence"])
    return r.select("nation", round6("risk_index").alias("risk_index"))


@query("spike_alerts", f"""with inc as ({INCIDENTS}),
dc as (select location_name, category, cast(date as date) as day, count(*) as n from inc group by 1, 2, 3),
tot as (select *, cast(sum(n) over w as double) as t, cast(sum(n*n) over w as double) as q from dc
window w as (partition by location_name, category order by day
             range between interval 7 days preceding and interval 1 day preceding)),
st as (select *, t/7e0 as mean, case when t is not null then sqrt(greatest((q - t*t/7e0)/6e0, 0e0)) end as sd from tot)
select location_name, category, strftime(day, '%Y-%m-%d') as day, n, round(mean, 6) as mean, round(sd, 6) as sd,
coalesce(n > mean + 3e0*sd, false) as alert from st""")
def q_spikes(spark, sf):
    s = R.spike_alerts(R.daily_counts(B.incidents(spark, sf)))
    return s.select("location_name", "category", F.date_format("day", "yyyy-MM-dd").alias("day"), "n",
                    round6("mean").alias("mean"), round6("sd").alias("sd"), "alert")
