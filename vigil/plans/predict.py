"""Registered hotspot-prediction queries (grid, percentile, hot cells)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import grid
from vigil.plans.registry import query
from vigil.plans.sql_bindings import INCIDENTS, TRAIN, hotspot_sql
from vigil.sources import bindings as B

AS_OF = "2024-01-31"
_HS = hotspot_sql(INCIDENTS)


def _inc(spark, sf):
    return B.incidents(spark, sf)


@query("hotspots", f"with {_HS} select * from hs")
def q_hotspots(spark, sf):
    return grid.hotspots(_inc(spark, sf), as_of=AS_OF)


@query("cell_type_share", f"with {_HS} select * from hs_types")
def q_cell_type_share(spark, sf):
    return grid.hotspot_frames(_inc(spark, sf), as_of=AS_OF)[1]


@query("hotspots_train", f"with {hotspot_sql(TRAIN, as_of='2024-01-24')} select * from hs")
def q_hotspots_train(spark, sf):
    train, _ = B.train_actual(spark, sf)
    return grid.hotspots(train, as_of="2024-01-24")


@query("grid_histogram", f"with {_HS} select i, j, count(*) as n from b1 group by i, j")
def q_grid_histogram(spark, sf):
    return grid.grid_histogram(_inc(spark, sf))


@query("grid_extent", f"with {_HS} select lat_s, lat_e1, lat_d, lat_n, lon_s, lon_e1, lon_d, lon_n from ext")
def q_grid_extent(spark, sf):
    return grid.grid_extent(_inc(spark, sf))


@query("grid_threshold", f"with {_HS} select threshold, max_n from stats")
def q_grid_threshold(spark, sf):
    return grid.cell_threshold(grid.grid_histogram(_inc(spark, sf)))


@query("hot_cells", f"with {_HS} select i, j, n from hot")
def q_hot_cells(spark, sf):
    return grid.hotspots(_inc(spark, sf), as_of=AS_OF).select("i", "j", "n")


@query("cell_mode", f"with {_HS} select hotspot_id, location from hs")
def q_cell_mode(spark, sf):
    return grid.hotspots(_inc(spark, sf), as_of=AS_OF).select("hotspot_id", "location")


@query("hotspot_members", f"""with {_HS},
m as (select p.incident_id, p.latitude as x, p.longitude as y, e.*,
             cast(floor((p.latitude - e.lat_s)/e.lat_d) as bigint) as ki,
             cast(floor((p.longitude - e.lon_s)/e.lon_d) as bigint) as kj
      from pts p cross join ext e),
m1 as (select incident_id,
        least(ki - (case when x < (case when ki = 1 then lat_e1 else lat_s + cast(ki as double)*lat_d end) then 1 else 0 end)
                 + (case when x >= (case when ki + 1 = 1 then lat_e1 else lat_s + cast(ki + 1 as double)*lat_d end) then 1 else 0 end), lat_n - 2) as i,
        least(kj - (case when y < (case when kj = 1 then lon_e1 else lon_s + cast(kj as double)*lon_d end) then 1 else 0 end)
                 + (case when y >= (case when kj + 1 = 1 then lon_e1 else lon_s + cast(kj + 1 as double)*lon_d end) then 1 else 0 end), lon_n - 2) as j
       from m)
select 'hotspot_' || cast(m1.i as varchar) || '_' || cast(m1.j as varchar) as hotspot_id, m1.incident_id
from m1 join hot h on h.i = m1.i and h.j = m1.j""")
def q_hotspot_members(spark, sf):
    return grid.hotspot_members(_inc(spark, sf))


@query("high_risk_count", f"with {_HS} select count(*) filter (where risk_score >= 0.7e0) as high_risk_hotspots, count(*) as hotspots from hs")
def q_high_risk_count(spark, sf):
    hs = grid.hotspots(_inc(spark, sf), as_of=AS_OF)
    return hs.agg(F.count_if(F.col("risk_score") >= 0.7).alias("high_risk_hotspots"),
                  F.count(F.lit(1)).alias("hotspots"))


@query("hotspots_document")
def q_hotspots_document(spark, sf):
    """Document form: coordinates struct, prediction{risk_score, crime_types
    map, timeframe} (rows-only: nested maps do not hash portably)."""
    return grid.hotspots_nested(_inc(spark, sf), as_of=AS_OF)
