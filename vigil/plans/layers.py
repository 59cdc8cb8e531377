"""Registered map-layer and table frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import descriptive as D
from vigil.operators import grid
from vigil.operators import interventions as I
from vigil.operators import layers as L
from vigil.plans.intervene import _RECS_CTES
from vigil.plans.registry import query
from vigil.plans.sql_bindings import ARTICLES, INCIDENTS, hotspot_sql
from vigil.sources import bindings as B

AS_OF = "2024-01-31"
_W = f"with inc as ({INCIDENTS})"
_HS = f"with {hotspot_sql(INCIDENTS)}"
_MARK = ("case lower(category) when 'theft' then 'blue' when 'assault' then 'red' when 'robbery' then 'orange' "
         "when 'shooting' then 'darkred' when 'murder' then 'black' else 'red' end")
_BAND = "case when risk_score >= 0.7e0 then 'high' when risk_score >= 0.4e0 then 'medium' else 'low' end"


def _inc(spark, sf):
    return B.incidents(spark, sf)


def _hs(spark, sf):
    return grid.hotspot_frames(_inc(spark, sf), as_of=AS_OF)


@query("heat_points", f"{_W} select latitude as lat, longitude as lon, 0.5e0 as weight from inc where latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")
def q_heat(spark, sf):
    return L.heat_points(_inc(spark, sf))


@query("hotspot_heat", f"{_HS} select lat, lon, risk_score*100 as weight from hs")
def q_hotspot_heat(spark, sf):
    return L.heat_points(_hs(spark, sf)[0], lat="lat", lon="lon", risk="risk_score")


@query("popup_records", f"""with a as ({ARTICLES}) select article_id as incident_id, 'Unknown Location' as location,
'Unknown Category' as category, strftime(cast(published_at as timestamp), '%Y-%m-%d %H:%M:%S') as date,
coalesce(source_name, 'Unknown Source') as source,
case when description is null or description = '' then 'No description available'
     else substr(description, 1, 200) || '...' end as description from a""")
def q_popups(spark, sf):
    a = B.articles(spark, sf).select(F.col("article_id").alias("incident_id"),
                                     F.col("published_at").cast("timestamp").alias("date"),
                                     F.col("source.name").alias("source"), "description")
    return L.popup_records(a)


@query("incident_markers", f"{_W} select incident_id, latitude, longitude, category, {_MARK} as marker from inc")
def q_markers(spark, sf):
    return L.incident_markers(_inc(spark, sf))


@query("hotspot_detail", f"""{_HS}, tt as (select hotspot_id, string_agg(printf('%s: %.1f%%', category, share*100e0), ', '
order by share desc, category) as types_text from hs_types group by hotspot_id)
select h.hotspot_id, h.lat, h.lon, h.location, h.risk_score,
  case when risk_score >= 0.7e0 then 'High' when risk_score >= 0.4e0 then 'Medium' else 'Low' end as risk_label,
  case when risk_score >= 0.7e0 then 'red' when risk_score >= 0.4e0 then 'orange' else 'green' end as colour,
  h.risk_score*20 as radius, printf('%.1f%%', h.risk_score*100e0) as risk_text,
  coalesce(t.types_text, '') as types_text
from hs h left join tt t on t.hotspot_id = h.hotspot_id""")
def q_hotspot_detail(spark, sf):
    hs, types = _hs(spark, sf)
    return L.hotspot_detail(hs, types)


@query("intervention_layer", f"""with {_RECS_CTES},
t2 as (select hotspot_id, location, risk_level, primary_crime_type,
       string_agg(printf('%s (Effectiveness: %.1f%%)',
         array_to_string(list_transform(string_split(replace(type, '_', ' '), ' '),
           lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' '), effectiveness*100e0), '; ' order by ord)
       as txt from scored where ord <= 2 group by 1, 2, 3, 4)
select h.hotspot_id, h.lat, h.lon, coalesce(t.location, h.location, 'Unknown Location') as location_name,
  upper(coalesce(t.risk_level, 'low')) as risk_label, coalesce(t.primary_crime_type, 'unknown') as primary_crime_type,
  case coalesce(t.risk_level, 'low') when 'high' then 'red' when 'medium' then 'orange' else 'green' end as colour,
  coalesce(t.location, h.location, 'Unknown Location') || ' (' || upper(substr(coalesce(t.risk_level, 'low'), 1, 1))
    || substr(coalesce(t.risk_level, 'low'), 2) || ')' as tooltip,
  coalesce(t.txt, '') as interventions_text
from hs h left join t2 t on t.hotspot_id = h.hotspot_id""")
def q_intervention_layer(spark, sf):
    inc = _inc(spark, sf)
    hs, types = grid.hotspot_frames(inc, as_of=AS_OF)
    recs = I.recommendations(hs, types, D.risk_amplifiers(inc))
    return L.intervention_layer(hs, recs)


@query("location_layer", f"""{_W}, g as (select location_name as place, count(*) as n, avg(latitude) as lat, avg(longitude) as lon
from inc where location_name is not null and latitude is not null and longitude is not null group by 1)
select place, round(lat, 9) as lat, round(lon, 9) as lon, round(n*100e0/(select max(n) from g), 9) as risk_pct,
round(greatest(5e0, n*100e0/(select max(n) from g)/5), 9) as radius from g""")
def q_location_layer(spark, sf):
    l = L.location_layer(_inc(spark, sf))
    return l.select("place", *[F.round(c, 9).alias(c) for c in ("lat", "lon", "risk_pct", "radius")])


@query("map_center", f"{_W} select round(avg(latitude), 9) as center_lat, round(avg(longitude), 9) as center_lon from inc where latitude is not null and longitude is not null")
def q_map_center(spark, sf):
    c = L.map_center(_inc(spark, sf))
    return c.select(F.round("center_lat", 9).alias("center_lat"), F.round("center_lon", 9).alias("center_lon"))


@query("hotspot_table", f"""{_HS}, prim as (select hotspot_id, category from (select *, row_number() over
(partition by hotspot_id order by share desc, category) as rn from hs_types) z where rn = 1)
select h.hotspot_id, h.location, h.risk_score,
  case when risk_score >= 0.7e0 then 'High' when risk_score >= 0.4e0 then 'Medium' else 'Low' end as risk_level,
  coalesce(p.category, 'unknown') as primary_crime_type from hs h left join prim p on p.hotspot_id = h.hotspot_id""")
def q_hotspot_table(spark, sf):
    hs, types = _hs(spark, sf)
    return L.hotspot_table(hs, types)


@query("marker_layer", f"""{_HS} select hotspot_id, lat, lon,
  case when risk_score >= 0.7e0 then 'red' when risk_score >= 0.4e0 then 'orange' else 'green' end as colour,
  risk_score*20 as radius, greatest(5e0, risk_score*100e0/5) as bubble_radius from hs""")
def q_marker_layer(spark, sf):
    hs = _hs(spark, sf)[0]
    band = I.risk_band("risk_score")
    return hs.select("hotspot_id", "lat", "lon", L.band_colour(band).alias("colour"),
                     (F.col("risk_score") * 20).alias("radius"),
                     F.greatest(F.lit(5.0), F.col("risk_score") * 100 / 5).alias("bubble_radius"))
