"""The FIXTURES.md bindings as SQL text, for the DuckDB oracle.

Only syntax shared by DuckDB and Spark SQL; float constants carry an
exponent so DuckDB types them DOUBLE, not DECIMAL.
"""

INCIDENTS = """
select e.event_id as incident_id, e.ts as date,
       case e.event_type when 'click' then 'theft' when 'view' then 'robbery'
            when 'signup' then 'assault' when 'purchase' then 'murder' else 'shooting' end as category,
       n.n_name as location_name,
       40e0 + ((e.user_id*7919 + (e.event_id % 5)*13) % 500)/1021e0 as latitude,
       (((e.user_id*104729 + (e.event_id % 3)*29) % 500) - 250)/1021e0 as longitude,
       'src' || cast(e.user_id % 20 as varchar) as source
from events e join nation n on n.n_nationkey = e.user_id % 25
"""

TRAIN = f"select * from ({INCIDENTS}) x where date < timestamp '2024-01-24 00:00:00'"
ACTUAL = f"select * from ({INCIDENTS}) x where date >= timestamp '2024-01-24 00:00:00'"

ARTICLES = """
select doc_id as article_id, case when doc_id % 27 = 0 then text else substr(text, 1, 40) end as title,
       case when doc_id % 27 = 0 then null else text end as description, lang,
       case when doc_id % 11 = 0 then null else source end as source_name,
       cast(date '2024-01-01' + cast(doc_id % 30 as integer) as date) as published_at
from documents
"""

CATEGORY_TERMS = """
select * from (values ('murder','thble'), ('robbery','thtion'), ('assault','thing'),
                      ('theft','attion'), ('shooting','erble'), ('crime','ertion')) t(category, term)
"""

GAZETTEER = """
select * from (values ('thanea', 40.1e0, -0.2e0), ('oning', 40.2e0, 0.1e0),
                      ('eriner', 40.3e0, 0.0e0), ('thanedble', 40.4e0, 0.2e0),
                      ('onble', 40.25e0, -0.1e0)) g(place, latitude, longitude)
"""

FOLLOW_UP = """
select o_orderkey as record_id, 'hotspot_' || cast(o_custkey % 20 as varchar) as hotspot_id,
       case substr(o_orderpriority, 1, 1) when '1' then 'police_patrol' when '2' then 'community_outreach'
            when '3' then 'environmental_modification' when '4' then 'public_awareness'
            else 'targeted_enforcement' end as intervention_type,
       o_orderdate as implementation_date, o_orderkey % 20 as before_incidents,
       o_custkey % 15 as after_incidents
from orders
"""

VALIDATION_HISTORY = """
select year(o_orderdate)*100 + month(o_orderdate) as run_no,
       sum(case when o_orderstatus = 'F' then 1 else 0 end)*1e0/count(*) as prediction_accuracy,
       sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end)*1e0/count(*) as false_positive_rate
from orders group by 1
"""

REGION_EDGES = """
select a.r_name as region, b.r_name as similar_region,
       1e0/(1 + abs(a.r_regionkey - b.r_regionkey)) as weight
from region a join region b on a.r_regionkey <> b.r_regionkey
"""


def hotspot_sql(src: str, *, res: str = "0.01e0", pct: str = "0.75", as_of: str = "2024-01-31",
                days: int = 7) -> str:
    """CTE chain (ending in ``hs`` and ``hs_types``) that rebuilds the hot
    cells of ``src`` the way the prediction does (numpy edge rules)."""
    def edge(k, ax):
        return (f"(case when {k} = 1 then {ax}_e1 "
                f"else {ax}_s + cast({k} as double)*{ax}_d end)")

    return f"""
pts as (select * from ({src}) s0 where latitude is not null and longitude is not null
        and not isnan(latitude) and not isnan(longitude)),
ext0 as (select min(latitude) - {res} as lat_s, max(latitude) + {res} as lat_stop,
                min(longitude) - {res} as lon_s, max(longitude) + {res} as lon_stop from pts),
ext as (select lat_s, lat_s + {res} as lat_e1, (lat_s + {res}) - lat_s as lat_d,
               cast(ceil((lat_stop - lat_s)/{res}) as bigint) as lat_n,
               lon_s, lon_s + {res} as lon_e1, (lon_s + {res}) - lon_s as lon_d,
               cast(ceil((lon_stop - lon_s)/{res}) as bigint) as lon_n from ext0),
b0 as (select p.location_name as place, p.category, e.*,
              cast(floor((p.latitude - e.lat_s)/e.lat_d) as bigint) as ki,
              cast(floor((p.longitude - e.lon_s)/e.lon_d) as bigint) as kj,
              p.latitude as x, p.longitude as y
       from pts p cross join ext e
       where p.latitude >= e.lat_s and p.latitude <= {edge('e.lat_n - 1', 'e.lat')}
         and p.longitude >= e.lon_s and p.longitude <= {edge('e.lon_n - 1', 'e.lon')}),
b1 as (select place, category,
              least(ki - (case when x < {edge('ki', 'lat')} then 1 else 0 end)
                       + (case when x >= {edge('ki + 1', 'lat')} then 1 else 0 end), lat_n - 2) as i,
              least(kj - (case when y < {edge('kj', 'lon')} then 1 else 0 end)
                       + (case when y >= {edge('kj + 1', 'lon')} then 1 else 0 end), lon_n - 2) as j
       from b0),
cells as (select i, j, count(*) as n from b1 group by i, j),
stats as (select quantile_cont(n, {pct}) as threshold, max(n) as max_n from cells),
hot as (select c.i, c.j, c.n, s.max_n from cells c cross join stats s where c.n >= s.threshold),
pl as (select i, j, place, count(*) as pn from b1 where place is not null group by i, j, place),
modal as (select i, j, place from (select *, row_number() over (partition by i, j
          order by pn desc, place asc) as rn from pl) z where rn = 1),
cc as (select i, j, category, count(*) as cn from b1 where category is not null group by i, j, category),
hs as (select 'hotspot_' || cast(h.i as varchar) || '_' || cast(h.j as varchar) as hotspot_id,
              h.i, h.j, h.n,
              ({edge('h.i', 'e.lat')} + {edge('h.i + 1', 'e.lat')})/2 as lat,
              ({edge('h.j', 'e.lon')} + {edge('h.j + 1', 'e.lon')})/2 as lon,
              coalesce(m.place, 'Unknown') as location,
              round_even(h.n*1e0/h.max_n*100e0, 0)/100e0 as risk_score,
              strftime(date '{as_of}', '%Y-%m-%d') as start,
              strftime(date '{as_of}' + interval {days} day, '%Y-%m-%d') as "end"
       from hot h cross join ext e left join modal m on m.i = h.i and m.j = h.j),
hs_types as (select 'hotspot_' || cast(h.i as varchar) || '_' || cast(h.j as varchar) as hotspot_id,
                    c.category, round_even(c.cn*1e0/h.n*100e0, 0)/100e0 as share
             from hot h join cc c on c.i = h.i and c.j = h.j)
"""
