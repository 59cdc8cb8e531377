"""Descriptive statistics over incidents: counts, distributions, amplifiers.

All results are aggregates with map-side partial aggregation. Ratios to a
global maximum/total read that scalar through a one-row scalar subquery, so
no operator ever moves the aggregated rows into a single partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions import temporal as T
from vigil.functions.numeric import round_half_even




def total_incidents(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_incidents"))


def count_by(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """Count of non-null values of ``col`` (value_counts semantics)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(alias or col))
            .agg(F.count("*").alias("n")))


def top_k(df: DataFrame, col: str, k: int = 10, alias: str | None = None) -> DataFrame:
    """Top-k values by count desc, ties by value asc (partial top-k per task)."""
    key = alias or col
    return count_by(df, col, key).orderBy(F.desc("n"), F.asc(key)).limit(k)


def hourly_distribution(df: DataFrame, ts: str = "date") -> DataFrame:
    return (df.filter(F.col(ts).isNotNull()).groupBy(T.hour_of(ts).alias("hour"))
            .agg(F.count("*").alias("n")))


def daily_distribution(df: DataFrame, ts: str = "date") -> DataFrame:
    """Counts per weekday name, with the Monday=0 index as calendar sort key."""
    return (df.filter(F.col(ts).isNotNull())
            .groupBy(T.weekday_name(ts).alias("day"), T.weekday_index(ts).alias("weekday"))
            .agg(F.count("*").alias("n")))


def date_parts(df: DataFrame, ts: str = "date", id_col: str = "incident_id") -> DataFrame:
    return df.select(id_col, T.hour_of(ts).alias("hour"), T.weekday_name(ts).alias("day"),
                     T.weekday_index(ts).alias("day_of_week"), T.month_of(ts).alias("month"))


def section_counts(df: DataFrame, *, ts: str | None = "date", category: str | None = "category",
                   place: str | None = "location_name") -> DataFrame:
    """``section, key, n`` for sections total/category/place/hour/day in ONE
    scan: a GROUPING SETS aggregate (Expand + map-side partial aggregation).
    Missing optional columns simply yield no rows for their section."""
    cols = set(df.columns)
    none = F.lit(None).cast("string")
    base = df.select((F.col(category) if category in cols else none).alias("category"),
                     (F.col(place) if place in cols else none).alias("place"),
                     (T.hour_of(ts) if ts in cols else F.lit(None).cast("int")).alias("hour"),
                     (T.weekday_name(ts) if ts in cols else none).alias("day"))
    gs = (base.groupingSets([[], ["category"], ["place"], ["hour"], ["day"]],
                            "category", "place", "hour", "day")
          .agg(F.count("*").alias("n"), F.grouping_id().alias("gid")))
    # grouping_id bits (category, place, hour, day): 1 = column aggregated away
    section = (F.when(F.col("gid") == 15, "total")
               .when(F.col("gid") == 7, "category")
               .when(F.col("gid") == 11, "place")
               .when(F.col("gid") == 13, "hour")
               .otherwise("day"))
    key = F.coalesce(F.col("category"), F.col("place"), F.col("hour").cast("string"),
                     F.col("day"))
    tagged = gs.select(section.alias("section"), key.alias("key"), "n")
    # value_counts drops missing keys; the total keeps every row.
    return tagged.filter((F.col("section") == "total") | F.col("key").isNotNull())


_SUMMARY_NAMES = {"total": "total_incidents", "category": "by_category",
                  "place": "top_locations", "hour": "hourly_distribution",
                  "day": "daily_distribution"}


def analysis_summary(df: DataFrame, *, ts: str = "date", category: str = "category",
                     place: str = "location_name", k: int = 10) -> DataFrame:
    """All descriptive sections in one scan: ``section, key, n``; the place
    section is cut to its top ``k`` (count desc, name asc) with a distributed
    top-k over the already aggregated rows."""
    tagged = section_counts(df, ts=ts, category=category, place=place)
    places = (tagged.filter(F.col("section") == "place")
              .orderBy(F.desc("n"), F.asc("key")).limit(k))
    out = tagged.filter(F.col("section") != "place").unionByName(places)
    mapping = F.create_map(*[F.lit(x) for kv in _SUMMARY_NAMES.items() for x in kv])
    return out.select(mapping[F.col("section")].alias("section"), "key", "n")


def summary_document(summary: DataFrame) -> DataFrame:
    """JSON-edge form of :func:`analysis_summary`: one row with the total and
    one ``map<string, bigint>`` per section. The input is already aggregated
    (closed category vocabulary, top-k places, 24 hours, 7 days)."""
    def section_map(name):
        # entries in count order (largest first, ties by key): deterministic text
        entry = F.when(F.col("section") == name, F.struct((-F.col("n")).alias("o"), "key", "n"))
        ordered = F.array_sort(F.collect_list(entry))
        return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"], e["n"]))).alias(name)

    return summary.groupBy().agg(
        F.max(F.when(F.col("section") == "total_incidents", F.col("n"))).alias("total_incidents"),
        *[section_map(s) for s in ("by_category", "top_locations", "hourly_distribution",
                                   "daily_distribution")])


def _max_normalised(counts: DataFrame, key: str) -> DataFrame:
    m = counts.agg(F.max("n")).scalar()
    return counts.select(F.col(key).cast("string").alias("key"),
                         F.col("n").alias("incident_count"),
                         (F.col("n") / m).alias("risk_score"))


def hourly_risk(df: DataFrame, ts: str = "date") -> DataFrame:
    return _max_normalised(hourly_distribution(df, ts).drop("weekday"), "hour")


def daily_risk(df: DataFrame, ts: str = "date") -> DataFrame:
    return _max_normalised(daily_distribution(df, ts).drop("weekday"), "day")


def location_risk(df: DataFrame, place: str = "location_name") -> DataFrame:
    return _max_normalised(count_by(df, place, "place"), "place")


def category_share(df: DataFrame, category: str = "category") -> DataFrame:
    """Share of all incidents per category, numpy-rounded to 2 places."""
    total = df.agg(F.count("*")).scalar()
    return count_by(df, category, "category").select(
        "category", F.col("n").alias("incident_count"),
        round_half_even(F.col("n") / total, 2).alias("share"))


def environment_factors(external: DataFrame, factors: str = "factors") -> DataFrame:
    """``factor, value`` from rows that carry a map factor → value: the mean
    value of each factor (entries without a value do not count)."""
    return (external.select(F.explode(factors).alias("factor", "value")).groupBy("factor")
            .agg(F.avg("value").alias("value")).filter(F.col("value").isNotNull()))


def risk_amplifiers(df: DataFrame, *, ts: str | None = "date", place: str | None = "location_name",
                    category: str | None = "category",
                    external: DataFrame | None = None) -> DataFrame:
    """Long form ``dimension, key, incident_count, risk_score`` in one scan.

    hourly/daily/location: ``n / max(n)`` within the dimension; category:
    ``n / total`` rounded to 2 places. The per-dimension maxima and the total
    form a frame of at most five rows (one per section), broadcast back onto
    the aggregated rows. Sections whose input column is missing are absent.
    ``external`` (``factor, value``, see :func:`environment_factors`) adds the
    environment section.
    """
    counts = section_counts(df, ts=ts, category=category, place=place)
    tops = counts.groupBy("section").agg(F.max("n").alias("top"))        # ≤ 5 rows
    total = counts.filter(F.col("section") == "total").agg(F.max("n")).scalar()
    dims = F.create_map(F.lit("hour"), F.lit("hourly"), F.lit("day"), F.lit("daily"),
                        F.lit("place"), F.lit("location"), F.lit("category"), F.lit("category"))
    out = (counts.filter(F.col("section") != "total")
           .join(F.broadcast(tops), "section")
           .select(dims[F.col("section")].alias("dimension"), "key",
                   F.col("n").alias("incident_count"),
                   F.when(F.col("section") == "category",
                          round_half_even(F.col("n") / total, 2))
                   .otherwise(F.col("n") / F.col("top")).alias("risk_score")))
    if external is not None:
        out = out.unionByName(external.select(
            F.lit("environment").alias("dimension"), F.col("factor").cast("string").alias("key"),
            F.lit(None).cast("bigint").alias("incident_count"),
            F.col("value").cast("double").alias("risk_score")))
    return out


def fill_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Per-column null fill (only columns present are filled)."""
    d = {k: v for k, v in (defaults or FV.FILL_DEFAULTS).items() if k in df.columns}
    return df.na.fill(d)


def overview_metrics(summary: DataFrame) -> DataFrame:
    """One row from :func:`analysis_summary`: total, most common category and
    most affected place (arg-max count, ties to the smaller name), with the
    ``name (count)`` texts the overview shows."""
    def top(section):
        sel = F.when(F.col("section") == section, F.struct((-F.col("n")).alias("k"), "key", "n"))
        return F.min(sel)

    row = summary.agg(F.max(F.when(F.col("section") == "total_incidents", F.col("n"))).alias("total_incidents"),
                      top("by_category").alias("c"), top("top_locations").alias("l"))
    return row.select("total_incidents",
                      F.col("c.key").alias("top_category"), F.col("c.n").alias("top_category_n"),
                      F.concat(F.col("c.key"), F.lit(" ("), F.col("c.n").cast("string"), F.lit(")"))
                      .alias("top_category_text"),
                      F.col("l.key").alias("top_location"), F.col("l.n").alias("top_location_n"),
                      F.concat(F.col("l.key"), F.lit(" ("), F.col("l.n").cast("string"), F.lit(")"))
                      .alias("top_location_text"))
