"""Frames behind the map layers and tables (drawing itself is not data work).

Each function returns the rows a map layer or table would draw: points with
weights, marker classes and popup texts, all as built-in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions.geo import valid_point
from vigil.operators.interventions import risk_band


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def heat_points(df: DataFrame, *, lat: str = "latitude", lon: str = "longitude",
                risk: str | None = None) -> DataFrame:
    """``lat, lon, weight``: weight is risk × 100 when a risk column is given,
    else the fixed default."""
    w = (F.coalesce(_c(risk) * 100, F.lit(FV.MISSING_HEAT_WEIGHT)) if risk
         else F.lit(FV.MISSING_HEAT_WEIGHT))
    return df.filter(valid_point(lat, lon)).select(F.col(lat).alias("lat"), F.col(lon).alias("lon"),
                                                   w.alias("weight"))


def description_excerpt(desc, n: int = FV.POPUP_DESCRIPTION_CHARS) -> Column:
    """First ``n`` characters + '...' (always); missing/empty → fixed text."""
    d = _c(desc)
    return (F.when(d.isNull() | (d == ""), F.lit(FV.POPUP_NO_DESCRIPTION))
            .otherwise(F.concat(F.substring(d, 1, n), F.lit("..."))))


def popup_records(incidents: DataFrame, id_col: str = "incident_id") -> DataFrame:
    """Per incident: the popup fields with safe defaults."""
    def col_or(name, default):
        return (F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in incidents.columns
                else F.lit(default))
    desc = F.col("description") if "description" in incidents.columns else F.lit(None).cast("string")
    date = (F.date_format("date", "yyyy-MM-dd HH:mm:ss") if "date" in incidents.columns
            else F.lit(None).cast("string"))
    return incidents.select(id_col, col_or("location_name", "Unknown Location").alias("location"),
                            col_or("category", "Unknown Category").alias("category"),
                            F.coalesce(date, F.lit("Unknown Date")).alias("date"),
                            col_or("source", "Unknown Source").alias("source"),
                            description_excerpt(desc).alias("description"))


def category_marker(category) -> Column:
    low = F.lower(_c(category))
    out = F.lit(FV.DEFAULT_MARKER)
    for cat, colour in reversed(FV.CATEGORY_MARKERS):
        out = F.when(low == cat, colour).otherwise(out)
    return out


def band_colour(band) -> Column:
    b = _c(band)
    return F.when(b == "high", "red").when(b == "medium", "orange").otherwise("green")


def incident_markers(incidents: DataFrame, id_col: str = "incident_id") -> DataFrame:
    return (incidents.filter(valid_point("latitude", "longitude"))
            .select(id_col, "latitude", "longitude", "category",
                    category_marker("category").alias("marker")))


def hotspot_detail(hotspots: DataFrame, hotspot_types: DataFrame) -> DataFrame:
    """Per hotspot: band, colour, radius (risk × 20), risk as percent text and
    the type shares as ``type: 45.0%`` in share order (largest first, ties by
    name; bounded per hotspot by the category vocabulary)."""
    txt = (hotspot_types.groupBy("hotspot_id")
           .agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("k"), "category", "share"))),
               lambda s: F.format_string("%s: %.1f%%", s["category"], s["share"] * 100)), ", ")
               .alias("types_text")))
    band = risk_band("risk_score")
    return (hotspots.join(txt, "hotspot_id", "left")
            .select("hotspot_id", "lat", "lon", "location", "risk_score",
                    F.initcap(band).alias("risk_label"), band_colour(band).alias("colour"),
                    (F.col("risk_score") * 20).alias("radius"),
                    F.format_string("%.1f%%", F.col("risk_score") * 100).alias("risk_text"),
                    F.coalesce("types_text", F.lit("")).alias("types_text")))


def intervention_layer(hotspots: DataFrame, recs_long: DataFrame) -> DataFrame:
    """Hotspot ⟕ recommendation with defaults; the first two interventions in
    rule order as ``Type Name (Effectiveness: 60.0%)``."""
    top2 = (recs_long.filter(F.col("ord") <= 2)
            .groupBy("hotspot_id", "location", "risk_level", "primary_crime_type")
            .agg(F.array_sort(F.collect_list(F.struct("ord", "type", "effectiveness"))).alias("_t")))
    item = lambda s: F.format_string("%s (Effectiveness: %.1f%%)",
                                     F.initcap(F.replace(s["type"], F.lit("_"), F.lit(" "))),
                                     s["effectiveness"] * 100)
    j = hotspots.select("hotspot_id", "lat", "lon", F.col("location").alias("_hs_loc")) \
        .join(top2, "hotspot_id", "left")
    level = F.coalesce("risk_level", F.lit("low"))
    name = F.coalesce("location", "_hs_loc", F.lit("Unknown Location"))
    return j.select("hotspot_id", "lat", "lon", name.alias("location_name"),
                    F.upper(level).alias("risk_label"),
                    F.coalesce("primary_crime_type", F.lit("unknown")).alias("primary_crime_type"),
                    band_colour(level).alias("colour"),
                    F.concat(name, F.lit(" ("), F.initcap(level), F.lit(")")).alias("tooltip"),
                    F.coalesce(F.array_join(F.transform("_t", item), "; "), F.lit(""))
                    .alias("interventions_text"))


def location_layer(incidents: DataFrame, place: str = "location_name") -> DataFrame:
    """Per place: mean coordinate, risk % (count / max count × 100) and the
    bubble radius ``max(5, risk% / 5)``; one aggregate, max by scalar."""
    g = (incidents.filter(F.col(place).isNotNull() & valid_point("latitude", "longitude"))
         .groupBy(F.col(place).alias("place"))
         .agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")))
    top = g.agg(F.max("n")).scalar()
    pct = F.col("n") / top * 100
    return g.select("place", "lat", "lon", pct.alias("risk_pct"),
                    F.greatest(F.lit(5.0), pct / 5).alias("radius"))


def map_center(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.filter(valid_point(lat, lon)).agg(F.avg(lat).alias("center_lat"),
                                                F.avg(lon).alias("center_lon"))


def hotspot_table(hotspots: DataFrame, hotspot_types: DataFrame) -> DataFrame:
    """Hotspots with band label and primary type, by risk descending."""
    from vigil.operators.interventions import primary_type
    return (hotspots.join(primary_type(hotspot_types), "hotspot_id", "left")
            .select("hotspot_id", "location", "risk_score",
                    F.initcap(risk_band("risk_score")).alias("risk_level"),
                    F.coalesce("primary_crime_type", F.lit("unknown")).alias("primary_crime_type"))
            .orderBy(F.desc("risk_score"), "hotspot_id"))
