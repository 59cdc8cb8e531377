"""Intervention recommendation, scoring and effectiveness tracking.

Recommendations are a join of per-hotspot facts (band, primary type) with the
fixed rule table; the optional peak-time rule adds one ``targeted_enforcement``
row per hotspot whose actions come from a one-row scalar subquery over the
(already aggregated) hourly/daily amplifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.operators.sequence import trailing_mean
from vigil.sources import dimensions as dims


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_band(score, high: float = FV.HIGH_RISK, medium: float = FV.MEDIUM_RISK) -> Column:
    """high / medium / low with inclusive lower bounds; missing score = 0."""
    s = F.coalesce(_c(score), F.lit(0.0))
    return F.when(s >= high, "high").when(s >= medium, "medium").otherwise("low")


def band_factor(band) -> Column:
    b = _c(band)
    return F.when(b == "high", 1.0).when(b == "medium", 0.8).otherwise(0.6)


def band_priority(band) -> Column:
    b = _c(band)
    return F.when(b.isin("high", "medium"), b).otherwise(F.lit("low"))


def primary_type(hotspot_types: DataFrame, *, id_col: str = "hotspot_id") -> DataFrame:
    """Arg-max share per hotspot; ties go to the smaller category name."""
    return (hotspot_types.filter(F.col("category").isNotNull())
            .groupBy(id_col)
            .agg(F.min_by("category", F.struct((-F.col("share")).alias("s"), F.col("category")))
                 .alias("primary_crime_type")))


def peak_actions(amplifiers: DataFrame, threshold: float = FV.PEAK_RISK) -> DataFrame:
    """One row ``actions array<string>`` (0–2 texts) from peak hours/days.

    Hours are listed in numeric order and days alphabetically (the order of
    the grouped amplifier keys). The input is aggregated (≤ 24 + 7 rows).
    """
    hot = amplifiers.filter(F.col("risk_score") > threshold)
    hours = F.array_sort(F.collect_list(F.when(F.col("dimension") == "hourly",
                                               F.col("key").cast("int"))))
    days = F.array_sort(F.collect_list(F.when(F.col("dimension") == "daily", F.col("key"))))
    agg = hot.agg(hours.alias("h"), days.alias("d"))
    texts = F.array(
        F.when(F.size("h") > 0, F.format_string(FV.PEAK_HOURS_TEMPLATE,
                                                F.array_join(F.col("h").cast("array<string>"), ", "))),
        F.when(F.size("d") > 0, F.format_string(FV.PEAK_DAYS_TEMPLATE, F.array_join("d", ", "))))
    return agg.select(F.filter(texts, lambda x: x.isNotNull()).alias("actions"))


def recommendations(hotspots: DataFrame, hotspot_types: DataFrame,
                    amplifiers: DataFrame | None = None, history: DataFrame | None = None,
                    *, id_col: str = "hotspot_id") -> DataFrame:
    """Long form, one row per (hotspot, intervention):

    ``hotspot_id, location, risk_level, primary_crime_type, ord, type,
    description, priority, effectiveness, specific_actions``.

    ``history`` (``intervention_type, recent``) blends the adjusted base
    effectiveness with the recent observed one: ``(e + recent) / 2``.
    """
    spark = hotspots.sparkSession
    prim = primary_type(hotspot_types, id_col=id_col)
    recs = (hotspots.select(id_col, F.coalesce("location", F.lit(FV.UNKNOWN_LOCATION)).alias("location"),
                            risk_band("risk_score").alias("risk_level"))
            .join(prim, id_col, "left")
            .withColumn("primary_crime_type", F.coalesce("primary_crime_type", F.lit("unknown"))))
    rule_key = F.when(F.col("primary_crime_type").isin(dims.rule_crime_types()),
                      F.col("primary_crime_type")).otherwise(F.lit("*"))
    rules = dims.intervention_rules(spark)          # fixed ~10 rows
    picked = (recs.withColumn("crime_type", rule_key)
              .join(F.broadcast(rules), "crime_type")
              .select(id_col, "location", "risk_level", "primary_crime_type", "ord", "type",
                      F.col("actions").alias("specific_actions")))
    if amplifiers is not None:
        peaks = peak_actions(amplifiers).select("actions").scalar()
        extra = (recs.select(id_col, "location", "risk_level", "primary_crime_type",
                             F.lit(3).alias("ord"), F.lit(FV.PEAK_ENFORCEMENT_TYPE).alias("type"),
                             peaks.alias("specific_actions"))
                 .filter(F.size("specific_actions") > 0))
        picked = picked.unionByName(extra)
    return score_interventions(picked, history)


def score_interventions(picked: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``base × band factor``, blended with history when present; unknown
    types get the custom description and base 0.5."""
    spark = picked.sparkSession
    types = dims.intervention_types(spark)          # fixed 5 rows
    out = picked.join(F.broadcast(types), "type", "left")
    eff = (F.coalesce("base_effectiveness", F.lit(FV.CUSTOM_INTERVENTION[1]))
           * band_factor("risk_level"))
    if history is not None:
        h = history.select(F.col("intervention_type").alias("type"), F.col("recent"))
        out = out.join(h, "type", "left")            # the caller's frame: no hint
        eff = F.when(F.col("recent").isNotNull(), (eff + F.col("recent")) / 2).otherwise(eff)
    return out.select(*[c for c in picked.columns if c not in ("type", "specific_actions")],
                      "type", F.coalesce("description", F.lit(FV.CUSTOM_INTERVENTION[0])).alias("description"),
                      band_priority("risk_level").alias("priority"), eff.alias("effectiveness"),
                      "specific_actions")


def recommendations_nested(long_form: DataFrame, *, id_col: str = "hotspot_id") -> DataFrame:
    """Document form: one row per hotspot with the interventions array in rule
    order (at most three entries per hotspot, so the list is bounded)."""
    item = F.struct("ord", "type", "description", "priority", "effectiveness", "specific_actions")
    return (long_form.groupBy(id_col, "location", "risk_level", "primary_crime_type")
            .agg(F.array_sort(F.collect_list(item)).alias("_items"))
            .select(id_col, "location", "risk_level", "primary_crime_type",
                    F.transform("_items", lambda x: x.dropFields("ord")).alias("interventions")))


def tracker_effectiveness(before, after) -> Column:
    """Tracking rule: ``max(0, 1 - after/before)``; no baseline gives 0.5."""
    b, a = _c(before).cast("double"), _c(after).cast("double")
    return F.when(b > 0, F.greatest(F.lit(0.0), 1 - a / b)).otherwise(F.lit(FV.TRACKER_NO_BASELINE))


def validator_effectiveness(before, after) -> Column:
    """Validation rule: ``clamp((before - after) / before, 0, 1)``; no
    baseline (or missing counts) gives 0.0."""
    b, a = _c(before).cast("double"), _c(after).cast("double")
    return (F.when(b.isNotNull() & a.isNotNull() & (b > 0),
                   F.least(F.greatest((b - a) / b, F.lit(0.0)), F.lit(1.0)))
            .otherwise(F.lit(0.0)))


def tracking_records(follow_up: DataFrame) -> DataFrame:
    """Append-ready tracking rows with the tracker effectiveness."""
    notes = F.col("notes") if "notes" in follow_up.columns else F.lit("")
    return follow_up.select(
        "record_id", "hotspot_id", "intervention_type",
        F.date_format("implementation_date", "yyyy-MM-dd").alias("implementation_date"),
        tracker_effectiveness("before_incidents", "after_incidents").alias("effectiveness"),
        "before_incidents", "after_incidents", F.coalesce(notes, F.lit("")).alias("notes"))


def recent_effectiveness(tracking: DataFrame, n: int = FV.RECENT_RUNS) -> DataFrame:
    """Mean of the last ``n`` effectiveness values per type after each record,
    in (implementation_date, record_id) order: ``record_id,
    intervention_type, recent``."""
    return trailing_mean(tracking, "intervention_type", ["implementation_date", "record_id"],
                         "effectiveness", n, id_col="record_id", out="recent")


def latest_recent_effectiveness(tracking: DataFrame, n: int = FV.RECENT_RUNS) -> DataFrame:
    """Current ``recent`` per type: mean of its ``n`` latest records.

    ``row_number() <= n`` over a per-type window is planned with a group
    limit below the exchange, so each map task ships at most ``n`` rows per
    type.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("intervention_type").orderBy(F.desc("implementation_date"),
                                                        F.desc("record_id"))
    return (tracking.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .groupBy("intervention_type").agg(F.avg("effectiveness").alias("recent")))
