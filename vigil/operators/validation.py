"""Prediction validation: spatial hits, type similarity, risk correlation,
false positive rate, the weighted overall score, history rules and series.

Every metric is a one-row DataFrame built from aggregates; combining them
reads each one as a scalar subquery, so no operator joins two large inputs
except through bucketed / equi keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions.geo import truncating_bin, valid_point
from vigil.operators.interventions import validator_effectiveness
from vigil.operators.sequence import rank_within
from vigil.operators.spatial import within_distance, within_km


def spatial_accuracy(hotspots: DataFrame, actual: DataFrame, *,
                     max_dist: float = FV.HIT_DISTANCE, max_km: float | None = None) -> DataFrame:
    """Share of actual incidents with a hotspot centre closer than
    ``max_dist`` degrees or, if given, ``max_km`` on the great circle; incidents without coordinates count but never hit; no
    hotspots (or no incidents) gives 0.0. Hits come from a semi join, which
    the adaptive planner can split where a bucket is hot."""
    points = actual.select("latitude", "longitude")
    centres = hotspots.select("lat", "lon")
    met = within_distance(points, centres, max_dist=max_dist) if max_km is None else within_km(points, centres, max_km=max_km)
    hits = met.agg(F.count("*")).scalar()
    return points.agg(F.when(F.count("*") > 0, hits / F.count("*")).otherwise(F.lit(0.0))
                      .alias("spatial_accuracy"))


def predicted_type_mass(hotspot_types: DataFrame) -> DataFrame:
    """Σ share per category over hotspots, and that mass normalised."""
    mass = (hotspot_types.filter(F.col("category").isNotNull())
            .groupBy("category").agg(F.sum("share").alias("mass")))
    total = mass.agg(F.sum("mass")).scalar()
    return mass.withColumn("normalised", F.try_divide(F.col("mass"), total))


def actual_parts(actual: DataFrame, size: float = FV.VALIDATION_BIN) -> tuple[DataFrame, DataFrame]:
    """Category counts and the truncated-cell grid of the actual incidents in
    ONE scan (GROUPING SETS): ``(category, actual)`` and
    ``(lat_bin, lon_bin, actual_count)``."""
    ok = valid_point("latitude", "longitude")
    base = actual.select(F.col("category"),
                         F.when(ok, truncating_bin("latitude", size)).alias("lat_bin"),
                         F.when(ok, truncating_bin("longitude", size)).alias("lon_bin"))
    gs = (base.groupingSets([["category"], ["lat_bin", "lon_bin"]], "category", "lat_bin", "lon_bin")
          .agg(F.count("*").alias("n"), F.grouping_id().alias("gid")))
    # grouping_id bits (category, lat_bin, lon_bin): 1 = aggregated away
    counts = (gs.filter((F.col("gid") == 3) & F.col("category").isNotNull())
              .select("category", F.col("n").alias("actual")))
    grid = (gs.filter((F.col("gid") == 4) & F.col("lat_bin").isNotNull() & F.col("lon_bin").isNotNull())
            .select("lat_bin", "lon_bin", F.col("n").alias("actual_count")))
    return counts, grid


def type_vectors(hotspot_types: DataFrame, actual: DataFrame | None,
                 actual_counts: DataFrame | None = None) -> DataFrame:
    """Full outer join of actual counts and predicted mass per category
    (union of both key sets, 0 where absent)."""
    act = actual_counts if actual_counts is not None else (
        actual.filter(F.col("category").isNotNull())
        .groupBy("category").agg(F.count("*").alias("actual")))
    pred = predicted_type_mass(hotspot_types).select("category", F.col("mass").alias("predicted"))
    return (act.join(pred, "category", "full_outer")
            .select("category", F.coalesce("actual", F.lit(0)).alias("actual"),
                    F.coalesce("predicted", F.lit(0.0)).alias("predicted")))


def type_accuracy(hotspot_types: DataFrame, actual: DataFrame | None,
                  actual_counts: DataFrame | None = None) -> DataFrame:
    """Cosine similarity of actual counts and predicted mass; a zero vector
    gives 0.0 (normalising the prediction does not change the cosine)."""
    v = type_vectors(hotspot_types, actual, actual_counts)
    dot, na, nb = F.sum(F.col("actual") * F.col("predicted")), F.sum(F.col("actual") ** 2), \
        F.sum(F.col("predicted") ** 2)
    return v.agg(F.when((na > 0) & (nb > 0), dot / F.sqrt(na * nb)).otherwise(F.lit(0.0))
                 .alias("type_accuracy"))


def actual_grid(actual: DataFrame, size: float = FV.VALIDATION_BIN) -> DataFrame:
    """Incident count per truncated cell ``int(x / size)``."""
    return (actual.filter(valid_point("latitude", "longitude"))
            .groupBy(truncating_bin("latitude", size).alias("lat_bin"),
                     truncating_bin("longitude", size).alias("lon_bin"))
            .agg(F.count("*").alias("actual_count")))


def predicted_grid(hotspots: DataFrame, size: float = FV.VALIDATION_BIN) -> DataFrame:
    """Risk per truncated cell of the hotspot centres; with several hotspots
    in one cell the last in (i, j) order wins."""
    return (hotspots.filter(valid_point("lat", "lon"))
            .groupBy(truncating_bin("lat", size).alias("lat_bin"),
                     truncating_bin("lon", size).alias("lon_bin"))
            .agg(F.max_by(F.coalesce("risk_score", F.lit(0.0)), F.struct("i", "j"))
                 .alias("predicted_risk")))


def risk_grid(hotspots: DataFrame, actual: DataFrame | None, size: float = FV.VALIDATION_BIN,
              grid: DataFrame | None = None) -> DataFrame:
    """Every actual cell with its predicted risk (0 when none)."""
    g = grid if grid is not None else actual_grid(actual, size)
    return (g.join(predicted_grid(hotspots, size),
                                           ["lat_bin", "lon_bin"], "left")
            .select("lat_bin", "lon_bin", "actual_count",
                    F.coalesce("predicted_risk", F.lit(0.0)).alias("predicted_risk")))


def risk_correlation(hotspots: DataFrame, actual: DataFrame | None,
                     size: float = FV.VALIDATION_BIN, grid: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of actual counts and predicted risk over actual
    cells, floored at 0; fewer than 2 cells or zero variance gives 0.0."""
    g = risk_grid(hotspots, actual, size, grid)
    a, b = F.col("actual_count").cast("double"), F.col("predicted_risk")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return g.agg(F.when(F.count("*") >= 2, F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(0.0)))
                 .otherwise(F.lit(0.0)).alias("risk_correlation"))


def cell_sets(hotspots: DataFrame, actual: DataFrame | None, size: float = FV.VALIDATION_BIN,
              grid: DataFrame | None = None):
    """Distinct predicted and actual truncated cells."""
    pred = (hotspots.filter(valid_point("lat", "lon"))
            .select(truncating_bin("lat", size).alias("lat_bin"),
                    truncating_bin("lon", size).alias("lon_bin")).distinct())
    act = (grid if grid is not None else actual_grid(actual, size)).select("lat_bin", "lon_bin")
    return pred, act


def true_positive_cells(hotspots: DataFrame, actual: DataFrame) -> DataFrame:
    pred, act = cell_sets(hotspots, actual)
    return pred.intersect(act)


def false_positive_cells(hotspots: DataFrame, actual: DataFrame) -> DataFrame:
    pred, act = cell_sets(hotspots, actual)
    return pred.subtract(act)


def false_positive_rate(hotspots: DataFrame, actual: DataFrame | None,
                        size: float = FV.VALIDATION_BIN, grid: DataFrame | None = None) -> DataFrame:
    """FP / (TP + FP) over distinct predicted cells; no prediction gives 1.0."""
    pred, act = cell_sets(hotspots, actual, size, grid)
    flagged = pred.join(act.withColumn("_seen", F.lit(True)), ["lat_bin", "lon_bin"], "left")
    return flagged.agg(F.when(F.count("*") > 0, F.count_if(F.col("_seen").isNull()) / F.count("*"))
                       .otherwise(F.lit(1.0)).alias("false_positive_rate"))


def overall(spatial, type_, corr, fpr, weights=FV.OVERALL_WEIGHTS) -> Column:
    w1, w2, w3, w4 = weights
    return w1 * spatial + w2 * type_ + w3 * corr + w4 * (1 - fpr)


def validation_run(hotspots: DataFrame, hotspot_types: DataFrame, actual: DataFrame, *,
                   max_dist: float = FV.HIT_DISTANCE, run_ts: str | None = None,
                   threshold: float = FV.ACCURACY_THRESHOLD) -> DataFrame:
    """One row: the four metrics, the weighted score and the pass flag.

    ``run_ts`` (``yyyy-MM-dd HH:mm:ss``) stamps the run; the clock is a
    parameter, never read inside the operator.
    """
    # actual incidents: per-row hit flags, and one GROUPING SETS aggregate
    # (category counts + cell grid) whose exchange the three metrics share
    counts, grid = actual_parts(actual)
    s = spatial_accuracy(hotspots, actual, max_dist=max_dist).scalar()
    t = type_accuracy(hotspot_types, None, counts).scalar()
    c = risk_correlation(hotspots, None, grid=grid).scalar()
    f = false_positive_rate(hotspots, None, grid=grid).scalar()
    spark = hotspots.sparkSession
    row = spark.range(1).select(s.alias("spatial_accuracy"), t.alias("type_accuracy"),
                                c.alias("risk_correlation"), f.alias("false_positive_rate"))
    row = row.withColumn("overall_accuracy", overall(F.col("spatial_accuracy"), F.col("type_accuracy"),
                                                     F.col("risk_correlation"),
                                                     F.col("false_positive_rate")))
    row = row.withColumn("passed", F.col("overall_accuracy") > F.lit(threshold))
    if run_ts is not None:
        row = row.withColumn("ts", F.lit(run_ts).cast("timestamp"))
    return row


# ---------------------------------------------------------------- interventions

def intervention_results(follow_up: DataFrame) -> DataFrame:
    """Validator effectiveness per (hotspot, intervention record)."""
    return follow_up.select("hotspot_id", F.col("record_id").alias("intervention_id"),
                            F.coalesce(F.col("intervention_type"), F.lit("unknown")).alias("type"),
                            validator_effectiveness("before_incidents", "after_incidents")
                            .alias("effectiveness"),
                            "before_incidents", "after_incidents")


#: Records of one follow-up document: bounds what is gathered into a row.
DOCUMENT_RECORDS = 256
FOLLOW_UP_TYPE = ("map<string, map<string, struct<type: string, follow_up_data: struct<before_incidents: bigint, "
                  "after_incidents: bigint>>>>")


def follow_up_document(follow_up: DataFrame, records: int = DOCUMENT_RECORDS) -> DataFrame:
    """``part, document``: JSON texts hotspot → intervention id → type and
    follow-up data, several interventions per hotspot. The documents hold the
    records of ``records`` successive ids each, so a hotspot with very many
    records is spread over many of them. A hotspot's record id names one
    intervention (of repeats one stays); a null hotspot is "unknown"."""
    one = F.struct(F.col("intervention_type").alias("type"),
                   F.struct(F.col("before_incidents").cast("bigint").alias("before_incidents"),
                            F.col("after_incidents").cast("bigint").alias("after_incidents")).alias("follow_up_data"))
    rows = follow_up.withColumn("hotspot_id", F.coalesce("hotspot_id", F.lit("unknown"))).dropDuplicates(["hotspot_id", "record_id"])
    by_hotspot = (rows.filter("record_id is not null").groupBy(F.floor(F.col("record_id") / records).alias("part"), "hotspot_id")
                  .agg(F.map_from_entries(F.collect_list(F.struct(F.col("record_id").cast("string"), one))).alias("interventions")))
    return (by_hotspot.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("hotspot_id", "interventions"))).alias("doc"))
            .select("part", F.to_json("doc").alias("document")))


def explode_follow_up(documents: DataFrame, document: str = "document") -> DataFrame:
    """Both levels of follow-up documents back to rows: hotspots, then their
    interventions. Texts that do not parse give no rows."""
    return (documents.select(F.explode(F.from_json(document, FOLLOW_UP_TYPE)).alias("hotspot_id", "interventions"))
            .select("hotspot_id", F.explode("interventions").alias("intervention_id", "d"))
            .select("hotspot_id", "intervention_id", F.coalesce("d.type", F.lit("unknown")).alias("type"),
                    validator_effectiveness("d.follow_up_data.before_incidents",
                                            "d.follow_up_data.after_incidents").alias("effectiveness")))


def avg_effectiveness(results: DataFrame) -> DataFrame:
    """Mean effectiveness per type, result count, and percent form."""
    return (results.groupBy("type")
            .agg(F.avg("effectiveness").alias("avg_effectiveness"),
                 F.count("*").alias("results"))
            .withColumn("avg_effectiveness_pct", F.col("avg_effectiveness") * 100))


def effectiveness_quartiles(results: DataFrame, id_col: str = "intervention_id") -> DataFrame:
    """min, q1, median, q3, max per type (exact, linear interpolation),
    computed with distributed ranks rather than a per-type value buffer."""
    from vigil.operators.sequence import exact_quantiles
    q = exact_quantiles(results, "type", "effectiveness", [0.25, 0.5, 0.75], id_col=id_col)
    wide = (q.groupBy("type").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
            .toDF("type", "q1", "median", "q3"))
    ext = results.groupBy("type").agg(F.min("effectiveness").alias("min"),
                                      F.max("effectiveness").alias("max"))
    return ext.join(wide, "type").select("type", "min", "q1", "median", "q3", "max")


# ---------------------------------------------------------------- history

def numbered_runs(runs: DataFrame, order: str) -> DataFrame:
    """``run_number`` 1..n in run order, from range partitions and their sizes:
    no task sees the whole history."""
    return rank_within(runs.withColumn("_all", F.lit(0)), "_all", [order], out="run_number").drop("_all")


def accuracy_series(runs: DataFrame, *, order: str = "run_no", value: str = "prediction_accuracy",
                    threshold: float = FV.ACCURACY_THRESHOLD) -> DataFrame:
    """Run number (1..n in run order), value, threshold, below-threshold flag."""
    return numbered_runs(runs, order).select("run_number", order, F.col(value).alias("value"), F.lit(threshold).alias("threshold"),
                                             (F.col(value) <= F.lit(threshold)).alias("below_threshold"))


def fpr_series(runs: DataFrame, *, order: str = "run_no",
               threshold: float = FV.FPR_THRESHOLD) -> DataFrame:
    """FPR per run (missing = 1.0), threshold and breach flag."""
    v = F.coalesce(F.col("false_positive_rate"), F.lit(1.0))
    return numbered_runs(runs, order).select("run_number", order, v.alias("value"),
                                             F.lit(threshold).alias("threshold"), (v > F.lit(threshold)).alias("breach"))


def accuracy_trend(runs: DataFrame, *, order: str = "run_no",
                   value: str = "prediction_accuracy") -> DataFrame:
    """Per run: the value two runs earlier (met by its number) and whether it was higher."""
    now = numbered_runs(runs, order)
    before = now.select((F.col("run_number") + 2).alias("run_number"), F.col(value).alias("value_2_before"))
    return now.join(before, "run_number", "left").select(
        order, F.col(value).alias("value"), "value_2_before",
        F.coalesce(F.col("value_2_before") > F.col(value), F.lit(False)).alias("declining"))


def validation_flags(runs: DataFrame) -> DataFrame:
    return runs.select("run_no", (F.col("prediction_accuracy") > FV.ACCURACY_THRESHOLD).alias("passed"),
                       (F.col("false_positive_rate") > FV.FPR_THRESHOLD).alias("high_fpr"))


def _fmt2(x) -> Column:
    # Python's "{:.2f}" rounds the exact binary value half-to-even; format
    # the numpy-rounded value so Java's HALF_UP formatting agrees.
    return F.format_string("%.2f", F.rint(x * 100) / 100)


def improvement_rules(runs: DataFrame, results: DataFrame, *, order: str = "run_no",
                      value: str = "prediction_accuracy") -> DataFrame:
    """``rule, subject, value, message`` rows for the three history rules:
    accuracy declining over the last 3 runs, a type with ≥ 3 results and mean
    effectiveness < 0.3, and ≥ 3 runs with FPR > 0.2."""
    spark = runs.sparkSession
    last3 = runs.orderBy(F.desc(order)).limit(FV.TREND_RUNS)
    trend = last3.agg(F.count("*").alias("k"), F.max_by(value, order).alias("latest"),
                      F.min_by(value, order).alias("oldest"))
    decline = (trend.filter((F.col("k") >= FV.TREND_RUNS) & (F.col("oldest") > F.col("latest")))
               .select(F.lit("accuracy_decline").alias("rule"), F.lit("model").alias("subject"),
                       F.col("latest").alias("value"), F.lit(FV.MSG_ACCURACY_DECLINE).alias("message")))
    eff = (avg_effectiveness(results)
           .filter((F.col("results") >= FV.MIN_RESULTS_FOR_RULE)
                   & (F.col("avg_effectiveness") < FV.EFFECTIVENESS_THRESHOLD))
           .select(F.lit("low_effectiveness").alias("rule"), F.col("type").alias("subject"),
                   F.col("avg_effectiveness").alias("value"),
                   F.format_string(FV.MSG_LOW_EFFECTIVENESS.replace("%.2f", "%s"), F.col("type"),
                                   _fmt2(F.col("avg_effectiveness"))).alias("message")))
    fp = (runs.agg(F.count_if(F.coalesce(F.col("false_positive_rate"), F.lit(0.0))
                              > FV.FPR_THRESHOLD).alias("n"))
          .filter(F.col("n") >= FV.MIN_HIGH_FPR_RUNS)
          .select(F.lit("high_false_positive_rate").alias("rule"), F.lit("model").alias("subject"),
                  F.col("n").cast("double").alias("value"), F.lit(FV.MSG_HIGH_FPR).alias("message")))
    del spark
    return decline.unionByName(eff).unionByName(fp)


def model_performance_log(metrics: DataFrame, model_name: str, *, ts: str = "ts",
                          metric_cols: list[str]) -> DataFrame:
    """Long form ``model_name, ts, metric, value`` (one row per metric)."""
    return (metrics.select(F.col(ts).alias("ts"), *[F.col(c).cast("double") for c in metric_cols])
            .unpivot("ts", metric_cols, "metric", "value")
            .select(F.lit(model_name).alias("model_name"), "ts", "metric", "value"))


def validation_run_detail(runs: DataFrame, *, order: str = "run_no") -> DataFrame:
    """Per run: number (1..n in run order), label ``Validation Run #n - id``
    and the metrics as two-decimal text."""
    return numbered_runs(runs, order).select(
        "run_number", order,
        F.concat(F.lit("Validation Run #"), F.col("run_number").cast("string"), F.lit(" - "),
                 F.col(order).cast("string")).alias("label"),
        _fmt2(F.col("prediction_accuracy")).alias("accuracy_text"),
        _fmt2(F.col("false_positive_rate")).alias("false_positive_rate_text"))
