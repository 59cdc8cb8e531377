"""Region similarity (transfer-learning neighbours), risk index and spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.sources import dimensions as dims
from vigil.sources.files import path_exists


def default_similarity(spark: SparkSession) -> DataFrame:
    """Document used when no similarity data exists."""
    return spark.createDataFrame([(FV.DEFAULT_REGION, [FV.DEFAULT_SIMILAR_REGION],
                                   [FV.DEFAULT_REGION_WEIGHT])],
                                 "region string, similar_regions array<string>, weights array<double>")


def load_similarity(spark: SparkSession, path: str) -> DataFrame:
    """The stored region documents (JSON), or the default one where none are."""
    default = default_similarity(spark)
    if not path_exists(spark, path):
        return default
    return spark.read.schema(default.schema).option("multiLine", True).json(path)


def region_docs(edges: DataFrame) -> DataFrame:
    """Edge rows → one document per region with parallel arrays (a region's
    neighbour list is bounded by the number of regions)."""
    return (edges.groupBy("region")
            .agg(F.array_sort(F.collect_list(F.struct("similar_region", "weight"))).alias("_e"))
            .select("region", F.col("_e.similar_region").alias("similar_regions"),
                    F.col("_e.weight").alias("weights")))


def region_edges(docs: DataFrame) -> DataFrame:
    """Parallel arrays → ``region, similar_region, weight`` (zip + explode)."""
    return (docs.select("region", F.explode(F.arrays_zip("similar_regions", "weights")).alias("e"))
            .select("region", F.col("e.similar_regions").alias("similar_region"),
                    F.col("e.weights").alias("weight")))


def upsert_regions(current: DataFrame, new: DataFrame, key: str = "region") -> DataFrame:
    """Replace all rows of the regions present in ``new`` (idempotent)."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def parse_region_form(df: DataFrame, regions_text: str = "regions_text",
                      weights_text: str = "weights_text") -> DataFrame:
    """Split newline lists, trim, drop blanks, weights to double; ``valid``
    when both lists have the same length (unequal forms are rejected)."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    clean = lambda c: F.filter(F.transform(F.split(F.col(c), "\n"), strip), lambda x: x != "")
    regions = clean(regions_text)
    weights = F.transform(clean(weights_text), lambda x: x.cast("double"))
    return df.select("*", regions.alias("similar_regions"), weights.alias("weights")) \
        .withColumn("valid", F.size("similar_regions") == F.size("weights"))


def region_training_set(rows: DataFrame, edges: DataFrame, *, region: str = "region",
                        id_col: str = "incident_id") -> DataFrame:
    """Training rows per target region: its own rows (weight 1.0) plus the
    rows of each similar region weighted by the similarity (an equi-join on
    region; each row meets at most its region's neighbour list)."""
    own = rows.select(F.col(region).alias("target_region"), id_col, F.lit(1.0).alias("weight"))
    nb = (rows.select(F.col(region).alias("similar_region"), id_col)
          .join(edges.select(F.col("region").alias("target_region"), "similar_region", "weight"),
                "similar_region")
          .select("target_region", id_col, "weight"))
    return own.unionByName(nb)


def risk_factor_index(factors: DataFrame, *, id_col: str, factor_cols: list[str]) -> DataFrame:
    """Σ weight × value over the supplied factor columns (absent factors add
    nothing); weights come from the fixed 8-row table."""
    w = dims.risk_factor_weights(factors.sparkSession)
    long = factors.select(id_col, *[F.col(c).cast("double") for c in factor_cols]) \
        .unpivot(id_col, factor_cols, "factor", "value")
    return (long.join(F.broadcast(w), "factor")
            .groupBy(id_col).agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0)))
                                 .alias("risk_index")))


def daily_counts(incidents: DataFrame, *, keys=("location_name", "category"),
                 ts: str = "date") -> DataFrame:
    return (incidents.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n")))


def spike_alerts(counts: DataFrame, *, keys=("location_name", "category"), window: int = 7,
                 k: float = 3.0) -> DataFrame:
    """Alert when a day's count exceeds mean + k·sd of the previous
    ``window`` calendar days of the same series; days without a row count as
    0, and a day with no row at all in its window has no mean and no alert.

    The window runs over already aggregated daily counts; a series holds one
    row per day, so each window partition is bounded by the number of days.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-window, -1)
    total, squares = F.sum("n").over(w), F.sum(F.col("n") * F.col("n")).over(w)
    days = F.lit(float(window))
    sd = F.sqrt(F.greatest((squares - total * total / days) / (days - 1), F.lit(0.0)))
    return (counts.select(*keys, "day", "n", (total / days).alias("mean"),
                          F.when(total.isNotNull(), sd).alias("sd"))
            .withColumn("alert", F.coalesce(F.col("n") > F.col("mean") + k * F.col("sd"),
                                            F.lit(False))))
