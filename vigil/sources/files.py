"""File sources and sinks: incident CSV/Parquet, JSON documents, append logs.

Readers always pass an explicit schema (no inference pass over the data).
Writers are the only actions in the library besides model fitting and the
streaming drivers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENT_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("location_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

ARTICLE_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("name", T.StringType())])),
])

TRACKING_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType()),
    T.StructField("hotspot_id", T.StringType()),
    T.StructField("intervention_type", T.StringType()),
    T.StructField("implementation_date", T.StringType()),
    T.StructField("effectiveness", T.DoubleType()),
    T.StructField("before_incidents", T.LongType()),
    T.StructField("after_incidents", T.LongType()),
    T.StructField("notes", T.StringType()),
])

VALIDATION_RUN_SCHEMA = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in ("spatial_accuracy", "type_accuracy", "risk_correlation",
                                                 "false_positive_rate", "overall_accuracy")],
    T.StructField("passed", T.BooleanType()),
    T.StructField("ts", T.TimestampType()),
])


def read_incident_csv(spark: SparkSession, path: str) -> DataFrame:
    """Incident CSV with quoted multi-line fields and doubled quotes: one
    record per logical row, not per physical line."""
    return (spark.read.schema(INCIDENT_SCHEMA).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .csv(path))


def write_incidents(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Full overwrite (Parquet by default, CSV for interchange)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-document JSON with a ``_corrupt_record`` column: corrupt input
    surfaces as a row with the raw text instead of failing the job, and a
    missing file gives no rows."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    return (spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def write_json_document(df: DataFrame, path: str) -> None:
    """JSON lines (map keys become strings, as JSON requires)."""
    df.write.mode("overwrite").json(path)


def read_text_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: UTF-8 when the bytes are valid UTF-8, UTF-16 when a
    byte-order mark says so, otherwise Latin-1 (which decodes any bytes).
    The validity test guards each branch, so no decode ever throws."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    head = F.hex(F.substring("content", 1, 2))
    text = (F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
            .when(head.isin("FFFE", "FEFF"), F.decode("content", "UTF-16"))
            .otherwise(F.decode("content", "ISO-8859-1")))
    return raw.select("path", text.alias("text"))


def read_json_any_encoding(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parse documents read with :func:`read_text_any_encoding`."""
    return read_text_any_encoding(spark, path).select(
        "path", F.from_json(F.col("text"), schema).alias("doc"))


def append_tracking(df: DataFrame, path: str) -> None:
    """Append-only tracking log, partitioned by intervention type."""
    df.write.mode("append").partitionBy("intervention_type").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches the path (local, HDFS, object stores; globs)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append log; before its first append it has no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark, path, TRACKING_SCHEMA)


def append_validation_runs(df: DataFrame, path: str) -> None:
    """Validation history is kept append-only (never rewritten)."""
    df.write.mode("append").parquet(path)


def put_validation_run(df: DataFrame, path: str) -> None:
    """A history with one folder a run, named after its ``ts``: writing a run
    again replaces it and leaves the others alone."""
    (df.withColumn("run", F.date_format("ts", "yyyyMMddHHmmss")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def read_validation_runs(spark: SparkSession, path: str) -> DataFrame:
    return _log(spark, path, VALIDATION_RUN_SCHEMA).select(VALIDATION_RUN_SCHEMA.names)


def land_articles(df: DataFrame, path: str) -> None:
    """Landed articles partitioned by publication day, so day-range
    predicates prune whole directories."""
    (df.withColumn("published_day", F.to_date("published_at"))
     .write.mode("append").partitionBy("published_day").parquet(path))


def read_landed_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_recommendations(recs: DataFrame, path: str) -> None:
    """Recommendations partitioned by risk band (one directory per band), so
    a band view reads only its own files."""
    recs.write.mode("overwrite").partitionBy("risk_level").parquet(path)
