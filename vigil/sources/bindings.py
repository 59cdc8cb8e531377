"""Bindings of the operator inputs to the driver's tables.

The inputs the operators consume (incidents, articles, gazetteer, follow-up
records, validation history, region similarity) are derived from the TPC-H-ish
test tables by the deterministic rules in FIXTURES.md. Each binding is a lazy
DataFrame whose size grows with the underlying table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.tables import read_table

# Test-fixture values (FIXTURES.md): the generated documents carry none of the
# real crime words, so frequent tokens stand in for them.
TEST_CATEGORY_TERMS = [("murder", "thble"), ("robbery", "thtion"), ("assault", "thing"),
                       ("theft", "attion"), ("shooting", "erble"), ("crime", "ertion")]
TEST_GAZETTEER = [("thanea", 40.1, -0.2), ("oning", 40.2, 0.1), ("eriner", 40.3, 0.0),
                  ("thanedble", 40.4, 0.2), ("onble", 40.25, -0.1)]
TEST_SENTENCE_KEYWORDS = [t for _, t in TEST_CATEGORY_TERMS]
ARTICLE_EPOCH = "2024-01-01"
TRAIN_CUTOFF = "2024-01-24"


def _category_of(event_type: Column) -> Column:
    return (F.when(event_type == "click", "theft")
            .when(event_type == "view", "robbery")
            .when(event_type == "signup", "assault")
            .when(event_type == "purchase", "murder")
            .otherwise("shooting"))


def incidents(spark: SparkSession, sf_dir: str, with_source: bool = True) -> DataFrame:
    """Incident table: one row per event, geocoded on a 500×500 lattice."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return incidents_from(e, read_table(spark, sf_dir, "nation", "n_nationkey", "n_name"),
                          with_source=with_source)


def incidents_from(e: DataFrame, nation: DataFrame, with_source: bool = True) -> DataFrame:
    """Incident rows from an events frame (batch or stream) and nation."""
    # nation is the fixed 25-row TPC-H dimension: a proven broadcast bound.
    n = F.broadcast(nation)
    lat = F.lit(40.0) + ((F.col("user_id") * 7919 + (F.col("event_id") % 5) * 13) % 500) / F.lit(1021.0)
    lon = (((F.col("user_id") * 104729 + (F.col("event_id") % 3) * 29) % 500) - 250) / F.lit(1021.0)
    cols = [F.col("event_id").alias("incident_id"),
            F.col("ts").cast("timestamp").alias("date"),
            _category_of(F.col("event_type")).alias("category"),
            F.col("n_name").alias("location_name"),
            lat.alias("latitude"), lon.alias("longitude")]
    if with_source:
        cols.append(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"))
    return (e.join(n, n.n_nationkey == e.user_id % 25, "inner").select(*cols))


def train_actual(spark: SparkSession, sf_dir: str, cutoff: str = TRAIN_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Time split: hotspots are built on *train*, validated on *actual*."""
    inc = incidents(spark, sf_dir)
    cut = F.lit(cutoff).cast("timestamp")
    return inc.filter(F.col("date") < cut), inc.filter(F.col("date") >= cut)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed news articles (nested ``source`` struct as the news feed has it)."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    day_no = F.col("doc_id") % 30
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("doc_id") % 27 == 0, F.col("text")).otherwise(F.substring("text", 1, 40)).alias("title"),
        F.when(F.col("doc_id") % 27 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("text")).alias("description"),
        F.col("lang"),
        F.struct(F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
                  .otherwise(F.col("source")).alias("name")).alias("source"),
        F.date_add(F.lit(ARTICLE_EPOCH).cast("date"), day_no.cast("int")).alias("published_at"),
    )


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEST_GAZETTEER, "place string, latitude double, longitude double")


def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervention follow-up records (before = 0 occurs)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
                   "o_orderdate")
    p = F.substring("o_orderpriority", 1, 1)
    kind = (F.when(p == "1", "police_patrol").when(p == "2", "community_outreach")
            .when(p == "3", "environmental_modification").when(p == "4", "public_awareness")
            .otherwise("targeted_enforcement"))
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.concat(F.lit("hotspot_"), (F.col("o_custkey") % 20).cast("string")).alias("hotspot_id"),
        kind.alias("intervention_type"),
        F.col("o_orderdate").cast("timestamp").alias("implementation_date"),
        (F.col("o_orderkey") % 20).alias("before_incidents"),
        (F.col("o_custkey") % 15).alias("after_incidents"),
    )


def validation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly validation runs derived from orders (80 at every scale)."""
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return (o.groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("run_no"))
            .agg((F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) * 1.0
                  / F.count(F.lit(1))).alias("prediction_accuracy"),
                 (F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)) * 1.0
                  / F.count(F.lit(1))).alias("false_positive_rate")))


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External factors: one map segment → scaled balance per customer."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    return c.select("c_custkey", F.create_map("c_mktsegment", F.col("c_acctbal") / F.lit(10000.0)).alias("factors"))


def text_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident ids with their time as text, in four spellings, one of them bad."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts")
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    return e.select(F.col("event_id").alias("incident_id"),
                    F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
                    .when(k == 2, F.date_format(ts, " dd/MM/yyyy HH:mm")).otherwise(F.date_format(ts, "yyyy-13-dd 'soon'")).alias("date_text"))


def region_similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity edges between the 5 TPC-H regions (fixed-size dimension):
    every region a ≠ b, weight ``1 / (1 + |key_a - key_b|)``. Each region is
    expanded over the key range and equi-joined on the other key."""
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    lo_hi = r.agg(F.struct(F.min("r_regionkey").alias("lo"), F.max("r_regionkey").alias("hi"))).scalar()
    a = r.select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("ka"),
                 F.explode(F.sequence(lo_hi.getField("lo"), lo_hi.getField("hi"))).alias("kb"))
    b = r.select(F.col("r_regionkey").alias("kb"), F.col("r_name").alias("similar_region"))
    return (a.join(F.broadcast(b), "kb").filter(F.col("ka") != F.col("kb"))
            .select("region", "similar_region",
                    (F.lit(1.0) / (1 + F.abs(F.col("ka") - F.col("kb")))).alias("weight")))
