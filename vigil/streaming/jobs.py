"""Structured Streaming jobs for ingest, counting, grid upkeep and state.

Sources are file streams over landed Parquet/JSON with explicit schemas.
Sinks go through ``foreachBatch`` into the shared checkpoint folder, one
``batch=<id>`` directory per micro-batch written with overwrite, so a retried
batch replaces its own output (idempotent) and a restart resumes from the
streaming checkpoint. ``run_available`` drives a job to completion with
``trigger(availableNow=True)`` and returns the newest version of every key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions.geo import floor_bin, valid_point
from vigil.operators import extraction as X
from vigil.operators.interventions import tracker_effectiveness
from vigil.session import checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """File stream over one landed table (explicit schema, no inference)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    # a glob on the file name keeps the source to this one table
    return reader.parquet(path[:-1] + "[" + path[-1] + "]")


def _exists(spark: SparkSession, path: str) -> bool:
    """Path test through the Hadoop FileSystem (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def batch_sink(out: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch writer: one overwrite directory per batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        df = transform(batch) if transform else batch
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def run_available(stream: DataFrame, *, name: str, mode: str = "update", keys: list[str] | None = None,
                  transform: Callable[[DataFrame], DataFrame] | None = None,
                  base: str | None = None) -> DataFrame:
    """Run ``stream`` over everything available, then read its output.

    With ``keys`` (update-mode aggregates) the newest version per key wins;
    without keys all emitted rows are returned.
    """
    spark = stream.sparkSession
    base = base or scratch(spark, name)
    q = (stream.writeStream.outputMode(mode).foreachBatch(batch_sink(f"{base}/out", transform))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if not _exists(spark, f"{base}/out"):
        # nothing arrived: same columns, no rows
        empty = spark.createDataFrame([], stream.schema)
        return transform(empty) if transform else empty
    res = spark.read.parquet(f"{base}/out")
    if not keys:
        return res.drop("batch")
    vals = [c for c in res.columns if c not in keys and c != "batch"]
    return (res.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("batch")).alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals]))


# ---------------------------------------------------------------- ST1 / ST4

def article_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed articles as a stream, in the article schema (nested source)."""
    d = table_stream(spark, sf_dir, "documents", maxFilesPerTrigger=1)
    day_no = F.col("doc_id") % 30
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.when(F.col("doc_id") % 27 == 0, F.col("text")).otherwise(F.substring("text", 1, 40)).alias("title"),
        F.when(F.col("doc_id") % 27 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
        .alias("description"), "lang",
        F.struct(F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
                 .otherwise(F.col("source")).alias("name")).alias("source"),
        F.date_add(F.lit("2024-01-01").cast("date"), day_no.cast("int")).cast("timestamp")
        .alias("published_at"))


def dedup_fanout_stream(articles: DataFrame, category_terms, *, lang: str = FV.DEFAULT_LANG,
                        watermark: str = "40 days") -> DataFrame:
    """(article, category) rows, each emitted once while within the
    watermark (state for older keys is dropped)."""
    fan = X.category_fanout(articles.filter(F.col("lang") == lang), category_terms)
    return (fan.withWatermark("published_at", watermark)
            .dropDuplicatesWithinWatermark(["article_id", "category"])
            .select("article_id", "category", "relevance"))


def incident_stream_transform(gazetteer: DataFrame, category_terms, keywords,
                              lang: str = FV.DEFAULT_LANG) -> Callable[[DataFrame], DataFrame]:
    """Per micro-batch incident build (stream–static gazetteer join). An
    article is complete inside its batch, so extraction per batch is exact;
    streams do not rank, so there is no per-category top-k."""
    def build(batch: DataFrame) -> DataFrame:
        en = batch.filter(F.col("lang") == lang)
        inc = X.build_incidents(en, gazetteer, category_terms=category_terms, keywords=keywords)
        return inc.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return build


# ---------------------------------------------------------------- ST2 / ST3 / ST5 / ST7

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def pane_start(ts: str, pane: str) -> Column:
    """Start of the pane ("1 hour", "2 days") that a time lies in; null stays null."""
    n, unit = pane.split()
    micros = int(n) * _SECONDS[unit.rstrip("s")] * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(F.col(ts)) / micros).cast("bigint") * micros)


def _drain(stream: DataFrame, write: Callable[[DataFrame, int], None], base: str) -> None:
    q = (stream.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def pane_counts(events: DataFrame, *, pane: str, keys: list[str], name: str, ts: str = "date",
                lateness: str | None = None, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Event-time counts of an ``append`` stream in tumbling panes: ``(panes,
    dropped)``, both running totals over all runs with the same ``base``.

    A micro-batch adds up its own rows by pane and key (map-side first) and
    writes them under its batch id; counts add, so nothing is kept in stream
    state, rows may come in any order and a retried batch replaces its rows.
    ``panes``: pane_start, keys, n. With ``lateness`` a row that lies further
    than that behind the newest row of all earlier batches is late: it is not
    counted but stands in ``dropped`` (pane_start, keys, n). Without it no row
    is dropped, whatever backlog lands in whatever order; only rows without a
    time are (pane_start null).
    """
    spark = events.sparkSession
    base = base or scratch(spark, name)
    out = f"{base}/panes"

    def write(batch: DataFrame, batch_id: int) -> None:
        late = F.col(ts).isNull()
        if lateness is not None and _exists(spark, out):
            newest = spark.read.parquet(out).filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            if newest is not None:
                late = late | (F.col(ts) < F.lit(newest).cast("timestamp") - F.expr(f"interval {lateness}"))
        (batch.withColumn("late", late).groupBy(pane_start(ts, pane).alias("pane_start"), *keys, "late")
         .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    _drain(events, write, base)
    if not _exists(spark, out):
        none = events.select(F.col(ts).alias("pane_start"), *keys, F.lit(0).cast("bigint").alias("n"))
        none = spark.createDataFrame([], none.schema)
        return none, none
    total = (spark.read.parquet(out).groupBy("late", "pane_start", *keys).agg(F.sum("n").alias("n")))
    return tuple(total.filter(c).drop("late") for c in (~F.col("late"), F.col("late")))


def windows_of(panes: DataFrame, *, keys: list[str], duration: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows rolled up from panes that divide them:
    window_start, keys, n. Only panes are spread over windows, no rows."""
    w = F.window("pane_start", duration, slide) if slide else F.window("pane_start", duration)
    return panes.groupBy(w.getField("start").alias("window_start"), *keys).agg(F.sum("n").alias("n"))


def grid_events(incidents: DataFrame, resolution: float = FV.GRID_RESOLUTION) -> DataFrame:
    """Incidents with their fixed-origin grid cell (a stream cannot re-derive
    the extent, so the origin is 0,0)."""
    return (incidents.filter(valid_point("latitude", "longitude"))
            .select("date", floor_bin("latitude", resolution).alias("i"), floor_bin("longitude", resolution).alias("j")))


def rolling_grid_counts(incidents: DataFrame, *, name: str, resolution: float = FV.GRID_RESOLUTION,
                        days: int = FV.PREDICTION_DAYS, lateness: str | None = None, base: str | None = None) -> DataFrame:
    """Counts per grid cell over sliding ``days``-day windows: daily panes once,
    windows from panes."""
    panes, _ = pane_counts(grid_events(incidents, resolution), pane="1 day", keys=["i", "j"], name=name, lateness=lateness, base=base)
    return (windows_of(panes, keys=["i", "j"], duration=f"{days} days", slide="1 day")
            .select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "i", "j", "n"))


# ---------------------------------------------------------------- ST6

def recent_effectiveness_table(follow_up: DataFrame, *, name: str, n: int = FV.RECENT_RUNS,
                               base: str | None = None) -> DataFrame:
    """``intervention_type, recent, seen``: the mean of the ``n`` latest tracker
    effectiveness values of each type and the records seen, over all runs with
    the same ``base``.

    A keyed table with one version per micro-batch: the batch's ``n`` latest
    rows of each type (a group limit below the shuffle: each task ships at most
    ``n`` of a type) are merged with the version before and written under the
    batch id, so a retried batch replaces its version and arrival order plays
    no part.
    """
    spark = follow_up.sparkSession
    base = base or scratch(spark, name)
    out = f"{base}/versions"
    order = Window.partitionBy("intervention_type").orderBy(F.desc("at"), F.desc("record_id"))

    def latest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("intervention_type", "record_id", F.col("implementation_date").cast("timestamp").alias("at"),
                            tracker_effectiveness("before_incidents", "after_incidents").alias("effectiveness"))
        top, seen = latest(rows), rows.groupBy("intervention_type").agg(F.count(F.lit(1)).alias("seen"))
        if _exists(spark, out):
            before = spark.read.parquet(out).filter(F.col("batch") < batch_id)
            version = before.agg(F.max("batch")).first()[0]
            if version is not None:
                before = before.filter(F.col("batch") == version)
                top = latest(top.unionByName(before.select(*top.columns)))
                seen = (seen.unionByName(before.select("intervention_type", "seen").distinct())
                        .groupBy("intervention_type").agg(F.sum("seen").alias("seen")))
        top.join(seen, "intervention_type").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _drain(follow_up, write, base)
    if not _exists(spark, out):
        return spark.createDataFrame([], "intervention_type string, recent double, seen long")
    versions = spark.read.parquet(out)
    last = versions.agg(F.max("batch")).first()[0]
    return (versions.filter(F.col("batch") == F.lit(last)).groupBy("intervention_type")
            .agg(F.avg("effectiveness").alias("recent"), F.first("seen").alias("seen")))


# ---------------------------------------------------------------- ST8

def validation_history_stream(orders: DataFrame) -> DataFrame:
    """Monthly run metrics maintained incrementally (update mode; the sink
    keeps the newest version of each run)."""
    return (orders.groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("run_no"))
            .agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"),
                 F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"),
                 F.count("*").alias("n")))


def spike_feed(panes: DataFrame, *, keys: list[str], duration: str = "1 day", slide: str = "1 hour", k: float = 3.0) -> DataFrame:
    """Windows of the panes against the key's history, the mean and sample sd
    of its daily counts (days with rows), taken from the same panes: flagged
    when ``n > mean + k·sd``."""
    daily = windows_of(panes, keys=keys, duration="1 day")
    baseline = daily.groupBy(*keys).agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    return (windows_of(panes, keys=keys, duration=duration, slide=slide).join(baseline, keys, "left")
            .withColumn("alert", F.coalesce(F.col("n") > F.col("mean") + k * F.col("sd"), F.lit(False))))


def hot_window_cells(window_counts: DataFrame, pct: float = FV.HOT_PERCENTILE) -> DataFrame:
    """Hot cells per rolling window from the streamed cell counts.

    A global percentile is not incremental, so it runs as a batch step over
    the stream's output: per window the exact percentile of the occupied
    cells' counts (a value→frequency map bounded by distinct counts), joined
    back on the window key; cells at or above it are hot.
    """
    thr = (window_counts.groupBy("window_start")
           .agg(F.percentile("n", F.lit(pct)).alias("threshold")))
    return (window_counts.join(thr, "window_start")
            .filter(F.col("n") >= F.col("threshold"))
            .select("window_start", "i", "j", "n"))
