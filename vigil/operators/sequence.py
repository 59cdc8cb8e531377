"""Ordered per-key sequences without single-task windows.

A ``Window.partitionBy(key)`` puts every row of a key into one task; with a
handful of keys (intervention types) that is a handful of tasks for the whole
table, and a key holding a third of the rows is a third of the job in one
task. Here the order is established by range partitioning on
``(key, order...)`` — Spark samples split points, so a hot key is spread over
many partitions — and the rank of each row inside its key is the sum of its
position inside the partition and the row counts of the earlier partitions
of the same key. Those counts form a frame of at most
``partitions × keys`` rows, the only thing that is ever windowed by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir, materialize

_LOW_BITS = (1 << 33) - 1


def rank_within(df: DataFrame, key: str, order: list[str], *, out: str = "seq",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its ``key`` in
    ``order`` (which must make rows unique within a key)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    checkpoint_dir(df.sparkSession)
    # Physical positions are only meaningful on one materialisation: AQE may
    # coalesce the same exchange differently for two consumers, so the ranged
    # rows are written once to the shared checkpoint folder (this also cuts
    # the lineage; a lost executor re-reads the checkpoint, not the source).
    ranged = materialize(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    # per (partition, key): first position and row count — ≤ partitions × keys rows
    blocks = ranged.groupBy("_pid", key).agg(F.min("_pos").alias("_first"),
                                             F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
                         .select("_pid", key, "_first", "_before"))
    # ≤ partitions + keys rows; the join is left to measured sizes
    return (ranged.join(blocks, ["_pid", key])
            .select(*cols, (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias(out)))


def trailing_mean(df: DataFrame, key: str, order: list[str], value: str, n: int, *,
                  id_col: str, out: str = "trailing_mean", block_rows: int = 1 << 16) -> DataFrame:
    """Mean of ``value`` over the current row and up to ``n - 1`` preceding
    rows of the same key (fewer at the start of a key).

    Rows are ranked with :func:`rank_within`, then cut into blocks of
    ``block_rows`` consecutive ranks per key. The last ``n - 1`` rows of every
    block are copied into the next block as a halo, so a window
    ``rowsBetween(-(n-1), 0)`` partitioned by ``(key, block)`` sees every
    predecessor; halo rows are dropped afterwards. Each window partition holds
    at most ``block_rows + n - 1`` rows, even for a key with a third of the
    table, and the data is shuffled about ``1 + (n - 1) / block_rows`` times.
    """
    from pyspark.sql import Window
    ranked = rank_within(df.select(key, id_col, value, *[c for c in order if c != id_col]),
                         key, order)
    blk = F.floor((F.col("seq") - 1) / F.lit(block_rows)).cast("bigint")
    main = ranked.select(key, id_col, value, "seq", blk.alias("_blk"), F.lit(False).alias("_halo"))
    halo = (ranked.filter(F.pmod(F.col("seq") - 1, F.lit(block_rows)) >= block_rows - (n - 1))
            .select(key, id_col, value, "seq", (blk + 1).alias("_blk"), F.lit(True).alias("_halo")))
    w = Window.partitionBy(key, "_blk").orderBy("seq").rowsBetween(-(n - 1), 0)
    return (main.unionByName(halo).withColumn(out, F.avg(value).over(w))
            .filter(~F.col("_halo")).select(key, id_col, out))


def exact_quantiles(df: DataFrame, key: str, value: str, qs: list[float], *,
                    id_col: str) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``key``:
    ``key, q, quantile``.

    Values are ranked inside their key with :func:`rank_within` (range
    partitioning, so a key holding a third of the rows spans many tasks);
    per-key counts come from a partial aggregate; the two neighbours of every
    quantile position are fetched with an equi-join on ``(key, seq)``.
    """
    ranked = rank_within(df.select(key, id_col, value).filter(F.col(value).isNotNull()),
                         key, [value, id_col])
    counts = ranked.groupBy(key).agg(F.count("*").alias("_c"))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    pos = (counts.select(key, "_c", F.explode(qarr).alias("q"))
           .withColumn("_p", F.col("q") * (F.col("_c") - 1))
           .withColumn("_lo", F.floor("_p").cast("bigint") + 1)
           .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_c")))
           .withColumn("_f", F.col("_p") - F.floor("_p")))
    v = ranked.select(key, "seq", value)
    lo = v.select(key, F.col("seq").alias("_lo"), F.col(value).alias("_vlo"))
    hi = v.select(key, F.col("seq").alias("_hi"), F.col(value).alias("_vhi"))
    return (pos.join(lo, [key, "_lo"]).join(hi, [key, "_hi"])
            .select(key, "q", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f"))
                    .alias("quantile")))
