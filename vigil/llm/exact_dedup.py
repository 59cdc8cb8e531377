"""Exact dedup (DataFrame functions only).

Rows are grouped by a 128-bit content hash (MD5 of the text without white
space).  Inside each group the bytes are compared: the smallest and the
largest normalised text of a group are equal exactly when all of its texts
are.  Both are aggregated below the shuffle, so a group that holds a third of
all rows costs one row per map task.  Groups whose bytes differ (a collision)
are told apart by the bytes themselves.

Defined cases: a null text is empty; all empty texts are equal; a null id
loses every tie; a row that repeats id and text counts in ``group_size`` and
shares the verdict of its twin (``drop_duplicates`` keeps one of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import documents, id_and_text, prepare, stage

#: Characters that do not count, [\x20\x09-\x0D].
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def content_hash(norm: Column) -> Column:
    """128 bits over the UTF-8 bytes."""
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_of=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256,
    n_chars.  Of equal texts the row with the most code points, then the
    smallest id, stays.  ``hash_of`` is replaceable (tests use a weak one)."""
    prepare(docs.sparkSession)
    base = id_and_text(docs, id_col, text_col)
    norm = normalised(F.col("text"))
    hashed = base.select("doc_id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm")) \
                 .withColumn("h", hash_of(F.col("norm")))
    collided = stage(hashed.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
                     .where("lo <> hi").select("h", F.lit(True).alias("clash")), "dedup-clash")
    slim = stage(hashed.join(collided, "h", "left")
                 .select("doc_id", "n_chars", "h", F.unhex(F.sha2("norm", 256)).alias("sha"),
                         F.when(F.col("clash"), F.col("norm")).alias("variant")), "dedup-slim")
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    classes = stage(slim.groupBy("h", "variant").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
                    .select(F.col("h").alias("h2"), F.col("variant").alias("variant2"), "group_size",
                            F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg")).alias("keep_chars")),
                    "dedup-classes")
    return (slim.join(classes, (F.col("h") == F.col("h2")) & F.col("variant").eqNullSafe(F.col("variant2")))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
                    .alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "n_chars"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = stage(exact_dedup(docs, id_col, text_col).where("kept")
                 .groupBy(F.col("doc_id").alias("_vg_id"), F.col("text_sha256").alias("_vg_sha"))
                 .agg(F.count(F.lit(1)).alias("_vg_rows")), "dedup-kept")
    sha = F.sha2(normalised(F.coalesce(docs[text_col], F.lit(""))), 256)
    out = docs.join(kept, docs[id_col].eqNullSafe(kept["_vg_id"]) & (sha == kept["_vg_sha"]), "left_semi")
    if kept.where("_vg_rows > 1").isEmpty():
        return out
    # rows that repeat both id and text: one of each stays, the longest
    length = F.length(F.coalesce(docs[text_col], F.lit("")))
    once = (docs.select(F.struct("*").alias("row"), docs[id_col].alias("k"), sha.alias("s"), length.alias("n"))
            .join(kept, F.col("k").eqNullSafe(F.col("_vg_id")) & (F.col("s") == F.col("_vg_sha")))
            .groupBy("k", "s").agg(F.max_by("row", "n").alias("row")))
    return once.select("row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chars")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     k AS (SELECT doc_id, norm,
                  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(txt) DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
