"""Filter interaction audit: what each filter removes in every order of the
filters, and what of it another filter would have removed anyway.

A document is a row of a mask matrix over the filters: 0 where it fails, never
where it passes.  An order of the filters is a column of a position matrix, the
inverse permutation.  Their min-plus product is the removal rank: the first
step at which the document goes, or never.  Scatter adds of the documents'
weights at (order, rank) give all counts.  A document counts by its part and
mask alone, so Spark adds up equal masks below the shuffle and a part costs at
most 2**filters rows, however many documents it has.

Defined cases: a null text is empty; a null part is the empty string; rows
without an id are compared as texts but have no smaller id and are no one's;
rows that repeat an id are documents of their own and no copies of each other;
of repeated labels any 1 counts; an empty table has no parts.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import documents, prepare, stage, text_or_empty

#: The rank of a document that no filter removes.
NEVER = 1 << 20
#: Fixed values of the five filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
_GAP = r"[\x20\x09-\x0D]+"


def orders_of(filters: str) -> np.ndarray:
    """All orders, one a row: numbers of the filters, first applied first."""
    return np.array(list(itertools.permutations(range(len(filters)))), dtype=np.int64).reshape(-1, len(filters))


def removal_ranks(fails: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """documents x orders: the step (from 0) that removes the document, NEVER
    and more where none does: the min-plus product of masks and positions."""
    mask = np.where(fails, 0, NEVER)
    position = np.argsort(orders, axis=1)
    out = np.full((len(mask), len(orders)), 2 * NEVER, dtype=np.int64)
    for f in range(mask.shape[1]):
        np.minimum(out, mask[:, f, None] + position[None, :, f], out=out)
    return out


def interactions(fails: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by (order, step), the last axis the weights' where it has one:
    kept, removed, redundant; unique_fails and shapley are by the step's filter."""
    n_orders, k = orders.shape
    ranks = removal_ranks(fails, orders)
    removed = np.zeros((n_orders, k + 1, weights.shape[1]), dtype=np.int64)
    every = np.broadcast_to(np.arange(n_orders), ranks.shape)
    np.add.at(removed, (every, np.minimum(ranks, k)), weights[:, None, :])
    removed = removed[:, :k]
    failing = (fails[:, :, None] * weights[:, None, :]).sum(axis=0)
    alone = fails & (fails.sum(axis=1) == 1)[:, None]
    shapley = np.zeros((k, weights.shape[1]), dtype=np.int64)
    np.add.at(shapley, orders, removed)
    return {"removed": removed, "kept": weights.sum(axis=0) - np.cumsum(removed, axis=1),
            "redundant": failing[orders] - removed,
            "unique_fails": (alone[:, :, None] * weights[:, None, :]).sum(axis=0)[orders],
            "shapley": shapley[orders]}


def audit(marked: DataFrame, filters: str, part_col: str = "part", mask_col: str = "mask",
          weights: Sequence[str] = ()) -> DataFrame:
    """``marked`` has one row per document: its part, its mask (bit f: it fails
    filter f) and 0/1 columns ``weights``.  One row per part, order and step:
    part, filter_order, step, kept, removed, redundant, unique_fails,
    <weight>_lost of each weight, shapley."""
    orders = orders_of(filters)
    names = ["".join(filters[f] for f in o) for o in orders]
    counted = (marked.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(mask_col).cast("long").alias("mask"),
                             *[F.col(w).cast("long").alias(w) for w in weights])
               .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(w) for w in weights]))
    lost = [f"{w}_lost" for w in weights]

    def of_part(frame: pd.DataFrame) -> pd.DataFrame:
        fails = (frame["mask"].to_numpy()[:, None] >> np.arange(len(filters)) & 1).astype(bool)
        found = interactions(fails, frame[["n", *weights]].to_numpy(dtype=np.int64), orders)
        rows = pd.DataFrame({c: found[c][:, :, 0].ravel() for c in ("kept", "removed", "redundant", "unique_fails", "shapley")})
        for i, c in enumerate(lost):
            rows[c] = found["removed"][:, :, i + 1].ravel()
        rows["part"], rows["filter_order"] = frame["part"].iloc[0], np.repeat(names, len(filters))
        rows["step"] = np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders))
        return rows

    columns = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    return counted.groupBy("part").applyInPandas(
        of_part, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text."""
    words = F.array_remove(F.split(text, _GAP), "")
    return {"A": F.size(words) < LEAST_WORDS,
            "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text),
            "D": text.rlike(SIGNS)}


def marked_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document under the filters A to E (E:
    a smaller id has the same text)."""
    prepare(docs.sparkSession)
    text = text_or_empty("text")
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(text_filters(text).values())]
    rows = stage(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"),
                             functools.reduce(Column.__add__, bits).alias("mask")), "audit-rows")
    first = (rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("key", "least"))
    marks = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    copy = F.when(F.col("doc_id") > F.col("least"), F.lit(16)).otherwise(F.lit(0))
    return (rows.join(first, "key", "left").join(marks, "doc_id", "left")
            .select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"),
                    F.coalesce("toxic", F.lit(0)).alias("toxic")))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return audit(marked_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "ABCDE", weights=["good", "toxic"])


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt FROM documents),
     w AS (SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS words FROM t),
     m AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
                  100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 5 * length(txt) AS c,
                  regexp_matches(txt, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY txt) AS e FROM w),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                  max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
     g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
           FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
     o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM x p, x q, x r, x s, x u
           WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
     k AS (SELECT unnest(range(1, 6))::INT AS step),
     j AS (SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS f, g.a, g.b, g.c, g.d, g.e,
                  coalesce(least(CASE WHEN a THEN strpos(filter_order, 'A') END, CASE WHEN b THEN strpos(filter_order, 'B') END,
                                 CASE WHEN c THEN strpos(filter_order, 'C') END, CASE WHEN d THEN strpos(filter_order, 'D') END,
                                 CASE WHEN e THEN strpos(filter_order, 'E') END), 99) AS gone FROM g, o, k),
     h AS (SELECT *, CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
                  a::INT + b::INT + c::INT + d::INT + e::INT AS all_fails FROM j),
     y AS (SELECT part, filter_order, step, f,
                  sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
                  sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
                  sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
                  sum(CASE WHEN fails AND all_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                  sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
                  sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
           FROM h GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y
"""
