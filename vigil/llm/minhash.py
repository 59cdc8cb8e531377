"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the high bits choose a bin, the rest
compete for its minimum.  An empty bin borrows from a full one: it tries bins
in a pseudo-random order of its own (optimal densification).  Of each minimum
the low bits are stored, packed; the likeness of two fingerprints is the share
of equal slots, corrected for slots that agree by chance.

Defined cases: a null text is empty; an empty text (no words) has the empty
fingerprint, which is like another empty one (1) and nothing else (0); fewer
than five words are one shingle; a single document is its own successor; of
rows with the same id the smaller text comes first; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, documents, id_and_text, mix64, prepare, shingle_hashes, text_groups, word_hashes

SHINGLE_WORDS = 5
BINS = 512            # a power of two
BITS = 4              # stored of each bin: 4 or 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _borrow(table: np.ndarray) -> None:
    """Fill the empty bins of every row that has a full one, in place."""
    bins = table.shape[1]
    source = table.copy()
    full = source != _EMPTY
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    turn = 0
    while len(row):
        if turn < 4 * bins:                     # independent draws of each bin
            pick = (mix64(col.astype(np.uint64) * np.uint64(0x10001) + np.uint64(turn << 32)) % np.uint64(bins)).astype(np.int64)
        else:                                   # sure to end
            pick = (col + turn) % bins
        found = full[row, pick]
        table[row[found], col[found]] = source[row[found], pick[found]]
        row, col = row[~found], col[~found]
        turn += 1


def slots(texts: list[str], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The stored values (texts x bins) and whether a text has any shingle."""
    hashes, begin = shingle_hashes(*word_hashes(texts), SHINGLE_WORDS)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    shift = np.uint64(64 - (bins - 1).bit_length())
    table = np.full(len(texts) * bins, _EMPTY, dtype=np.uint64)
    at = owner * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(table, at, mix64(hashes) >> np.uint64(1))
    table = table.reshape(len(texts), bins)
    some = np.diff(begin) > 0
    _borrow(table)
    # the bin takes part: borrowed minima must not agree by chance all at once
    table ^= np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(table) & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def packed(values: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints as hex digits."""
    raw = (values[:, 0::2] << 4) | values[:, 1::2] if bits == 4 else values
    return [r.tobytes().hex() if ok else "" for r, ok in zip(raw, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for chance, between 0 and 1."""
    chance = 2.0 ** -bits
    estimate = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, estimate, (some_a == some_b).astype(float))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id and fingerprint of each document."""
    prepare(docs.sparkSession)
    base = id_and_text(docs, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            prints = [p for part in text_groups(f["text"].tolist()) for p in packed(*slots(part, bins, bits), bits)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "fingerprint": prints})

    return base.mapInPandas(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fingerprint string")


# --- neighbours in descending id order ---------------------------------------

def in_descending_order(docs: DataFrame) -> DataFrame:
    """Rows doc_id, text dealt into ranges of ids and sorted within a partition
    by range, halo, descending id.  Each range also ends in a ``halo`` copy of
    the row that follows it (after the last: the first), so that a task meets
    every row together with its successor.  What goes through the driver is one
    boundary and one id per partition."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / parts for k in range(1, parts)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0]
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        out = np.full(len(ids), -1, dtype=np.int32)
        known = ids.notna().to_numpy()
        out[known] = np.searchsorted(bounds, ids[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(out)

    dealt = docs.withColumn("range", range_of("doc_id")).withColumn("halo", F.lit(False))
    heads = {r["range"]: r["head"] for r in dealt.groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    if not order:
        return dealt
    follow = [(heads[nxt], own) for own, nxt in zip(order, order[1:] + order[:1], strict=True)]
    table = spark.createDataFrame([(h, r) for h, r in follow if h is not None] or [(None, None)],
                                  "head long, target int")
    halo = docs.join(F.broadcast(table), docs["doc_id"] == table["head"])
    halo = halo.select("doc_id", "text", F.col("target").alias("range"), F.lit(True).alias("halo"))
    if -1 in heads:                         # rows without an id: the smallest text leads them
        first = docs.where("doc_id is null").agg(F.min("text").alias("text")).select(
            F.lit(None).cast("long").alias("doc_id"), "text",
            F.lit(next(own for h, own in follow if h is None)).alias("range"), F.lit(True).alias("halo"))
        halo = halo.unionByName(first)
    return (dealt.unionByName(halo).repartition(parts, "range")
            .sortWithinPartitions("range", "halo", F.desc_nulls_last("doc_id"), "text"))


def edit(text: str, following: str) -> str:
    """The last half of the code points gives way to as many first ones of the
    following text (or all it has)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of each document."""
    prepare(docs.sparkSession)
    rows = in_descending_order(id_and_text(docs, id_col, text_col))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(pairs: list[tuple]) -> pd.DataFrame:
        ids, own, after = zip(*pairs, strict=True)
        new = [edit(a, b) for a, b in zip(own, after, strict=True)]
        distinct = {t: k for k, t in enumerate(dict.fromkeys((*own, *after, *new)))}
        values, some = zip(*(slots(part, bins, bits) for part in text_groups(list(distinct))), strict=True)
        values, some = np.concatenate(values), np.concatenate(some)
        at_own, at_new, at_after = ([distinct[t] for t in x] for x in (own, new, after))
        prints = packed(values, some, bits)
        out = pd.DataFrame({
            "n_chars": [len(t) for t in own], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
            "fingerprint": [prints[k] for k in at_own], "edited_fingerprint": [prints[k] for k in at_new],
            "near_edited": likeness(values[at_own], values[at_new], some[at_own], some[at_new], bits),
            "near_next": likeness(values[at_own], values[at_after], some[at_own], some[at_after], bits)})
        out.insert(0, "doc_id", pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"))
        return out[columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, pairs, size = None, [], 0
        for f in frames:
            for row in zip(f["doc_id"], f["text"], f["range"], f["halo"], strict=True):
                if before is not None and not before[3] and before[2] == row[2]:
                    pairs.append((before[0], before[1], row[1]))
                    size += len(before[1])
                    if size >= CHUNK_BYTES:
                        yield work(pairs)
                        pairs, size = [], 0
                before = row
        if pairs:
            yield work(pairs)

    return rows.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")


def op7_minhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
