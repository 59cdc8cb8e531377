"""Toxicity by maximum-scoring segments.

Each token gets the log-odds of being in a toxic document: its document counts
by label, smoothed by a Dirichlet prior that its stem (the first bytes) gives,
whose own prior is the base rate.  Counts live in hashed tables of fixed size,
so the model does not grow with the corpus.  A linear-time scan (Ruzzo and
Tompa) finds all maximal-scoring segments of a text; extreme-value statistics
(Karlin and Altschul) of clean documents turn a segment's score into expected
occurrences by chance in a text of that length.  The segments of a text that
beat chance add up, and the sum is calibrated to a probability on labelled rows that had no part in the counts.

Defined cases: a null text is empty; an empty text has no segment and still
gets the calibrated score of none; repeated rows score alike; a label given
more than once counts as its largest; null labels and labels of no document
are ignored; without labelled rows of both classes every score is 0; a null id
belongs to fold 0 (held out).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import (documents, id_and_text, prepare, returning_memory, stage, text_groups, tidy,
                      words_and_stems)

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: At most this many labelled rows (smallest hashes of their ids) train the model.
MAX_LABELS = 200_000
WORD_BITS, STEM_BITS, STEM_BYTES = 20, 18, 4
#: Weight of the priors, in documents.
WORD_PRIOR, STEM_PRIOR = 10.0, 10.0
#: Taken from every token's log-odds, so that a segment must earn its length.
DRIFT = 0.5
#: Segments expected by chance less often than this are reported.
SIGNIFICANT = 0.05
_EULER = 0.5772156649015329

_GAP = np.ones(256, dtype=bool)
_GAP[ord("a"):ord("z") + 1] = False
_GAP[128:] = False


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and stem buckets of all tokens (runs of letters, lower-cased) and
    where each text's tokens begin."""
    words, begin, stems = words_and_stems([t.lower() for t in texts], _GAP, STEM_BYTES)
    return ((words & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64),
            (stems & np.uint64((1 << STEM_BITS) - 1)).astype(np.int64), begin)


def _count(rows: DataFrame) -> pa.Table:
    """Documents by bucket and label: word buckets, then stem buckets, then one
    more for all documents.  At most as many rows as the tables have buckets."""
    total = (1 << WORD_BITS) + (1 << STEM_BITS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, total + 1), dtype=np.int64)
        for f in frames:
            label = f["toxic"].to_numpy()
            at = 0
            for part in text_groups(f["text"].tolist()):
                words, stems, begin = _features(part)
                owner = np.repeat(np.arange(len(part)), np.diff(begin)) * (total + 1)
                own = label[at:at + len(part)]
                for buckets in (words, stems + (1 << WORD_BITS)):
                    seen = np.unique(owner + buckets)
                    np.add.at(counts, (own[seen // (total + 1)], seen % (total + 1)), 1)
                np.add.at(counts, (own, np.full(len(own), total)), 1)
                at += len(part)
        some = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"bucket": some, "clean": counts[0, some], "toxic": counts[1, some]})

    return (rows.mapInPandas(returning_memory(run), "bucket long, clean long, toxic long")
            .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .select(*[F.col(c).cast("int").alias(c) for c in ("bucket", "clean", "toxic")]).toArrow())


class Model:
    """Token log-odds and calibration; a few fixed-size arrays."""

    def __init__(self, counts: pa.Table):
        split, total = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << STEM_BITS)
        clean, toxic = np.zeros(total + 1, dtype=np.float32), np.zeros(total + 1, dtype=np.float32)
        for part in counts.to_batches():         # no second copy of the whole table
            at = part.column(0).to_numpy()
            clean[at], toxic[at] = part.column(1).to_numpy(), part.column(2).to_numpy()
        docs = np.array([clean[total], toxic[total]], dtype=np.float64)
        self.usable = bool(docs.min() > 0)
        if not self.usable:
            return
        # all clean documents weigh as much as all toxic ones: odds 1 when neutral
        clean *= np.float32(docs.sum() / 2 / docs[0])
        toxic *= np.float32(docs.sum() / 2 / docs[1])
        self.stem = (toxic[split:total] + STEM_PRIOR / 2) / (clean[split:total] + toxic[split:total] + STEM_PRIOR)
        self.clean, self.toxic = clean[:split].copy(), toxic[:split].copy()
        self.rate, self.k, self.slope, self.shift = 1.0, 1.0, 1.0, 0.0

    def token_scores(self, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        toxic = self.toxic[words] + WORD_PRIOR * self.stem[stems]
        clean = self.clean[words] + WORD_PRIOR * (1 - self.stem[stems])
        return np.log(toxic / clean) - DRIFT

    def evidence(self, score, n):
        """Minus the log of how often chance would reach ``score`` in ``n`` tokens."""
        return self.rate * score - np.log(self.k * np.maximum(n, 1))

    def total(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """A text's evidence: that of all segments that beat chance, else the
        best one's."""
        each = self.evidence(np.array([s for *_, s in segments] or [0.0]), n)
        return float(each[each > 0].sum() or each.max())

    def probability(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(total) + self.shift, -35, 35)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in linear time: only
    positive tokens open a segment; what lies between is in the running sum."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores, dtype=np.float64)
    lows, highs = (total[up] - scores[up]).tolist(), total[up].tolist()
    out: list[list] = []                     # first, end, low, high, the next with a lower low
    for k, first in enumerate(up.tolist()):
        low, high = lows[k], highs[k]
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                out.append([first, int(up[k]) + 1, low, high, j])
                break
            first, low = out[j][0], out[j][2]
            link = out[j][4]
            del out[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in out]


def _scan(model: Model, texts: list[str]) -> Iterator[tuple[np.ndarray, list]]:
    """Token scores and maximal segments of each text.  The counts are of
    documents, so a token counts where a text has it first; its repeats are
    neutral."""
    for part in text_groups(texts):
        words, stems, begin = _features(part)
        scores = model.token_scores(words, stems)
        owner = np.repeat(np.arange(len(part)), np.diff(begin))
        again = np.ones(len(words), dtype=bool)
        again[np.unique((owner << WORD_BITS) | words, return_index=True)[1]] = False
        scores[again] = np.minimum(scores[again], -DRIFT)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            yield scores[a:b], maximal_segments(scores[a:b])


def _calibrate(model: Model, spark, rows: DataFrame) -> None:
    """Rate and K from clean rows, then the logistic curve; what reaches the
    driver are histograms of fixed size."""
    shared = spark.sparkContext.broadcast(model)
    step, half = 0.05, 400

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, n, hist = [], [], np.zeros(2 * half + 1, dtype=np.int64)
            for (scores, segments), toxic in zip(_scan(shared.value, f["text"].tolist()), f["toxic"], strict=True):
                found.append(np.array([s for *_, s in segments] or [0.0]))
                n.append(len(scores))
                if not toxic:
                    np.add.at(hist, np.clip(np.rint(scores / step), -half, half).astype(np.int64) + half, 1)
            yield pd.DataFrame({"kind": 0, "toxic": f["toxic"], "n": n, "bin": 0, "scores": found})
            some = np.flatnonzero(hist)
            yield pd.DataFrame({"kind": 1, "toxic": 0, "n": hist[some], "bin": some - half,
                                "scores": [np.zeros(0)] * len(some)})

    seen = stage(rows.mapInPandas(returning_memory(run), "kind int, toxic int, n long, bin long, scores array<double>"),
                 "toxic-calibration")
    hist = seen.where("kind = 1").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    if len(hist) and (hist["bin"] > 0).any():
        x, p = hist["bin"].to_numpy() * step, hist["n"].to_numpy() / hist["n"].sum()
        if (x * p).sum() < 0:
            low, high = 0.0, 50.0               # the positive root of E[exp(rate x)] = 1
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (low, mid) if (p * np.exp(np.minimum(mid * x, 600))).sum() > 1 else (mid, high)
            model.rate = max(low, 1e-3)
    docs = seen.where("kind = 0")
    best = F.lit(model.rate) * F.array_max("scores")
    mean = docs.where("toxic = 0 and n > 0").agg(F.avg(best - F.log("n"))).first()[0]
    if mean is not None:
        model.k = math.exp(mean - _EULER)       # the mean of a Gumbel variable is its mode + 0.577
    each = F.transform("scores", lambda s: F.lit(model.rate) * s - F.log(F.lit(model.k) * F.greatest("n", F.lit(1))))
    over = F.aggregate(F.filter("each", lambda e: e > 0), F.lit(0.0), lambda a, e: a + e)
    total = F.when(over > 0, over).otherwise(F.array_max("each"))
    width = 0.05
    bins = (docs.withColumn("each", each).groupBy(F.round(F.asinh(total) / width).alias("bin"), "toxic")
            .count().toPandas())
    _fit_curve(model, bins["bin"].to_numpy() * width, bins["toxic"].to_numpy(), bins["count"].to_numpy())


def _fit_curve(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Ridge-damped logistic regression on one variable, by Newton steps."""
    if len(set(y.tolist())) < 2:
        model.slope, model.shift = 1.0, -3.0
        return
    scale = max(1.0, float(np.average(np.abs(x), weights=weight)))
    beta, ridge = np.zeros(2), np.diag([0.02, 0.001])
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        curvature = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge
        move = np.linalg.solve(curvature, gradient)
        beta += move * min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.shift = max(beta[0] / scale, 1e-6), beta[1]


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit on labelled rows outside the held-out fold: folds 1 to 3 count,
    fold 4 calibrates.  docs: doc_id, text; labels: doc_id, toxic."""
    spark = prepare(docs.sparkSession)
    own = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    rows = id_and_text(docs).join(F.broadcast(own), "doc_id")
    tidy(spark)                                  # the counts come to a driver that may be small
    model = Model(_count(rows.where(F.col("fold") != CALIBRATION).select("text", "toxic")))
    if model.usable:
        _calibrate(model, spark, rows.where(F.col("fold") == CALIBRATION).select("text", "toxic"))
    return model


def score_column(spark, model: Model, text: Column) -> Column:
    """The probability of label 1 for each text; other columns stay untouched."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        if not m.usable:
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(m.probability(np.array(
            [m.total(segments, len(scores)) for scores, segments in _scan(m, texts.fillna("").tolist())])))

    return score(F.coalesce(text, F.lit("")))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_token, n_tokens, evidence."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    base = id_and_text(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            rows = []
            if m.usable:
                for doc_id, (scores, segments) in zip(f["doc_id"], _scan(m, f["text"].tolist()), strict=True):
                    for a, b, s in segments:
                        e = float(m.evidence(s, len(scores)))
                        if e >= -math.log(SIGNIFICANT):
                            rows.append((None if pd.isna(doc_id) else int(doc_id), a, b - a, e))
            yield pd.DataFrame(rows, columns=["doc_id", "first_token", "n_tokens", "evidence"]).astype({"doc_id": "Int64"})

    return base.mapInPandas(returning_memory(run), "doc_id long, first_token long, n_tokens long, evidence double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
                        score_column(spark, model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
