"""Helpers shared by the operators: shared-folder tables, batches of text."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

#: Rows of one Arrow batch: bounds what a Python worker holds of whole texts.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
#: Bytes of text that the vectorised code works on at a time.
CHUNK_BYTES = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the text operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows, for what is staged meanwhile: narrow rows
    of numbers, of which BATCH_ROWS are so few that a batch costs more than its rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return (f"{checkpoint_dir(spark)}/vigil-llm/{spark.sparkContext.applicationId}"
            f"/{tag}-{uuid.uuid4().hex}")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage and lets a later join deal both of its sides anew (so that skewed
    keys can be split)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_each(frames: Iterable[DataFrame], tag: str) -> DataFrame:
    """``stage`` for the union of frames of one schema (one at least), written
    one after another: only one frame's shuffle files exist at a time."""
    paths = []
    for df in frames:
        paths.append(scratch_path(df.sparkSession, tag))
        df.write.parquet(paths[-1])
        tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def discard(staged: DataFrame) -> None:
    """Delete a staged table that no later step reads, and let Spark drop the
    shuffle files of the steps before: bounds the scratch space."""
    jvm = staged.sparkSession._jvm
    for part in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(part)
        path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    tidy(staged.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished steps once the driver has
    collected its garbage; after a large step that is worth asking for."""
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the tables that this application staged; call it once the
    results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_dir(spark)}/vigil-llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function on a task's batches, that gives freed memory back to
    the machine at its end: Spark uses a worker again, and one that kept it
    would hold it during all later stages."""
    def bounded(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # not every C library has it
            if trim is not None:
                trim(0)
    return bounded


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, no null text."""
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


# --- vectorised words -------------------------------------------------------

#: The white space between words, [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True

_BASE = 0x9E3779B97F4A7C15          # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans, from prefix sums."""
    h = (prefix[ends] - prefix[starts]) * _power(_INVERSE, len(prefix))[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64))


def _chunk_word_hashes(buf: np.ndarray, gap: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word start positions and 64-bit hashes of the words of one buffer, and of
    their first ``stem`` bytes."""
    low = _LOWER[buf]
    edge = np.diff(np.concatenate(([True], gap[low], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buf)), out=prefix[1:])
    stems = _span_hashes(prefix, starts, np.minimum(ends, starts + stem)) if stem else starts[:0].astype(np.uint64)
    return starts, _span_hashes(prefix, starts, ends), stems


def words_and_stems(texts: list[str], gap: np.ndarray = _IS_SPACE,
                    stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of the texts, where each text's
    words begin (one entry more than texts), and hashes of the words' first
    ``stem`` bytes.  ``gap`` marks the bytes between words; it must mark the
    blank and the line feed.  Works on CHUNK_BYTES at a time; a longer text is
    cut at white space."""
    hashes, stems, counts = [], [], np.zeros(len(texts), dtype=np.int64)
    pending: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not pending:
            return
        lens = np.array([len(p) + 1 for p in pending])
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        buf = np.frombuffer(b" ".join(pending) + b" ", dtype=np.uint8)
        starts, h, s = _chunk_word_hashes(buf, gap, stem)
        at = np.searchsorted(starts, first)
        n = np.diff(np.concatenate((at, [len(starts)])))
        np.add.at(counts, owner, n)
        hashes.append(h)
        stems.append(s)
        pending.clear()
        owner.clear()
        size = 0

    for k, text in enumerate(texts):
        for part in _cut(text.encode("utf-8")):
            pending.append(part)
            owner.append(k)
            size += len(part) + 1
            if size >= CHUNK_BYTES:
                flush()
    flush()
    none = [np.zeros(0, dtype=np.uint64)]
    return (np.concatenate(hashes or none), np.concatenate(([0], np.cumsum(counts))),
            np.concatenate(stems or none))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of the texts, and where each
    text's words begin."""
    return words_and_stems(texts)[:2]


def _cut(data: bytes) -> Iterator[bytes]:
    """Parts of at most about CHUNK_BYTES that end at white space."""
    at = 0
    while len(data) - at > CHUNK_BYTES:
        end = max(data.rfind(s, at, at + CHUNK_BYTES) for s in (b" ", b"\n"))
        if end <= at:                      # one giant word: up to its end
            nxt = [p for p in (data.find(s, at + CHUNK_BYTES) for s in (b" ", b"\n")) if p >= 0]
            end = min(nxt, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of each run of ``size`` words of each text, and
    where each text's shingles begin.  Fewer words make one shingle of all of
    them, no words none."""
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, n_words > 0)
    begin = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(begin[-1]) - begin[owner] + first[owner]
    width = np.minimum(n_words, size)[owner]
    padded = np.concatenate((words, np.zeros(size, dtype=np.uint64)))
    out = width.astype(np.uint64)
    for j in range(size):
        word = padded[at + j]
        word[j >= width] = 0
        out = out * np.uint64(_BASE) + word
    return mix64(out), begin


def text_groups(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
