"""Exact repeats of ``length`` bytes, found in suffix order.

Anchors.  The smallest hash of all runs of k bytes inside a window of
``length`` bytes marks an anchor; it depends on the window's bytes alone, so
equal windows have an anchor at the same place.  About every (length - k) / 2
bytes hold one.  Anchors are counted by their k bytes and by their whole
context (everything that a window around them can reach): a context that
stands twice is a repeat as a whole, and of each context one copy goes on, if
the same k bytes have another one.

Suffix order.  The contexts of a run of k bytes are sorted by what follows the
anchor and by what precedes it (backwards), with the lengths of the common
prefixes (LCP) of neighbours.  For every window offset this gives the order of
the windows as suffixes, cut into runs that have ``length`` bytes in common.
In that order the previous and the next smaller position of a suffix give its
longest previous factor; it reaches ``length`` exactly where one of the two
lies in the same run: then the window is a later copy.  With greater positions
the same scan gives the copies that have a later one.

Runs of k bytes with more than MOST contexts (what very many documents share)
never meet in one task: their windows are counted by hashes, first by blocks of
offsets, then one by one in the blocks that only partly agree.

Equality of contexts and of the windows of such large groups is that of their
64-bit hashes among texts with equal k bytes; all others are compared by bytes.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole;
rows that repeat an id, and rows without one, are documents of their own, so a
repeated text is a repeat; extra columns are left out; no rows give no rows.
With ``keep_first`` documents without an id come first, equal ids in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import (CHUNK_BYTES, _power, discard, documents, id_and_text, mix64, prepare, returning_memory, stage, tidy)

LENGTH = 200
#: Contexts of one run of k bytes that one task compares.
MOST = 8192
#: Contexts that are compared together, at least (whole groups).
TOGETHER = 32768
_BASE = 0xD6E8FEB86659FD93                    # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def anchor_bytes(length: int) -> int:
    """k, the bytes that an anchor is chosen by."""
    return max(1, 2 * length // 5)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each run of ``width``, by doubling."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[:len(x) - rest], x[rest:]) if rest else x


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def _hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, tag=0) -> np.ndarray:
    """64-bit hashes of spans and a tag of each."""
    h = (prefix[ends] - prefix[starts]) * _power(_INVERSE, len(prefix))[starts]
    return mix64(h ^ mix64((ends - starts).astype(np.uint64) + (np.asarray(tag).astype(np.uint64) << np.uint64(32))))


def _anchors_of(data: np.ndarray, sure: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the windows that begin where ``sure``."""
    k = anchor_bytes(length)
    width = length - k + 1
    prefix = _prefix(data)
    at = np.arange(len(data) - k + 1)
    x = _hash(prefix, at, at + k) | np.uint64(1)
    low = _sliding(x, width, np.minimum)
    low = np.where(sure[:len(low)], low, np.uint64(0))
    pad = np.zeros(width - 1, dtype=np.uint64)
    top = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), width, np.maximum) == x)
    return top, x[top]


def _pieces(ids: list, texts: list[bytes], length: int) -> Iterator[list[tuple]]:
    """Runs of about CHUNK_BYTES of pieces (id, its text's bytes, first, end):
    windows begin in first..end; a long text is several pieces."""
    run, size = [], 0
    for i, data in zip(ids, texts, strict=True):
        for first in range(0, len(data) - length + 1, CHUNK_BYTES):
            end = min(first + CHUNK_BYTES, len(data) - length + 1)
            run.append((i, data, first, end))
            size += end - first + 2 * length
            if size >= CHUNK_BYTES:
                yield run
                run, size = [], 0
    if run:
        yield run


def anchors(base: DataFrame, length: int = LENGTH) -> DataFrame:
    """gram, context (hashes), rid, at: every anchor of rid, text."""
    left = length - anchor_bytes(length)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            last: tuple = (None, -1)              # the anchor before, of a piece of the same text
            for pieces in _pieces(f["rid"].tolist(), [t.encode("utf-8") for t in f["text"]], length):
                cut = [(max(0, a - left), min(len(d), b + 2 * length)) for _, d, a, b in pieces]
                data = np.frombuffer(b"".join(d[x:y] for (_, d, _, _), (x, y) in zip(pieces, cut, strict=True)), np.uint8)
                size = np.array([y - x for x, y in cut])
                begin = np.cumsum(size) - size
                sure = np.zeros(len(data), dtype=bool)
                for (_, _, a, b), (x, _), s in zip(pieces, cut, begin.tolist(), strict=True):
                    sure[s + a - x:s + b - x] = True
                top, gram = _anchors_of(data, sure, length)
                who = np.searchsorted(begin, top, side="right") - 1
                lo = np.maximum(top - left, begin[who])
                hi = np.minimum(top + length, (begin + size)[who])
                at = top - begin[who] + np.array([x for x, _ in cut])[who]
                rid = np.array([p[0] for p in pieces])[who]
                new = (rid != last[0]) | (at > last[1]) if len(rid) and rid[0] == last[0] else np.ones(len(rid), dtype=bool)
                if len(rid):
                    last = (rid[-1], at[-1])
                yield pd.DataFrame({"gram": gram.view(np.int64), "context": _hash(_prefix(data), lo, hi, top - lo).view(np.int64),
                                    "rid": rid, "at": at})[new]

    return base.select("rid", "text").mapInPandas(returning_memory(run), "gram long, context long, rid long, at long")


def neighbours(group: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each text in the order of (group, bytes) and, by rank, the LCP
    with the one before (0 across groups)."""
    size = np.array([len(t) for t in texts])
    key = np.empty((len(texts), 8 + width), dtype=np.uint8)
    key[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8:] = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(-1, width)
    order = np.argsort(key.view(f"S{8 + width}").ravel(), kind="stable")
    key, size = key[order], size[order]
    other = key[1:] != key[:-1]
    lcp = np.where(other.any(axis=1), other.argmax(axis=1) - 8, width)
    lcp = np.concatenate(([0], np.minimum(np.maximum(lcp, 0), np.minimum(size[1:], size[:-1]))))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, lcp


def smaller_in_run(run: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a suffix's previous or next smaller place in suffix order lies in
    its run (numbers ascend): its longest previous factor spans the run's LCP."""
    lift = place.max() + 1
    up = np.minimum.accumulate(place - run * lift)            # a later run lies lower
    down = np.minimum.accumulate((place + run * lift)[::-1])[::-1]
    out = np.zeros(len(run), dtype=bool)
    same = run[1:] == run[:-1]
    out[1:] |= same & (up[:-1] + run[1:] * lift < place[1:])
    out[:-1] |= same & (down[1:] - run[:-1] * lift < place[:-1])
    return out


def repeats(group: np.ndarray, before: list[bytes], after: list[bytes], place: np.ndarray, length: int,
            keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset (bytes before the anchor) of each context's
    windows that have another copy (``keep_first``: at a smaller place); the
    largest is -1 where there is none."""
    n, k = len(group), anchor_bytes(length)
    rank, lcp = neighbours(group, after, length)
    rank2, lcp2 = neighbours(group, [b[::-1] for b in before], length - k)
    n_after, n_before = np.array([len(a) for a in after]), np.array([len(b) for b in before])
    least, most = np.full(n, length), np.full(n, -1)
    for offset in range(length - k + 1):
        right = np.cumsum(lcp < length - offset)[rank]        # equal: the same bytes behind the anchor
        left = np.cumsum(lcp2 < offset)[rank2]
        able = (n_before >= offset) & (n_after >= length - offset)
        shared = np.bincount(right[able], minlength=n + 1)[right] > 1
        on = np.flatnonzero(able & shared & (np.bincount(left[able], minlength=n + 1)[left] > 1))
        if not len(on):
            continue
        key = left[on] * (n + 1) + right[on]
        order = np.argsort(key, kind="stable")
        on, key = on[order], key[order]
        run = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        found = smaller_in_run(run, place[on])
        if not keep_first:
            found |= smaller_in_run(run, n - 1 - place[on])
        on = on[found]
        least[on] = np.minimum(least[on], offset)
        most[on] = offset
    return least, most


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from ones sorted by gram."""
    held, rows = [], 0
    for f in frames:
        held.append(f)
        rows += len(f)
        if rows >= TOGETHER:
            f = pd.concat(held, ignore_index=True)
            last = (f["gram"] == f["gram"].iloc[-1]).to_numpy()
            if not last.all():
                yield f[~last]
            held = [f[last]]
            rows = len(held[0])
    if rows:
        yield pd.concat(held, ignore_index=True)


def _compared(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """rid, first, end of the repeats among the contexts of each group."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames):
            rid, at = f["rid"].to_numpy(), f["at"].to_numpy()
            place = np.empty(len(f), dtype=np.int64)
            place[np.lexsort((at, rid))] = np.arange(len(f))
            least, most = repeats(f["gram"].to_numpy(), f["before"].tolist(), f["after"].tolist(), place, length, keep_first)
            has = most >= 0
            yield pd.DataFrame({"rid": rid[has], "first": (at - most)[has], "end": (at - least)[has] + length})

    return (contexts.select("gram", "rid", "at", "before", "after").repartition("gram").sortWithinPartitions("gram")
            .mapInPandas(returning_memory(run), "rid long, first long, end long"))


def _counted(rows: DataFrame, key: list[str]) -> DataFrame:
    """Key, n, and the first place (rid, at) of each key."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("head"))


def _repeated(rows: DataFrame, counted: DataFrame, key: list[str], keep_first: bool) -> DataFrame:
    """The rows whose key has another copy (``keep_first``: before them)."""
    out = rows.join(counted.where("n > 1").select(*key, F.col("head.rid").alias("rid_"), F.col("head.at").alias("at_")), key)
    return out.where("rid <> rid_ or at <> at_") if keep_first else out


def _hashed(contexts: DataFrame, length: int, blocks: bool) -> DataFrame:
    """gram, offset, key, context, rid, at.  By blocks: ``key`` is the hash of
    what all windows of a block of offsets share, ``context`` that of all they
    reach; else one row per offset of the rows' block, ``key`` the window's."""
    k = anchor_bytes(length)
    step = max(1, int((length - k + 1) ** 0.5))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = np.array([len(a) + len(b) for a, b in zip(f["before"], f["after"], strict=True)], dtype=np.int64)
            begin = np.cumsum(size) - size
            anchor = begin + np.array([len(b) for b in f["before"]], dtype=np.int64)
            end = begin + size
            prefix = _prefix(np.frombuffer(b"".join(x for p in zip(f["before"], f["after"], strict=True) for x in p), np.uint8))
            gram, rid, at = (f[c].to_numpy() for c in ("gram", "rid", "at"))
            for offset in range(0, length - k + 1, step) if blocks else range(step):
                if blocks:
                    low = np.full(len(f), offset)
                    high = np.minimum(low + step, length - k + 1) - 1
                else:
                    low = high = f["offset"].to_numpy() + offset
                # some window of the block lies inside the text
                on = (high <= length - k) & (anchor - low >= begin) & (anchor + length - high <= end)
                lo, hi = np.maximum(anchor - high, begin)[on], np.minimum(anchor + length - low, end)[on]
                core = _hash(prefix, (anchor - low)[on], (anchor + length - high)[on], low[on])
                yield pd.DataFrame({"gram": gram[on], "offset": low[on], "key": core.view(np.int64),
                                    "context": _hash(prefix, lo, hi, anchor[on] - lo).view(np.int64), "rid": rid[on], "at": at[on]})

    return contexts.mapInPandas(returning_memory(run), "gram long, offset long, key long, context long, rid long, at long")


def _counted_windows(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """rid, first, end of the repeats among contexts of groups of any size."""
    k = anchor_bytes(length)
    step = max(1, int((length - k + 1) ** 0.5))
    rows = stage(_hashed(contexts, length, True), "suffix-blocks")
    key = ["gram", "offset", "key", "context"]
    counted = stage(_counted(rows, key), "suffix-blocks-counted")
    last = F.least(F.col("offset") + F.lit(step), F.lit(length - k + 1)) - 1
    whole = _repeated(rows, counted, key, keep_first).select(
        "rid", (F.col("at") - last).alias("first"), (F.col("at") + length - F.col("offset")).alias("end"))
    kinds = counted.groupBy(*key[:3]).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    partly = counted.join(kinds, key[:3]).select("gram", "offset", F.col("head.rid").alias("rid"), F.col("head.at").alias("at"))
    single = stage(_hashed(contexts.join(partly, ["gram", "rid", "at"]), length, False), "suffix-windows")
    key = ["gram", "offset", "key"]
    alone = _repeated(single, _counted(single, key), key, keep_first).select(
        "rid", (F.col("at") - F.col("offset")).alias("first"), (F.col("at") - F.col("offset") + length).alias("end"))
    return whole.unionByName(alone)


def _contexts(base: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, large, rid, at, before, after: the bytes around the wanted anchors."""
    left = length - anchor_bytes(length)
    listed = wanted.groupBy("rid").agg(F.collect_list(F.struct("gram", "large", "at")).alias("spots"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rid, text, spots in zip(f["rid"], f["text"], f["spots"], strict=True):
                data = text.encode("utf-8")
                yield pd.DataFrame([(s["gram"], s["large"], rid, s["at"], data[max(0, s["at"] - left):s["at"]],
                                     data[s["at"]:s["at"] + length]) for s in spots],
                                   columns=["gram", "large", "rid", "at", "before", "after"])

    return base.select("rid", "text").join(listed, "rid").mapInPandas(
        returning_memory(run), "gram long, large boolean, rid long, at long, before binary, after binary")


def repeated_spans(base: DataFrame, length: int = LENGTH, keep_first: bool = True, most: int = MOST) -> DataFrame:
    """rid, first, end (bytes): spans whose windows have another copy, from
    ``base`` (rid, text; a written table); they overlap."""
    left = length - anchor_bytes(length)
    found = stage(anchors(base, length), "suffix-anchors")
    counted = stage(_counted(found, ["gram", "context"]), "suffix-contexts")
    # a context that has copies: all of it (the parts beyond the text's ends are cut off at last)
    whole = stage(_repeated(found, counted, ["gram", "context"], keep_first).select(
        "rid", (F.col("at") - left).alias("first"), (F.col("at") + length).alias("end")), "suffix-whole")
    discard(found)
    kinds = (counted.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
             .select("gram", (F.col("kinds") > most).alias("large")))
    wanted = stage(counted.join(kinds, "gram").select("gram", "large", F.col("head.rid").alias("rid"), F.col("head.at").alias("at")),
                   "suffix-wanted")
    discard(counted)
    contexts = stage(_contexts(base, wanted, length), "suffix-bytes")
    discard(wanted)
    spans = whole.unionByName(stage(_compared(contexts.where("not large"), length, keep_first), "suffix-compared"))
    large = contexts.where("large")
    if not large.isEmpty():
        spans = spans.unionByName(_counted_windows(large, length, keep_first))
    return spans


def merged(first: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, ascending, inside 0..size, that touch nowhere."""
    first, end = np.maximum(first, 0), np.minimum(end, size)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], first[1:] > end[:-1]))
    return first[new], end[np.concatenate((new[1:], [True]))]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id",
                   text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (the removed
    bytes: first, end), kept (the bytes that remain).  Of equal strings of
    ``length`` bytes the first one stays (smallest id, then place); without
    ``keep_first`` none does."""
    spark = prepare(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    if keep_first:                                # row ids ascend as the documents' ids do
        rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    base = stage(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "suffix-texts")
    spans = repeated_spans(base, length, keep_first, most)
    tidy(spark)
    listed = spans.groupBy("rid").agg(F.collect_list("first").alias("first"), F.collect_list("end").alias("end"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, first, end in zip(f["text"], f["first"], f["end"], strict=True):
                data = text.encode("utf-8")
                if first is None:
                    out.append((len(data), 0, [], data))
                    continue
                first, end = merged(np.asarray(first), np.asarray(end), len(data))
                kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(data)], strict=True))
                out.append((len(data), int((end - first).sum()),
                            [{"first": int(a), "end": int(b)} for a, b in zip(first, end, strict=True)], kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"]).assign(
                doc_id=f["doc_id"].astype("Int64").to_numpy())

    return (base.join(listed, "rid", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "first", "end").mapInPandas(
        returning_memory(run), "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary"))


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
