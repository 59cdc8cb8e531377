"""Byte-level BPE encoding and decoding.

Pre-tokenising needs no regex.  Each code point has a class (letter, number,
white space, other); with one code point of look-ahead it becomes a symbol,
and each symbol is a transition function on the states of a small automaton.
Nearly all symbols are constant functions, hence resets; only a contraction
candidate (an apostrophe and the letters after it) depends on the state
before.  Runs of those are composed by an associative doubling scan.  The
slices between starts go through cached pair merging.

Defined cases: a null text is empty; an empty text has no ids and decodes to
no bytes; repeated rows are encoded each; ids of rows play no part.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, id_and_text, prepare, text_groups

# Unicode white space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
               *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions that are pieces of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

LETTER, NUMBER, OTHER, WHITE, END = range(5)
END_POINT = 0x110000
#: Pieces whose ids a worker keeps; past that it starts anew.
CACHE_PIECES = 500_000

# Symbols: the classes, white space by what follows, contraction parts.
(S_LETTER, S_NUMBER, S_OTHER, S_BLANK_BEFORE, S_WHITE_BEFORE, S_WHITE_INSIDE, S_END,
 S_APOSTROPHE_1, S_APOSTROPHE_2, S_TAIL) = range(10)
# States: inside a run of a class, at a boundary, after a blank that belongs to
# the next piece, inside white space, one or two letters of a contraction left.
IN_LETTER, IN_NUMBER, IN_OTHER, BOUNDARY, BLANK, IN_WHITE, LEFT_1, LEFT_2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state: the state after, and whether a piece starts."""
    after = np.zeros((10, 8), dtype=np.uint8)
    start = np.ones((10, 8), dtype=bool)
    for symbol, run in ((S_LETTER, IN_LETTER), (S_NUMBER, IN_NUMBER), (S_OTHER, IN_OTHER)):
        after[symbol] = run
        start[symbol, [run, BLANK]] = False
    after[S_BLANK_BEFORE], after[S_WHITE_BEFORE], after[S_END] = BLANK, BOUNDARY, BOUNDARY
    after[S_WHITE_INSIDE] = IN_WHITE
    start[S_WHITE_INSIDE, IN_WHITE] = False
    for symbol, left in ((S_APOSTROPHE_1, LEFT_1), (S_APOSTROPHE_2, LEFT_2)):
        after[symbol] = left
        after[symbol, [IN_OTHER, BLANK]] = IN_OTHER
        start[symbol, [IN_OTHER, BLANK]] = False
    after[S_TAIL] = IN_LETTER
    after[S_TAIL, LEFT_1], after[S_TAIL, LEFT_2] = BOUNDARY, LEFT_1
    start[S_TAIL, [IN_LETTER, BLANK, LEFT_1, LEFT_2]] = False
    return after, start


AFTER, START = _automaton()
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of each code point, from its general category."""
    if not _classes:
        table = np.full(END_POINT + 1, OTHER, dtype=np.uint8)
        kind = {"L": LETTER, "N": NUMBER}
        for c in range(END_POINT):
            k = kind.get(unicodedata.category(chr(c))[0])
            if k is not None:
                table[c] = k
        table[WHITE_SPACE] = WHITE
        table[END_POINT] = END
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; END_POINT ends a text."""
    cls = class_table()[points]
    following = np.append(cls[1:], END)
    symbol = cls.copy()                              # letter, number, other as they are
    white = cls == WHITE
    before = white & (following < WHITE)
    symbol[white] = S_WHITE_INSIDE
    symbol[before] = S_WHITE_BEFORE
    symbol[before & (points == 0x20)] = S_BLANK_BEFORE
    symbol[cls == END] = S_END
    at = np.flatnonzero(points == 0x27)
    padded = np.append(points, [END_POINT] * 2)
    one, two = padded[at + 1], padded[at + 2]
    for text in CONTRACTIONS:
        hit = at[(one == ord(text[1])) & (len(text) == 2 or two == ord(text[-1]))]
        symbol[hit] = S_APOSTROPHE_1 if len(text) == 2 else S_APOSTROPHE_2
        for k in range(1, len(text)):
            symbol[hit + k] = S_TAIL
    state = AFTER[symbol, 0]                         # right for all constant symbols
    open_ = np.flatnonzero(symbol >= S_APOSTROPHE_1)
    if len(open_):
        run = AFTER[symbol[open_]]                   # a function (row of 8 states) each
        head = np.append(True, np.diff(open_) != 1)
        first = np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))
        depth = np.arange(len(open_)) - first
        step = 1
        while step <= depth.max():                   # f[i] := f[i] after f[i - step]
            on = np.flatnonzero(depth >= step)
            run[on] = np.take_along_axis(run[on], run[on - step].astype(np.intp), axis=1)
            step *= 2
        start_at = open_[first] - 1
        entry = np.where(start_at >= 0, state[start_at], BOUNDARY)
        state[open_] = run[np.arange(len(open_)), entry]
    return START[symbol, np.append(np.uint8(BOUNDARY), state[:-1])]


class Vocabulary:
    """Ranks of a rank file (base64 token, rank per line), and the merges."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(self.ranks.values(), default=-1) + 1
        words = [b""] * n
        for token, rank in self.ranks.items():
            words[rank] = token
        self.blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1])) if n else self.length
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost
        of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 100:
            return self._merge_long(piece)
        none = len(ranks) + 1
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pair = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        ranks, n = self.ranks, len(piece)
        part: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (r := ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[j])))

        while heap:
            r, i, size = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) >= n or len(part[i]) + len(part[j]) != size \
                    or ranks.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = END_POINT
        starts = np.flatnonzero(piece_starts(points))
        bounds = starts.tolist() + [len(points)]
        pieces = list(map(joined.__getitem__, map(slice, bounds[:-1], bounds[1:])))
        cache = self.cache
        at = np.searchsorted(starts, ends).tolist()       # the piece that is a text's end mark
        ends_of = set(at)
        for p in {p for k, p in enumerate(pieces) if k not in ends_of}.difference(cache):
            cache[p] = np.array(self.merge(p.encode("utf-8")), dtype="<i4").tobytes()
        out, first = [], 0
        for last in at:
            out.append(np.frombuffer(b"".join(map(cache.__getitem__, pieces[first:last])), dtype="<i4"))
            first = last + 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        ends = np.cumsum(self.length[ids])
        return ends - self.length[ids]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from the vocabulary by their offsets."""
        if not len(ids):
            return b""
        n = self.length[ids]
        shift = np.repeat(self.first[ids] - offsets, n)
        return self.blob[shift + np.arange(offsets[0], offsets[-1] + n[-1])].tobytes()


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), offsets (the byte at which each token begins)."""
    prepare(docs.sparkSession)
    base = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(ranks_path)
        for b in batches:
            at = 0
            for part in text_groups(b.column(1).to_pylist()):
                ids = voc.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), _lists(ids), _lists([voc.offsets(i) for i in ids])],
                    names=["doc_id", "ids", "offsets"])
                at += len(part)

    id_type = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {id_type}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary) to the columns doc_id, ids, offsets."""
    base = encoded.select("doc_id", "ids", "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(ranks_path)
        for b in batches:
            out = [voc.decode(i.values.to_numpy(), o.values.to_numpy().astype(np.int64))
                   for i, o in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())],
                                             names=["doc_id", "ids", "offsets", "decoded"])

    id_type = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {id_type}, ids array<int>, offsets array<int>, decoded binary")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(documents(spark, sf_dir), path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
