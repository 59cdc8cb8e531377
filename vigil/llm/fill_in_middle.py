"""Fill-in-middle transformation.

The bytes of a batch of texts are mapped to character classes (inside a word,
first of a word, first of a gap, inside a gap, continuation of a code point)
and held as a wavelet matrix: one bit vector a class bit, with counts of ones.
Rank queries on it give every text's tokens (a new one begins where a gap
begins) and code points up to any place; a cut after u tokens is the u-th
beginning of a gap, found by bisection on ranks.

A token is a run of white space with the word behind it, or white space at the
end.  Prefix, middle and suffix are cut after two pseudo-random token counts
drawn from the id, and put together as they are (plain), prefix first (psm) or
suffix first (spm).

Defined cases: a null text is empty; a null id draws from the empty string;
empty texts and texts that hold a marker stay plain; rows that repeat an id
are transformed each; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, documents, id_and_text, prepare, returning_memory, text_groups

#: Markers, draws, percentages.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
MIDDLE_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
#: Character classes.
INSIDE, WORD, GAP, BLANK, CONTINUED = range(5)
CLASS_BITS = 3

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True


class WaveletMatrix:
    """Rank and select over a sequence of small symbols: per bit, from the
    highest, a bit vector in 64-bit words with the ones before each word; the
    symbols are parted stably by the bit before the next one."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for b in reversed(range(bits)):
            bit = (symbols >> b & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((words, before, self.n - int(before[-1])))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for level, (words, before, zeros) in enumerate(self.levels):
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            low, high = (zeros + a, zeros + b) if symbol >> self.bits - 1 - level & 1 else (low - a, high - b)
        return high - low

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) occurrences, by bisection on ranks; the
        length of the sequence where there are fewer."""
        low, high = np.zeros_like(nth), np.full_like(nth, self.n)
        while (low < high).any():
            mid = (low + high) >> 1
            enough = self.rank(symbol, np.minimum(mid + 1, self.n)) > nth
            low, high = np.where(enough | (low >= high), low, mid + 1), np.where(enough, mid, high)
        return low


def classes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Character classes of the bytes of texts that begin at ``first``; what
    stands before a text is a gap."""
    space = _IS_SPACE[data]
    after_gap = np.concatenate(([True], space[:-1]))[:len(data)]
    after_gap[first[first < len(data)]] = True
    out = np.where(space, np.where(after_gap, BLANK, GAP), np.where(after_gap, WORD, INSIDE)).astype(np.uint8)
    out[(data & 0xC0) == 0x80] = CONTINUED
    return out


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))


def _transformed(ids: list, texts: list[str], middle_percent: int, suffix_first_percent: int, seed: int) -> pd.DataFrame:
    parts = [t.encode("utf-8") for t in texts]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    end = np.cumsum(size)
    first = end - size
    held = WaveletMatrix(classes(np.frombuffer(b"".join(parts), dtype=np.uint8), first), CLASS_BITS)
    gaps_before = held.rank(GAP, first)
    n = np.where(size > 0, held.rank(GAP, end) - gaps_before + 1, 0)
    drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    # the cut after u tokens: the text's u-th beginning of a gap
    places = [np.where(u == 0, first, np.where(u == n, end, held.select(GAP, np.maximum(gaps_before + u - 1, 0))))
              for u in (cuts[:, 0], cuts[:, 1])]
    points = [at - held.rank(CONTINUED, at) for at in (first, *places)]
    rows = []
    for i, data in enumerate(parts):
        a, b = int(places[0][i] - first[i]), int(places[1][i] - first[i])
        marked = any(m in texts[i] for m in (PREFIX, SUFFIX, MIDDLE))
        if not data or marked or drawn[i, 2] % 100 >= middle_percent:
            rows.append(("plain", None, None, texts[i]))
            continue
        prefix, middle, suffix = (x.decode("utf-8") for x in (data[:a], data[a:b], data[b:]))
        spm = drawn[i, 3] % 100 < suffix_first_percent
        head = [SUFFIX, suffix, PREFIX, prefix] if spm else [PREFIX, prefix, SUFFIX, suffix]
        rows.append(("spm" if spm else "psm", int(points[1][i] - points[0][i]), int(points[2][i] - points[1][i]),
                     "".join([*head, MIDDLE, middle])))
    out = pd.DataFrame(rows, columns=["form", "prefix_chars", "middle_chars", "output"])
    out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
    return out.assign(doc_id=pd.array(ids, dtype="Int64"), n=n)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", middle_percent: int = MIDDLE_PERCENT,
                   suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars,
    middle_chars (null if plain), output."""
    prepare(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, at = [None if pd.isna(i) else int(i) for i in f["doc_id"]], 0
            for texts in text_groups(f["text"].tolist()):
                yield _transformed(ids[at:at + len(texts)], texts, middle_percent, suffix_first_percent, seed)
                at += len(texts)

    base = id_and_text(docs, id_col, text_col)
    return base.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        returning_memory(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of.  The parts hold no
    marker, so each marker's first place is where it was put."""
    def halves(text: Column, marker: str) -> tuple[Column, Column]:
        left = F.substring_index(text, marker, 1)
        return left, F.substr(text, F.length(left) + F.lit(len(marker) + 1))

    body = F.substr(output, F.lit(len(PREFIX) + 1))
    prefix, rest = halves(body, SUFFIX)
    suffix, middle = halves(rest, MIDDLE)
    suffix2, rest2 = halves(body, PREFIX)
    prefix2, middle2 = halves(rest2, MIDDLE)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     k AS (SELECT *, regexp_extract_all(txt, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks,
                  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
     c AS (SELECT *, len(toks) AS n, least(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS lo,
                  greatest(h1 % (len(toks) + 1), h2 % (len(toks) + 1)) AS hi,
                  CASE WHEN txt = '' OR contains(txt, '<P>') OR contains(txt, '<S>') OR contains(txt, '<M>')
                            OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
     p AS (SELECT *, coalesce(array_to_string(toks[1:lo], ''), '') AS a, coalesce(array_to_string(toks[lo + 1:hi], ''), '') AS b,
                  coalesce(array_to_string(toks[hi + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN txt WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b
                        ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(txt) AS restored_sha256 FROM p
"""
