"""Packing by minimum bin slack.

Documents are tokenised and cut into full windows and a remainder.  The
remainders of a shard (a bounded, hashed share of the documents) go into
windows one by one: the longest remainder opens a window, a subset-sum bitset
over the multiset of the other lengths tells every fill that can be reached,
and the fill closest to the capacity is traced back to how often each length
is taken.  The same pattern is used again while the counts allow it.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed as often as they occur; a null id is an id like any other; an empty
table gives no rows.  Each shard leaves at most one window that is far from
full.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, id_and_text, prepare, returning_memory, stage

WINDOW = 4096
END_TOKEN = 2
#: Pieces that one task packs: bounds the memory of a group.
SHARD_PIECES = 20_000
#: Words whose ids a worker keeps.
CACHE_WORDS = 400_000
#: Words (the first met, hence the frequent ones) that stay past that, and after a task.
KEPT_WORDS = 200_000
#: Signs that are cut off the end of a word before it is looked up.
TRAILING = string.punctuation.encode()
#: Fixed value: the mark of vocabulary entries that end a piece.
END_OF_WORD = "</w>"

_tokenizers: dict = {}


def _latin(word: bytes) -> bool:
    """Whether all of it is letters below U+0250 that lower to one letter each."""
    if word.isascii():
        return word.isalpha()
    try:
        text = word.decode("utf-8")
    except UnicodeDecodeError:                   # the end of a longer character
        return False
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class _Known(dict):
    """Ids by word; a word with trailing signs is put together, not kept."""

    def __missing__(self, word: bytes) -> bytes:
        base = word.rstrip(TRAILING)
        return self[base] + self[word[len(base):]]


class WordIds:
    """Ids of a text by a word-level cache around a ``tokenizers`` model whose
    normaliser drops white space and lower-cases: words do not influence each
    other, so each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # of Latin letters the normaliser only lowers the case, and a run of them is one piece
        self.plain = Tokenizer(self.model.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)     # ids that end a piece
        self.closing[[i for t, i in vocab.items() if t.endswith(END_OF_WORD)]] = True
        self.cache = _Known()

    def _learn_letters(self, words: list[bytes]) -> None:
        """Encode unknown runs of Latin letters, many in one call; the ids that
        end a word tell where to cut."""
        text = b" ".join(words).decode("utf-8").lower()
        enc = self.plain.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(enc.ids, dtype="<u4")
        cut = (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
        if len(cut) != len(words):               # a vocabulary without end marks
            return self._learn(words)
        data, first = ids.tobytes(), 0
        for w, last in zip(words, cut, strict=True):
            self.cache[w] = data[first:last]
            first = last

    def _learn(self, words: list[bytes]) -> None:
        """Encode unknown words, many in one call, and cut the ids by offset."""
        texts = [w.decode("utf-8") for w in words]
        ends = np.cumsum([len(t) + 1 for t in texts])
        enc = self.model.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(enc.ids, dtype="<u4")
        at = np.array([a for a, _ in enc.offsets], dtype=np.int64)
        cut = np.searchsorted(at, ends, side="left") if len(ids) else np.zeros(len(ends), dtype=int)
        first = 0
        for w, last in zip(words, cut.tolist(), strict=True):
            self.cache[w] = ids[first:last].tobytes()
            first = last

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        docs = [t.encode("utf-8").lower().split() for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.trim()
        cache = self.cache
        new = set().union(*docs).difference(cache) if docs else set()
        learn = set()
        for w in new:
            base = w.rstrip(TRAILING)
            # after a letter or digit the mark begins a piece of its own
            if base and base != w and (base[-1:].isalnum() or _latin(base[-2:])):
                learn.add(base)
                learn.add(w[len(base):])
            else:
                learn.add(w)
        letters, others = [], []
        for w in learn:
            if w not in cache:
                (letters if _latin(w) else others).append(w)
        for known, learner in ((letters, self._learn_letters), (others, self._learn)):
            batch, size = [], 0
            for w in known:
                batch.append(w)
                size += len(w) + 1
                if size > 1 << 16:
                    learner(batch)
                    batch, size = [], 0
            if batch:
                learner(batch)
        return [b"".join(map(cache.__getitem__, d)) for d in docs]

    def trim(self) -> None:
        """Keep the words met first."""
        if len(self.cache) > KEPT_WORDS:
            self.cache = _Known(islice(self.cache.items(), KEPT_WORDS))


def _word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece of at most ``window`` tokens: doc_id, start, length,
    doc_tokens, ids (binary, little-endian unsigned 32 bits)."""
    prepare(docs.sparkSession)
    base = id_and_text(docs, id_col, text_col)
    id_type = base.schema["doc_id"].dataType.simpleString()
    tail = int(end_token).to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _word_ids(tokenizer_path)
        try:
            for f in frames:
                rows = []
                for doc_id, ids in zip(f["doc_id"], words.encode(f["text"].tolist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    rows.extend((doc_id, a, min(window, n - a), n, ids[4 * a:4 * (a + window)])
                                for a in range(0, n, window))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
                if f["doc_id"].isna().any():
                    out["doc_id"] = out["doc_id"].astype(object).where(out["doc_id"].notna(), None)
                yield out
        finally:                                 # a reused worker keeps few words for other stages
            words.trim()

    return base.mapInPandas(returning_memory(cut), f"doc_id {id_type}, start long, length long, doc_tokens long, ids binary")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to ``room``
    from below: bounded subset sums as one bitset, then traced back."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            grown = (reach | (reach << (length * k))) & mask
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, take = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            take[length] = take.get(length, 0) + k
    return take


def minimum_bin_slack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (all at most ``window``)."""
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    items: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        items.setdefault(int(lengths[i]), []).append(i)
    counts = {k: len(v) for k, v in items.items()}
    bin_no = 0
    for seed in sorted(counts, reverse=True):
        while counts.get(seed):
            counts[seed] -= 1
            take = best_fill(counts, window - seed)
            counts[seed] += 1
            take[seed] = take.get(seed, 0) + 1
            for _ in range(min(counts[x] // k for x, k in take.items())):
                at = 0
                for x, k in sorted(take.items(), reverse=True):
                    for _ in range(k):
                        i = items[x].pop()
                        where[i], offset[i] = bin_no, at
                        at += x
                    counts[x] -= k
                bin_no += 1
            for x in take:
                if not counts[x]:
                    del counts[x]
    return where, offset


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, start, length (at
    most ``window``); its other columns are carried.  Shards are dealt by a
    hash of a row's place in the staged table, so rows without an id, or of one
    id, spread over all of them; within one, windows are numbered from
    shard * 2**32."""
    table = stage(pieces, "pack-pieces")
    shards = max(1, math.ceil(table.count() / shard_pieces))
    at = table.metadataColumn("_metadata")
    place = F.xxhash64(F.regexp_extract(at["file_name"], r"part-(\d+)", 1), at["row_index"])
    dealt = table.withColumn("_vg_shard", F.pmod(place, F.lit(shards)))
    names = table.columns

    def fill(key, frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.sort_values(["length", "doc_id", "start"], kind="stable")
        where, offset = minimum_bin_slack(order["length"].to_numpy(), window)
        out = order[names].copy()
        out["sequence_id"] = where + (int(key[0]) << 32)
        out["offset"] = offset
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return dealt.groupBy("_vg_shard").applyInPandas(fill, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    pieces = token_pieces(docs, tokenizer_path)
    return pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
