import itertools
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import packing

PATH = P.path("word_bpe_49k.json")
MODEL = Tokenizer.from_file(PATH)
MODEL.encode_special_tokens = True


def ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_best_fill_is_the_best(counts, room):
    best = max(sum(a * b for a, b in zip(counts, c)) for c in itertools.product(*(range(n + 1) for n in counts.values()))
               if sum(a * b for a, b in zip(counts, c)) <= room)
    take = packing.best_fill(counts, room)
    assert sum(a * b for a, b in take.items()) == best and all(b <= counts[a] for a, b in take.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_windows_are_gapless(lengths):
    where, offset = packing.minimum_bin_slack(np.array(lengths, dtype=np.int64), 40)
    for b in set(where.tolist()):
        mine = sorted((offset[i], lengths[i]) for i in np.flatnonzero(where == b))
        assert [a for a, _ in mine] == list(np.cumsum([0] + [n for _, n in mine])[:-1])
        assert sum(n for _, n in mine) <= 40


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB'stre.,!1\u00e9\u0301 \n\t\u00a0\u03a3\x85<|endoftext|>", max_size=40), max_size=8))
def test_ids_like_the_library(texts):
    got = packing.WordIds(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t)[:-1] for t in texts]


def check(rows, pieces):
    by = {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in dict(rows).items():
        want, copies = ids(text), [x for x, _ in rows].count(i)
        mine = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(want) * copies
        for r in mine:
            part = np.array(want[r.start:r.start + r.length], dtype="<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(want)
    fill = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n <= packing.WINDOW for n in fill.values())
    return fill


def test_frame_cases(frame):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "it's"), (4, "it's"), (5, "Word, 12! " * 9_000)]
    check(rows, packing.pack_documents(frame(rows), PATH).collect())
    assert packing.pack_documents(frame([]), PATH).count() == 0


def test_whole_table(spark, sf001):
    d = pd.read_parquet(f"{sf001}/documents.parquet")
    fill = check(list(zip(d.doc_id.tolist(), d.text)), packing.op10_packing(spark, sf001).collect())
    assert sum(n < packing.WINDOW for n in fill.values()) <= 2


def test_many_shards(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    pieces = packing.token_pieces(docs, PATH)
    out = packing.pack(pieces.select("doc_id", "start", "length"), shard_pieces=50)
    per = out.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert out.count() == pieces.count() and per.max() <= packing.WINDOW


def test_ids_of_odd_words_are_the_tokenizers():
    """Words of letters on both sides of the fast path, marks, signs that
    combine, several kinds of white space and control strings."""
    words = packing.WordIds(PATH)
    rng = random.Random(5)
    signs = [*"abcZÉßÅİıŉǅªº×÷ñ.,;:!?'`’…-_$&%019²½ΣςσӨ中ーﬁ́̇ͅ \t\n\x85€😀", "'s", "'ll", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 14)))
        want = np.array(MODEL.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert words.encode([text]) == [want], text


def test_pieces_of_one_id_spread_over_the_shards(spark):
    rows = [(None, 0, 100)] * 1500 + [(7, 0, 100)] * 1500
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long")
    got = packing.pack(pieces.repartition(3), shard_pieces=100).toPandas()
    assert len(got) == 3000 and got["length"].sum() == 300_000
    shards = (got["sequence_id"] // 2 ** 32).value_counts()
    assert len(shards) == 30 and shards.max() < 200
    named = packing.pack(pieces.withColumn("_metadata", F.lit("own")), shard_pieces=100)
    assert named.where("_metadata = 'own'").count() == 3000
