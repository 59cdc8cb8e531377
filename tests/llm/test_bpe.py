import hashlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ref():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


REF = tiktoken.Encoding("own2", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevmld  \n\t\r19\u00e9\u4e2d!?-\u00a0\u3000\U0001f600\u0663")),
                        max_size=60), max_size=6))
def test_like_tiktoken(texts):
    voc = bpe.vocabulary(PATH)
    ids = voc.encode(texts)
    assert [i.tolist() for i in ids] == REF.encode_ordinary_batch(texts)
    assert [voc.decode(i, voc.offsets(i)).decode() for i in ids] == texts


def test_long_runs(ref):
    texts = ["x" * 5000 + "'ll" * 300, " " * 3000 + "'s's", "\u00e9\u00e8" * 2000, "'" * 999 + "t"]
    assert [i.tolist() for i in bpe.vocabulary(PATH).encode(texts)] == ref.encode_ordinary_batch(texts)


def test_frame_cases(frame, ref):
    rows = [(1, None), (2, ""), (None, "a  b"), (4, "it's"), (4, "it's"), (5, "word " * 60_000)]
    got = bpe.decode(bpe.encode(frame(rows), PATH), PATH).collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(sorted(got, key=lambda r: (len(r.decoded), str(r.doc_id))),
                            sorted(rows, key=lambda r: (len(r[1] or ""), str(r[0])))):
        assert r.ids == ref.encode_ordinary(text or "") and bytes(r.decoded).decode() == (text or "")
        assert len(r.offsets) == len(r.ids)
    assert bpe.encode(frame([]), PATH).count() == 0


def test_whole_table(spark, sf001, ref):
    d = pd.read_parquet(f"{sf001}/documents.parquet").set_index("doc_id").text.fillna("")
    got = bpe.op2_byte_bpe(spark, sf001).collect()
    assert len(got) == len(d)
    for r in got:
        ids = ref.encode_ordinary(d[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d[r.doc_id].encode()).hexdigest()


def test_decode_from_offsets():
    voc = bpe.vocabulary(PATH)
    ids = voc.encode(["some longer text, in part"])[0]
    off = voc.offsets(ids)
    assert voc.decode(ids[2:], off[2:]) == voc.decode(ids, off)[off[2]:]
    assert voc.decode(np.zeros(0, np.int32), np.zeros(0, np.int64)) == b""
