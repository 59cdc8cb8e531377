import hashlib

import numpy as np
import pandas as pd
import pytest

from vigil.llm import minhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got, slack=0.13):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    assert len(got) == len(rows)
    want = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        want.setdefault(i, []).append((t, t[:len(t) - len(t) // 2] + after[:len(t) // 2], after))
    prints = {}
    for r in got:
        t, edited, after = next(w for w in want[r.doc_id] if hashlib.sha256(w[1].encode()).hexdigest() == r.edited_sha256
                                and len(w[0]) == r.n_chars)
        assert abs(r.near_edited - jaccard(t, edited)) < slack and abs(r.near_next - jaccard(t, after)) < slack
        for text, p in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, p) == p


def test_whole_table(spark, sf001):
    d = pd.read_parquet(f"{sf001}/documents.parquet")
    check(list(zip(d.doc_id.tolist(), d.text)), minhash.op7_minhash_fingerprints(spark, sf001).collect())


LONG = " ".join(f"w{i * 31 % 5000}" for i in range(40_000))


@pytest.mark.parametrize("rows", [
    [], [(5, "only one here and more words")], [(1, None), (2, ""), (3, "a b"), (7, LONG), (8, LONG[9:]), (9, LONG)],
    [(None, "x y z"), (None, "b c d e f g"), (4, "q r s t u v w x")], [(2, "same"), (2, "same"), (2, "other words")]])
def test_frame_cases(frame, rows):
    check(rows, minhash.edited_fingerprints(frame(rows)).collect())


def test_fingerprints_alone(frame):
    got = {r.doc_id: r.fingerprint for r in minhash.fingerprints(frame([(1, "a b"), (2, "A  b"), (3, None)])).collect()}
    assert got[1] == got[2] != got[3] == ""


def test_bias_is_corrected():
    rng = np.random.default_rng(0)
    errors = []
    for k in range(150):
        n, shared = int(rng.integers(20, 800)), rng.random()
        a = [f"a{k}x{i}" for i in range(n)]
        b = a[:int(shared * n)] + [f"b{k}x{i}" for i in range(n - int(shared * n))]
        values, some = minhash.slots([" ".join(a), " ".join(b)])
        errors.append(minhash.likeness(values[:1], values[1:], some[:1], some[1:])[0] - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_eight_bits():
    values, some = minhash.slots(["a b c d e f g"], bins=64, bits=8)
    assert len(minhash.packed(values, some, 8)[0]) == 128 and minhash.likeness(values, values, some, some, 8)[0] == 1


def test_unlike_single_shingles_differ():
    values, some = minhash.slots([f"text number {i}" for i in range(60)])
    near = [minhash.likeness(values[i:i + 1], values[j:j + 1], some[:1], some[:1])[0] for i in range(60) for j in range(i)]
    assert max(near) < 0.15
