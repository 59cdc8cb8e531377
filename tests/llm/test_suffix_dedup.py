import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from vigil.llm import suffix_dedup as S


def brute(texts, length, keep_first=False):
    """Removed bytes of each text (in order: the first copy stays)."""
    seen, data = defaultdict(list), [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]].append((d, p))
    gone = [np.zeros(len(b), dtype=bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places[1:] if keep_first else places:
                gone[d][p:p + length] = True
    out = []
    for b, g in zip(data, gone, strict=True):
        runs = int((np.diff(np.concatenate(([0], g.astype(np.int8)))) == 1).sum())
        out.append((len(b), int(g.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~g])))
    return out


def result(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect()], key=str)


def expected(rows, length, keep_first=False):
    return sorted([(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length, keep_first), strict=True)], key=str)


def corpus(seed, n, length):
    """Texts of a small alphabet with shared passages, edits and runs."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab é") for _ in range(r.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(length // 4, length)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, length // 2))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            p = p[a:r.randint(a, len(p))]
            if r.random() < 0.3 and p:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1:]
            parts += [p, text(r.randint(0, 5))]
        if r.random() < 0.1:
            parts.append(r.choice(["z", "zy"]) * r.randint(1, 3 * length))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 20), (2, 20), (3, 31), (4, 5)])
def test_against_brute_force(frame, seed, length):
    rows = corpus(seed, 60, length)
    assert any(x[1] for x in brute([t for _, t in rows], length))
    assert result(S.remove_repeats(frame(rows).repartition(4), length, keep_first=False)) == expected(rows, length)


@pytest.mark.parametrize("seed", [5, 6])
def test_first_copy_stays(frame, seed):
    rows = corpus(seed, 60, 20)
    got = S.remove_repeats(frame(rows).repartition(4, "text"), 20)
    assert result(got) == expected(rows, 20, keep_first=True)


@pytest.mark.parametrize("keep_first", [False, True])
def test_large_groups_by_counted_windows(frame, keep_first):
    rows = corpus(7, 80, 24)
    got = S.remove_repeats(frame(rows), 24, keep_first=keep_first, most=2)
    assert result(got) == expected(rows, 24, keep_first)


def test_frame_cases(frame):
    long = "".join(random.Random(8).choices("abcdefgh \n", k=700_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (None, "n" * 500), (None, long[1000:1400]), (6, "same " * 60), (6, "same " * 60),
            (7, "é" * 150), (8, "x" + long[300_000:300_250] + "y"), (9, long[262_100:262_400] + "\0" * 300), (-1, "\0" * 250)]
    got = result(S.remove_repeats(frame(rows), keep_first=False))
    assert got == expected(rows, 200)


def test_empty_table(frame):
    assert result(S.remove_repeats(frame([]))) == []


def test_whole_table(spark, sf001):
    d = pd.read_parquet(f"{sf001}/documents.parquet").sort_values("doc_id")
    want = brute(d.text.tolist(), 200)
    rows = {(int(i), *x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in zip(d.doc_id, want, strict=True)}
    assert {tuple(r) for r in S.op12_suffix_dedup(spark, sf001).collect()} == rows


def test_smaller_places_in_runs():
    rng = np.random.default_rng(2)
    place, run = rng.permutation(500)[:50], np.sort(rng.integers(0, 9, 50))
    got = S.smaller_in_run(run, place)
    assert [bool(g) for g in got] == [bool((place[run == r] < p).any()) for r, p in zip(run, place, strict=True)]
