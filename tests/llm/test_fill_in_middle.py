import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vigil.llm import fill_in_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["one two  three", None, "", " ", "  lead and tail \n", "a", " nbsp wide ünï 東京\tx", "has <P> in it", "a <S", "x<M>y",
         "edge < <", "tab\tline\nvt\x0bff\x0ccr\r", "w " * 50_000, "longword" * 40_000, "😀 😀😀 é"]


def brute(i, text):
    text = text or ""
    toks = TOKEN.findall(text)
    assert "".join(toks) == text
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(toks)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(toks[:lo]), "".join(toks[lo:hi]), "".join(toks[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows_of():
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(12 * len(TEXTS))]
    return rows + [(None, "no id here"), (None, None), (5, "again"), (5, "again"), (-7, "minus seven words"), (1 << 62, "big id it is")]


def test_against_brute_force(frame):
    out = M.fill_in_middle(frame(rows_of()).repartition(3))
    got = out.withColumn("restored", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([brute(i, t) for i, t in rows_of()], key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows_of())


def test_empty_table(frame):
    assert M.fill_in_middle(frame([])).collect() == []


def test_whole_table(spark, sf001):
    d = pd.read_parquet(f"{sf001}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(*(w := brute(int(i), t))[:5], sha(w[5]), sha(t or "")) for i, t in zip(d.doc_id, d.text, strict=True)}
    assert {tuple(r) for r in M.op13_fill_in_middle(spark, sf001).collect()} == want


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 5, n).astype(np.uint8)
        held = M.WaveletMatrix(x, 3)
        at = np.arange(n + 1)
        for s in range(5):
            places = np.flatnonzero(x == s)
            assert (held.rank(s, at) == np.searchsorted(places, at)).all()
            assert (held.select(s, np.arange(len(places) + 1)) == np.append(places, n)).all()
