import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F

from vigil.llm import exact_dedup as X

ROWS = [(3, "a b"), (1, "ab"), (2, "a\tb \n"), (5, None), (4, ""), (None, "ab  c"), (9, "abc"),
        (7, "q"), (7, "q"), (8, "\u00a0q"), (6, "z" * 300_000)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, g in groups.items():
        best = min(g)
        out += [(i, best[3], len(g), (n, none, k) == best[:3], hashlib.sha256(norm.encode()).hexdigest())
                for n, none, k, i in g]
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r)[:5] for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()],
                  key=str)


def test_against_brute_force(frame):
    assert result(X.exact_dedup(frame(ROWS))) == brute(ROWS)


def test_hash_collisions_are_told_apart(frame):
    weak = X.exact_dedup(frame(ROWS), hash_of=lambda norm: F.unhex(F.substring(F.md5(norm), 1, 0)))
    assert result(weak) == brute(ROWS)


def test_drop_duplicates_keeps_columns_and_one_twin(frame):
    docs = frame(ROWS)
    kept = X.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 2, 4, 6, 7, 8]


def test_empty_table(frame):
    assert result(X.exact_dedup(frame([]))) == []
    assert X.drop_duplicates(frame([])).count() == 0


def test_plan_is_native(spark, sf001):
    plan = X.op1_exact_dedup(spark, sf001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_whole_table(spark, sf001):
    d = pd.read_parquet(f"{sf001}/documents.parquet")
    got = X.op1_exact_dedup(spark, sf001)
    assert result(got) == brute(list(zip(d.doc_id.tolist(), d.text)))
