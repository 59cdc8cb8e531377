import itertools
import re

import numpy as np
import pytest

from vigil.llm import filter_audit as A

LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [(3, LONG, "s"), (1, LONG, "s"), (2, LONG, None), (4, None, "s"), (5, "", "t"), (6, "A B", "t"), (7, "a $ b", "t"),
        (8, "x " * 80, "s"), (9, "x " * 80, "s"), (9, "x " * 80, "s"), (10, "É" * 30 + "AB", ""), (None, LONG, "t"), (None, "q", "t"),
        (11, "A# " * 70, "s"), (12, "tab\tline\nfeed\x0bvt\x0cff\rcr " * 20, "u"), (13, LONG + " " + "Z" * 200_000, "s")]
LABELS = [(1, 1, 0), (3, 1, 1), (8, 0, 1), (9, 1, 0), (9, 0, 0), (11, None, 1), (None, 1, 1), (77, 1, 1)]


def brute(rows, labels):
    def fails(i, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)
        return "".join(f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            re.search("[#$%&*|]", t) is not None, smaller), strict=True) if bad)

    docs = [(s or "", fails(i, t), any(j == i and q == 1 for j, q, _ in labels if i is not None),
             any(j == i and x == 1 for j, _, x in labels if i is not None)) for i, t, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                before = [d for d in mine if f in d[1] and d not in left]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(before), sum(d[1] == f for d in mine),
                                          sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows],
                                 "doc_id long, text string, source string, key string, mask int, part int")


def test_against_brute_force(spark, labels):
    got = A.audit(A.marked_documents(docs_of(spark, ROWS), labels), "ABCDE", weights=["good", "toxic"])
    assert result(got) == brute(ROWS, LABELS)


def test_empty_tables(spark, labels):
    assert A.audit(A.marked_documents(docs_of(spark, []), labels), "ABCDE", weights=["good", "toxic"]).count() == 0
    none = A.audit(A.marked_documents(docs_of(spark, ROWS), labels.limit(0)), "ABCDE", weights=["good", "toxic"])
    assert result(none) == brute(ROWS, [])


def test_ranks_are_the_first_failing_step():
    rng = np.random.default_rng(1)
    fails, orders = rng.random((40, 4)) < 0.4, A.orders_of("abcd")
    ranks = A.removal_ranks(fails, orders)
    for d, row in enumerate(fails):
        for o, order in enumerate(orders):
            first = next((s for s, f in enumerate(order) if row[f]), None)
            assert ranks[d, o] == first if first is not None else ranks[d, o] >= A.NEVER


def test_other_filters_without_weights(spark):
    marked = spark.createDataFrame([("p", 1), ("p", 3), ("p", 0), (None, 2)], "part string, mask int")
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in A.audit(marked, "XY").collect()}
    assert rows["p", "XY", 1] == (1, 2, 0, 3) and rows["p", "XY", 2] == (1, 0, 1, 1) and rows["", "YX", 1] == (0, 1, 0, 2)
