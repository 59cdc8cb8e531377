import re

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import graph, simhash


def plain(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(a.encode(), 42) for a in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def classes_of(nodes, linked):
    up = {i: i for i in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB \t\n éc", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def test_fingerprint_in_steps(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNT_STEP", 7)
    assert simhash.fingerprint(text) == want and want % (1 << 64) == plain(text)


def cluster(n, seed):
    """Random fingerprints, and chains of neighbours 1 to 3 bits apart."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist()
    at = out[0]
    for _ in range(n):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            at ^= 1 << int(b)
        out.append(at)
    return np.unique(np.array(out, dtype=np.uint64))


def test_tree_brings_every_pair_to_a_home():
    fps = cluster(1500, 3)
    tree = simhash.Tree(fps[::3], 12, 2)
    assert tree.leaves > 4
    home, seen = {}, {}
    for leaf, own, at_home in tree.place(fps):
        for k, h in zip(own.tolist(), at_home.tolist(), strict=True):
            seen.setdefault(k, set()).add(leaf)
            if h:
                assert home.setdefault(k, leaf) == leaf
    assert len(home) == len(fps)
    a, b = np.nonzero(np.triu(simhash.distance(fps[:, None], fps[None, :]) <= 2, 1))
    assert len(a) > 100 and all(home[i] in seen[j] and home[j] in seen[i] for i, j in zip(a.tolist(), b.tolist()))


def test_local_join_against_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 256)
    fps, found = cluster(700, 5), set()
    simhash.join_close(fps, fps, 2, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(simhash.distance(fps[:, None], fps[None, :]) <= 2))))


def test_links_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 100)
    monkeypatch.setattr(simhash, "HOME_BLOCK", 40)
    monkeypatch.setattr(simhash, "VISIT_BLOCK", 70)
    fps = cluster(400, 7).view(np.int64)
    links = simhash.links_within(spark.createDataFrame(pd.DataFrame({"fp": fps, "first_id": range(len(fps))})))
    got = {r.node: r.label for r in graph.components(links).collect()}
    want = classes_of(fps.tolist(), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    groups = pd.Series(want).groupby(pd.Series(want)).size()
    assert got == {i: w for i, w in want.items() if groups[w] > 1}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 9), (2, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(61)}
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


BASE = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
ROWS = [(9, BASE), (4, BASE + " tail"), (5, BASE.upper()), (7, None), (6, ""), (8, " \n"), (3, "one"), (2, "one two"),
        (None, BASE), (1, "Zz " * 50_000), (1, "Zz " * 50_000)]


def test_frame_cases(frame):
    got = simhash.near_duplicates(frame(ROWS)).collect()
    assert len(got) == len(ROWS)
    prints = {(i, t): plain(t) for i, t in ROWS}
    nodes = sorted(set(prints.values()))
    label = classes_of(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, t), p in prints.items():
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = sorted((str(i), f"{plain(t):016x}", least.get(label[plain(t)])) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.drop_near_duplicates(frame(ROWS))
    assert kept.columns == frame(ROWS).columns
    assert {r.doc_id for r in kept.collect()} == set(least.values()) | {None}
    assert simhash.near_duplicates(frame([])).count() == 0


def test_unlike_texts_of_one_id_are_told_apart(frame):
    other = " ".join(f"else{i * 31 % 500}" for i in range(300))
    rows = [(3, BASE), (7, BASE.upper()), (7, other), (9, other.upper()), (8, BASE), (8, "q r s"), (2, "a b"), (2, "A B"), (None, BASE)]
    kept = sorted((str(r.doc_id), r.text) for r in simhash.drop_near_duplicates(frame(rows)).collect())
    twin = frame([(2, "a b"), (2, "A B")]).selectExpr("min_by(text, xxhash64(text))").first()[0]
    assert kept == sorted([("3", BASE), ("7", other), ("8", "q r s"), ("2", twin), ("None", BASE)])


def test_whole_table(spark, sf001):
    d = pd.read_parquet(f"{sf001}/documents.parquet").set_index("doc_id").text
    prints = {i: plain(t) for i, t in d.items()}
    want = classes_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.op5_simhash(spark, sf001).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} \
        == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
