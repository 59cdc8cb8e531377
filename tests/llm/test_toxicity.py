import zlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_segments_are_the_maximal_ones(values):
    def plain(a, b):
        """Ruzzo and Tompa by definition: the best segment, then both sides."""
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        return plain(a, i) + [(i, j, best[0])] + plain(j, b)
    got = toxicity.maximal_segments(np.array(values, dtype=float))
    assert sorted(s for *_, s in got) == sorted(s for *_, s in plain(0, len(values)))
    assert all(sum(values[a:b]) == s for a, b, s in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_whole_table_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    y = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    rank, n = y.score.rank(), y.toxic.sum()
    auc = (rank[y.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    assert auc > 0.93 and (y.predicted != y.toxic).mean() < 0.03


def make(spark, frame, n=400):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ti") for b in ("ka", "den", "sol", "vu", "per")]
    rows, labels = [], []
    for i in range(n):
        text = rng.choice(words, 60).tolist()
        toxic = i % 4 == 0
        if toxic:
            text[20:23] = ["vilething", "Nasty!!", "vilething"]
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_frame_cases(spark, frame):
    rows, labels = make(spark, frame)
    rows += [(9000, None), (9001, ""), (9002, "kalo " * 60_000), (None, "vilething nasty"), (3, "miden"), (3, "miden")]
    labels += [(4, 0, 1), (None, 0, 1), (5, 0, None), (7777, 0, 1)]
    docs, table = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    scored = docs.select("*", toxicity.score_column(spark, model, docs["text"]).alias("s")).toPandas()
    assert len(scored) == len(rows) and scored.s.between(0, 1).all()
    own = scored[scored.doc_id < 400].drop_duplicates("doc_id").set_index("doc_id").s
    assert ((own >= 0.5) == (own.index % 4 == 0)).mean() > 0.99
    spots = toxicity.passages(docs, model).toPandas()
    assert set(spots[spots.doc_id < 400].doc_id) == {i for i in range(0, 400, 4)}
    assert (spots[spots.doc_id == 8].first_token.between(18, 20)).any()


def test_no_labels(spark, frame):
    docs = frame([(1, "a"), (2, "b")])
    for labels in ([], [(1, 0, 1)], [(1, 0, 0), (2, 0, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert [r[0] for r in docs.select(toxicity.score_column(spark, model, docs["text"])).collect()] == [0.0, 0.0]
        assert toxicity.passages(docs, model).count() == 0
    empty = frame([])
    assert empty.select(toxicity.score_column(spark, model, empty["text"])).count() == 0
