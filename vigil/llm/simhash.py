"""SimHash near-dedup by vantage-point trees.

A fingerprint bit is set when most shingle hashes (XXH64, seed 42) have it
set.  Distinct fingerprints are dealt out by a tree of vantage points: a node
sends a fingerprint inside or outside a Hamming ball, and, where its distance
is within the search radius of the border, also visits the other side (the
triangle inequality rules out all else).  So every pair within the radius
meets in the home leaf of either.  Leaves are cut into blocks of bounded size;
a block finds its pairs by a local tree of the same kind and returns a
spanning forest of them, never all pairs.  The links' components are found by
alternating stars.

The shared tree is fitted on a bounded sample (SAMPLE fingerprints) and has at
most MAX_LEAVES leaves; every fingerprint goes through it.  The result does
not depend on the sample, only the balance of the leaves does.

Defined cases: a null text is empty; a text without words has fingerprint zero
and is linked like any other; repeated rows share a component; null ids are
never a component's id unless all its ids are null; ``drop_near_duplicates``
keeps rows without an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, id_and_text, prepare, stage
from .graph import components

SEED, SHINGLE_WORDS, MAX_BITS = 42, 3, 2
#: Shingles whose bits are counted at a time.
COUNT_STEP = 1 << 15
#: Fingerprints at home in a leaf that the tree aims at, and its largest size.
LEAF, MAX_LEAVES, SAMPLE = 4096, 1 << 15, 1 << 16
#: Fingerprints of a block: at home, and visiting.
HOME_BLOCK, VISIT_BLOCK = 1 << 14, 1 << 16
#: Comparisons that a local tree does at once.
BRUTE = 1 << 20


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint as a signed number."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8").lower().split()          # ASCII letters and white space only
    if not words:
        return 0
    size = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    slices = map(slice, starts[:n].tolist(), ends[size - 1:].tolist())
    hashes = map(xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, COUNT_STEP):
        h = np.fromiter(hashes, np.uint64, min(COUNT_STEP, n - at))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), mark (a hash of the text) of each document."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return id_and_text(docs, id_col, text_col).select(
        "doc_id", of("text").alias("fp"), F.xxhash64("text").alias("mark"))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage points with radii; node 2 * k of ``links`` is inside, 2 * k + 1
    outside; negative links are leaves (leaf number -1 - link)."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius = radius
        self.points: list[int] = []
        self.radii: list[int] = []
        self.links: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(0)
        todo = [(sample, leaves, -1)]
        while todo:
            own, want, parent = todo.pop()
            cut = self._choose(own, rng) if want > 1 and len(own) > 16 else None
            if cut is None:
                link = -1 - self.leaves
                self.leaves += 1
            else:
                link = len(self.points)
                point, m = cut
                self.points.append(int(point))
                self.radii.append(m)
                self.links += [0, 0]
                inside = distance(own, point) <= m
                share = max(1, round(want * inside.mean()))
                todo.append((own[~inside], want - share, 2 * link + 1))
                todo.append((own[inside], share, 2 * link))
            if parent >= 0:
                self.links[parent] = link

    def _choose(self, own: np.ndarray, rng) -> tuple[np.uint64, int] | None:
        """The vantage point and radius that leave the fewest comparisons."""
        best, found = 0.97, None
        for point in rng.choice(own, min(24, len(own)), replace=False):
            count = np.bincount(distance(own, point), minlength=65 + self.radius)[:65]
            share = np.concatenate(([0], np.cumsum(count))) / len(own)      # share[x]: distance below x
            for m in range(64):
                home = share[m + 1]
                if 0.05 < home < 0.95:
                    near, far = share[min(65, m + self.radius + 1)], 1 - share[max(0, m - self.radius + 1)]
                    cost = home * near + (1 - home) * far
                    if cost < best:
                        best, found = cost, (point, m)
        return found

    def place(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf with any: the indexes of fingerprints that live there or
        visit it, and which of them live there."""
        todo = [(0 if self.points else -1, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
        while todo:
            link, own, home = todo.pop()
            if not len(own):
                continue
            if link < 0:
                yield -1 - link, own, home
                continue
            d, m = distance(fps[own], np.uint64(self.points[link])).astype(np.int64), self.radii[link]
            inside = d <= m
            a, b = d <= m + self.radius, d > m - self.radius
            todo.append((self.links[2 * link], own[a], home[a] & inside[a]))
            todo.append((self.links[2 * link + 1], own[b], home[b] & ~inside[b]))


class Forest:
    """Union-find over positions, by array operations."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def join_close(homes: np.ndarray, visits: np.ndarray, radius: int, found) -> None:
    """Calls found(home positions, visit positions) for all pairs within
    ``radius``; a local vantage-point tree prunes by the triangle inequality."""
    rng = np.random.default_rng(1)
    todo = [(np.arange(len(homes)), np.arange(len(visits)), 0)]
    while todo:
        h, v, stuck = todo.pop()
        if not len(h) or not len(v):
            continue
        if len(h) * len(v) <= BRUTE // 4 or stuck >= 3:
            step = max(1, BRUTE // len(v))
            for at in range(0, len(h), step):
                part = h[at:at + step]
                i, j = np.nonzero(distance(homes[part][:, None], visits[v][None, :]) <= radius)
                if len(i):
                    found(part[i], v[j])
            continue
        point = homes[rng.choice(h)]
        dh, dv = distance(homes[h], point).astype(np.int64), distance(visits[v], point).astype(np.int64)
        m = int(np.median(dh))
        if (dh <= m).all():
            m = m - 1 if (dh < m).any() else m
        inside = dh <= m
        near, far = dv <= m + radius, dv > m - radius
        work = inside.sum() * near.sum() + (~inside).sum() * far.sum()
        stuck = stuck + 1 if work > 0.9 * len(h) * len(v) else 0
        todo.append((h[inside], v[near], stuck))
        todo.append((h[~inside], v[far], stuck))


def links_within(classes: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all
    pairs within ``radius`` bits: a spanning forest of each block's pairs."""
    spark = classes.sparkSession
    n = classes.count()
    leaves = min(MAX_LEAVES, math.ceil(n / LEAF))
    size = min(SAMPLE, max(2048, 64 * leaves))
    sample = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).toPandas()["fp"]
    tree = Tree(sample.to_numpy(dtype=np.int64).view(np.uint64), leaves, radius)
    shared = spark.sparkContext.broadcast(tree)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fps = f["fp"].to_numpy(dtype=np.int64)
            for leaf, own, home in shared.value.place(fps.view(np.uint64)):
                yield pd.DataFrame({"leaf": leaf, "fp": fps[own], "home": home})

    placed = stage(classes.select("fp").mapInPandas(place, "leaf int, fp long, home boolean"), "simhash-leaves")
    # one row per leaf, at most MAX_LEAVES
    sizes = placed.groupBy("leaf").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / HOME_BLOCK).alias("home_blocks"),
        F.ceil(F.count(F.lit(1)) / VISIT_BLOCK).alias("visit_blocks")).where("home_blocks > 0")
    cut = (placed.join(F.broadcast(sizes), "leaf")
           .withColumn("r", F.xxhash64("fp", F.lit("block"))))
    at_home = cut.where("home").select(
        "leaf", "fp", F.lit(True).alias("home"), F.pmod("r", "home_blocks").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("visit_blocks") - 1)).alias("j"))
    visiting = cut.select(
        "leaf", "fp", F.lit(False).alias("home"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("home_blocks") - 1)).alias("i"),
        F.pmod("r", "visit_blocks").alias("j"))

    def connect(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy(dtype=np.int64)
        home = frame["home"].to_numpy()
        homes, visits = np.unique(fps[home]), np.unique(fps[~home])
        nodes = np.union1d(homes, visits)
        at_h, at_v = np.searchsorted(nodes, homes), np.searchsorted(nodes, visits)
        forest = Forest(len(nodes))
        join_close(homes.view(np.uint64), visits.view(np.uint64), radius,
                   lambda i, j: forest.join(at_h[i], at_v[j]))
        root = forest.roots(np.arange(len(nodes)))
        moved = root != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})

    return at_home.unionByName(visiting).groupBy("leaf", "i", "j").applyInPandas(connect, "a long, b long")


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp, label (of its component), component_id (the smallest id in it)."""
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    found = stage(components(links_within(classes, max_bits)), "simhash-components")
    labelled = stage(classes.join(found, classes["fp"] == found["node"], "left")
                     .select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    roots = stage(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "simhash-roots")
    return stage(labelled.join(roots, "label").select("fp", "label", "component_id"), "simhash-ids")


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (the smallest id that links reach, its own included)."""
    prints = stage(fingerprints(docs, words_per_shingle, id_col, text_col).drop("mark"), "simhash-prints")
    return prints.join(_classes(prints, max_bits).drop("label"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, that of its smallest id, with all its
    columns. Texts are told apart, not ids: an id that has unlike texts may lose
    one of them. Of an id's texts in one component the one with the smallest
    hash stays; rows without an id, and rows that repeat the one that stays, stay."""
    prints = stage(fingerprints(docs, words_per_shingle, id_col, text_col), "simhash-prints")
    member = prints.where("doc_id is not null").join(_classes(prints, max_bits), "fp")
    first = stage(member.where("doc_id = component_id").groupBy("label").agg(F.min("mark").alias("first_mark")), "simhash-first")
    gone = stage(member.join(first, "label").where("doc_id <> component_id or mark <> first_mark")
                 .select(F.col("doc_id").alias("_vg_id"), F.col("mark").alias("_vg_mark")).distinct(), "simhash-gone")
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, (docs[id_col] == gone["_vg_id"]) & (mark == gone["_vg_mark"]), "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
