"""Similarity joins and components against brute force, with the cases that their docstrings define."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathmix.llm import common, minhash, vectors
from pathmix.llm.components import components

DOC = "doc_id bigint, text string"


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, one_task):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    loose = [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))]
    links = [*chain, *star, *loose, (5, 5), (None, 3)]
    want = Union({x for a, b in links for x in (a, b) if a is not None})
    for a, b in links:
        if a is not None:
            want.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), one_task=one_task).collect()}
    assert {i: c for i, c in got.items() if i != 3} == {i: want.find(i) for i in want.up if i != 3}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), one_task=one_task).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near(rows, width=4, percent=80):
    """rows (id, text): id -> (set size, component)."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    union = Union(sets)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def joined(df, **options):
    rows = minhash.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_near_duplicates(spark, sf):
    docs = common.table(spark, sf, "documents")
    assert joined(docs) == near([(r["doc_id"], r["text"]) for r in docs.collect()])


def family(size=60, seed=2):
    """Texts in a chain of small edits, copies, a shared passage, and the odd cases."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(size):
        rows.append(" ".join(words))
        if i % 3 == 0:
            rows.append(" ".join(words).upper().replace(" ", "\n"))
        words = list(words)
        for _ in range(4):
            words[rng.integers(len(words))] = f"x{rng.integers(10**6)}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"q{k}_{i}" for i in range(90)) for k in range(40)]
    return rows + [None, "", "  \n", "one", "ONE", "one two", "one two three", "a b c d", "a b c d e", "x" * 50_000, "y " * 40_000, "y " * 39_999]


@pytest.mark.parametrize("options", [{}, {"leaf": 8}, {"leaf": 4, "depth": 1}])
def test_near_duplicates_of_hot_groups(spark, options):
    rows = list(enumerate(family()))
    assert joined(spark.createDataFrame(rows, DOC), **options) == near(rows)


def test_hot_nodes_are_split(spark, monkeypatch):
    rows = list(enumerate(family()))
    monkeypatch.setattr(minhash, "SPLIT", 4)
    assert joined(spark.createDataFrame(rows, DOC)) == near(rows)


def test_hot_keys_are_dealt(spark):
    """Three quarters of the rows bear one key: none is lost or doubled, and no part of the join holds them all."""
    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("node"), "id")
    table = minhash.settle(rows.groupBy("node").agg(F.count("*").alias("k")))
    out = minhash.dealt_join(rows, table, "node", "k")
    assert sorted((r["node"], r["id"], r["k"]) for r in out.collect()) == sorted((7, i, 3000) if i % 4 else (i, i, 1) for i in range(4000))
    assert out.hint("merge").where("node = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 3000


def test_recall_on_thousands_of_near_pairs(spark):
    """Share of links, among thousands at 0.80 to 0.99, whose ends are in one component; no component joins strangers."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(1500):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
        rows.append(" ".join(words))
        for _ in range(2):
            near_ = list(words)
            for _ in range(rng.integers(1, 5)):
                near_[rng.integers(len(near_))] = f"x{rng.integers(10**6)}"
            rows.append(" ".join(near_))
    rows = list(enumerate(rows))
    want, got = near(rows), joined(spark.createDataFrame(rows, DOC))
    tied = [i for i, (_, c) in want.items() if c != i]
    found = sum(got[i][1] == got[want[i][1]][1] for i in tied)
    print("recall", found, len(tied))
    assert len(tied) > 1500 and found >= 0.99 * len(tied)
    assert all(got[i][1] >= want[i][1] for i in got)  # every link is confirmed: components are never larger


def test_string_keys_are_refused(spark):
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError):
        vectors.near_duplicates(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"))


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    rows = list(enumerate(family()))
    monkeypatch.setattr(minhash, "VOLUME", 2000)
    assert joined(spark.createDataFrame(rows, DOC)) == near(rows)


def test_joins_instead_of_lists(spark, monkeypatch):
    rows = list(enumerate(family(20)))
    monkeypatch.setattr(minhash, "LISTED", 0)
    df = spark.createDataFrame(rows, DOC).withColumn("component", F.lit("clash"))
    want = near(rows)
    assert joined(df) == want
    kept = minhash.representatives(df, width=4)
    assert kept.columns == ["doc_id", "text", "component"] and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (9, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert [g[1:] for g in got if not g[0]] == [(1, 3, 1), (3, 3, 1), (3, 3, 1), (9, 0, 9)] and len(got) == 5
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    assert minhash.representatives(spark.createDataFrame([], DOC)).count() == 0


def cosine_links(rows, bound=0.98):
    """rows (id, vector, label): id -> (links, component)."""
    ok = {}
    for i, (v, mark) in rows.items():
        if v is not None and mark is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            ok[i] = (x / np.linalg.norm(x), mark)
    union, links = Union(rows), Counter()
    for i in ok:
        for j in ok:
            if i < j and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= bound:
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    return {i: (links[i], union.find(i)) for i in rows}


VEC = "vec_id bigint, embedding array<float>, label int"


def linked(df, **options):
    rows = vectors.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def cluster(seed=3):
    rng = np.random.default_rng(seed)
    rows = {}
    for c in range(6):
        centre = rng.standard_normal(24)
        for _ in range(25):
            v = centre + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.14, 0.2])
            rows[len(rows)] = ([float(np.float32(x)) for x in v], int(c % 3))
    for _ in range(40):
        rows[len(rows)] = ([float(np.float32(x)) for x in centre], 1)  # copies
    rows[len(rows)] = ([2 * x for x in rows[0][0]], rows[0][1])  # the same direction
    rows[len(rows)] = (rows[0][0], None)
    for v in (None, [], [0.0] * 24, [float("nan")] * 24, [float("inf"), *[1.0] * 23], [None, *[1.0] * 23], [1.0, 2.0]):
        rows[len(rows)] = (v, 0)
    return rows


@pytest.mark.parametrize("blocks", [1, 4, 5, 24])
def test_vector_links(spark, blocks):
    rows = cluster()
    assert linked(spark.createDataFrame([(i, v, m) for i, (v, m) in rows.items()], VEC), blocks=blocks) == cosine_links(rows)


def test_full_cells_are_split(spark, monkeypatch):
    rows = cluster(4)
    for name, value in (("TILE", 8), ("AIM", 4), ("PAIRS", 16)):
        monkeypatch.setattr(vectors, name, value)
    assert linked(spark.createDataFrame([(i, v, m) for i, (v, m) in rows.items()], VEC)) == cosine_links(rows)
    assert vectors.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
