"""Hand-computed cases and properties of the path operators and predictors."""

import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathmix.functions import geo as G
from pathmix.functions import paths as P
from pathmix.operators import distributions as D
from pathmix.operators import graph as R
from pathmix.operators import models as M
from pathmix.operators import rollout as O
from pathmix.operators import score as S
from pathmix.operators import windows as W


def frame(spark, paths):
    return spark.createDataFrame([(i, i % 3, list(p)) for i, p in enumerate(paths)], "trip_id bigint, user_id bigint, path array<int>")


def column(spark, path, f, kind="array<int>"):
    return spark.createDataFrame([(path,)], f"path {kind}").select(f(F.col("path")).alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "want"), [([1, 2, 3, 2, 4], [1, 2, 4]), ([1, 2, 1], [1]), ([], []), ([5], [5]), ([1, 2, 3, 1, 2, 3], [1, 2, 3])])
def test_loop_erase(spark, path, want):
    assert column(spark, path, P.erase_loops) == want


def test_path_functions(spark):
    assert column(spark, [5, 5, 6, 6, 5], P.collapse_runs) == [5, 6, 5]
    assert column(spark, [0, 3, 0, 4], P.positive) == [3, 4]
    assert column(spark, [1, 2, 3], lambda c: P.tail(c, 2)) == [2, 3] and column(spark, [1], lambda c: P.tail(c, 2)) == [1]
    assert column(spark, " 1, 2,,x ", P.parse_text, "string") == [1, 2, None] and column(spark, None, P.parse_text, "string") == []
    assert column(spark, "[1, 2]", P.parse_literal, "string") == [1, 2] and column(spark, "oops", P.parse_literal, "string") == []
    row = spark.createDataFrame([([1, 2, 3], [2, 3, 4], [1, 3])], "a array<int>, b array<int>, c array<int>")
    got = row.select(P.jaccard(F.col("a"), F.col("b")), P.edit_distance(F.col("a"), F.col("c"))).first()
    assert got[0] == 0.5 and got[1] == 1
    assert sum(column(spark, [1, 2, 3], P.decay, "array<int>")) == pytest.approx(1)


def test_samples_and_counts(spark):
    f = frame(spark, [[1, 2, 3, 4]])
    assert [(r["ctx"], r["target"], r["pos"]) for r in W.samples(f, 2).orderBy("pos").collect()] == [([1, 2], 3, 2), ([2, 3], 4, 3)]
    got = {(r["k"], tuple(r["ctx"]), r["next"]): r["cnt"] for r in W.ngrams(frame(spark, [[1, 2, 3]]), 2, 0).collect()}
    assert got == {(0, (), 2): 1, (0, (), 3): 1, (1, (1,), 2): 1, (1, (2,), 3): 1, (2, (1, 2), 3): 1}
    over = {(tuple(r["ctx"]), r["next"]): r["cnt"] for r in W.overlap_ngrams(f, 2, 1).collect()}
    assert over == {((1,), 2): 1, ((2,), 3): 1}  # the last node never counts
    assert W.samples(frame(spark, [[], [1], [1, 2]]), 2).count() == 0


def test_overlap_formula_is_windows(spark):
    random.seed(3)
    paths = [[random.randrange(4) for _ in range(random.randrange(0, 14))] for _ in range(60)]
    want = {}
    for p in paths:
        for i in range(len(p) - 6):
            w = p[i : i + 6]
            for k, q in itertools.product(range(1, 6), range(6)):
                if q + k < 6:
                    key = (tuple(w[q : q + k]), w[q + k])
                    want[key] = want.get(key, 0) + 1
    assert {(tuple(r["ctx"]), r["next"]): r["cnt"] for r in W.overlap_ngrams(frame(spark, paths), 6, 9).collect()} == want


def predictions(spark, paths, contexts, rule, highest=3):
    ctx = spark.createDataFrame([(c,) for c in contexts], "ctx array<int>")
    return {tuple(r["ctx"]): r for r in M.prepare(frame(spark, paths), ctx, highest).select("ctx", "size", rule.alias("d")).collect()}


def test_backoff_and_noise(spark):
    got = predictions(spark, [[1, 2, 3]], [[9, 2], [9, 9]], M.backoff(2))
    assert [tuple(x) for x in got[9, 2]["d"]["p"]] == [(3, 1.0)]
    assert sorted(tuple(x) for x in got[9, 9]["d"]["p"]) == [(2, 0.5), (3, 0.5)]  # the unigram
    cpt = predictions(spark, [[2, 3], [2, 3], [2, 4]], [[2]], M.noise_filtered(5))[(2,)]
    assert {x["node"]: x["p"] for x in cpt["d"]["p"]} == pytest.approx({3: 0.5 * 1 + 0.5 * 2 / 3, 4: 0.5 / 3})


RULES = [lambda: M.backoff(3), lambda: M.weighted(3), lambda: M.all_k(3), lambda: M.noise_filtered(3)]


@pytest.mark.parametrize("i", range(4))
def test_distributions_add_up(spark, i):
    random.seed(7)
    paths = [[random.randrange(6) for _ in range(9)] for _ in range(30)]
    contexts = [[random.randrange(7) for _ in range(3)] for _ in range(25)]
    for r in predictions(spark, paths, contexts, RULES[i]()).values():
        mass = sum(x["p"] for x in r["d"]["p"]) + (r["size"] - len(r["d"]["p"])) * r["d"]["floor"]
        assert mass == pytest.approx(1) and all(x["p"] >= r["d"]["floor"] - 1e-12 for x in r["d"]["p"])


def test_one_order_needs_no_weights(spark):
    paths = [[1, 2, 1, 3, 1, 2, 2]]
    a, b = predictions(spark, paths, [[1], [2]], M.backoff(1), 1), predictions(spark, paths, [[1], [2]], M.weighted(1), 1)
    for c in a:
        assert {x["node"]: x["p"] for x in a[c]["d"]["p"]} == pytest.approx({x["node"]: x["p"] for x in b[c]["d"]["p"]})


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 20), min_size=1, max_size=8), st.integers(0, 9))
def test_sparse_algebra_is_dense(spark, counts, target):
    """Closed forms on bumps and floor against vectors over all nodes."""
    size, s = 12, 0.3
    n = sum(counts.values())
    dense = [(counts.get(v, 0) + s) / (n + s * size) for v in range(size)]
    row = spark.createDataFrame([([(v, c) for v, c in counts.items()], n)], "nexts array<struct<node: int, cnt: bigint>>, n bigint")
    d = D.from_counts(F.struct("n", "nexts"), lambda c, m: (c + s) / (m + s * size), s / (F.col("n") + s * size))
    lit = F.lit(size).cast("double")
    got = row.select(d.alias("d")).select(
        D.mass(F.col("d"), lit), D.entropy_nats(F.col("d"), lit), D.at(F.col("d"), F.lit(target)), D.rank(F.col("d"), F.lit(target)), D.brier(F.col("d"), F.lit(target), lit), D.top(F.col("d"))
    ).first()
    assert got[0] == pytest.approx(1)
    assert got[1] == pytest.approx(-sum(p * math.log(p) for p in dense))
    assert got[2] == pytest.approx(dense[target])
    assert got[3] == 1 + sum(p > dense[target] + 1e-15 for p in dense)
    assert got[4] == pytest.approx(sum(p * p for p in dense) - 2 * dense[target] + 1)
    assert got[5] == max(range(size), key=lambda v: (dense[v], -v))


def test_strict_rank(spark):
    row = spark.createDataFrame([([1], 7, [(1, 0.6), (2, 0.4)], 5)], "ctx array<int>, target int, p array<struct<node: int, p: double>>, size bigint")
    pred = row.select("ctx", "size", F.struct("p", F.lit(0.0).alias("floor")).alias("d"))
    assert S.scored(row.select("ctx", "target"), pred).first()["rank"] == 3
    assert S.scored(row.select("ctx", "target"), pred, strict=True).first()["rank"] == 5


def test_horizons(spark):
    hits = [1, 1, 9, 1, 9]
    assert column(spark, hits, O.leading_run) == 2 and column(spark, hits, O.horizon) == 4
    assert column(spark, [1, 1], O.leading_run) == 2 and column(spark, [3], O.horizon) == 0


def test_haversine(spark):
    args = [F.lit(x) for x in (0.0, 0.0, 1.0, 0.0)]
    assert spark.range(1).select(G.haversine_km(*args)).first()[0] == pytest.approx(111.195, abs=1e-3)


EDGES = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0), (7, 8, 1.0), (4, 4, 1.0)]


def test_hops_and_routes(spark):
    e = spark.createDataFrame(EDGES, "source int, target int, length double")
    pairs = spark.createDataFrame([(1, 3), (1, 1), (1, 8), (1, 99), (4, 1)], "source int, target int")
    assert {(r["source"], r["target"]): r["hops"] for r in R.hops(e, pairs).collect()} == {(1, 3): 1, (1, 1): 0, (1, 8): 31, (1, 99): 31, (4, 1): 2}
    got = {(r["source"], r["target"]): (r["path"], r["cost"]) for r in R.routes(e, pairs).collect()}
    assert got[1, 3] == ([1, 2, 3], 2.0) and got[1, 1] == ([1], 0.0) and got[1, 8] == (None, None) and got[4, 1] == (None, None)
    costs = {(r["source"], r["node"]): r["cost"] for r in R.shortest_costs(e, spark.createDataFrame([(1,)], "source int")).collect()}
    assert costs == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 2.0, (1, 4): 3.0}


def test_pagerank_adds_up(spark):
    e = spark.createDataFrame(EDGES, "source int, target int, length double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8)], "node int")
    assert R.pagerank(e, nodes, 6).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_nearest_is_brute_force(spark):
    random.seed(11)
    places = [(i, random.uniform(-180, 180), random.uniform(-88, 88)) for i in range(60)]
    asked = [(i, random.uniform(-180, 180), random.uniform(-89, 89)) for i in range(80)]

    def km(a, b):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, p[1:])) for p in (a, b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    got = R.nearest(spark.createDataFrame(asked, "point bigint, lon double, lat double"), spark.createDataFrame(places, "node int, lon double, lat double"), 6.0)
    assert {r["point"]: r["node"] for r in got.collect()} == {a[0]: min(places, key=lambda p: km(a, p))[0] for a in asked}
