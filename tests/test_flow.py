"""Networks in all their shapes, predictors with users and states, and hidden states against enumeration."""

import io
import itertools
import json
import pickle

import numpy as np
import pytest

from pathmix import catalog
from pathmix.operators import iohmm as H
from pathmix.operators import prepare as R
from pathmix.operators import registry
from pathmix.operators import score as S
from pathmix.plans.model_queries import data
from pathmix.sources import files as X


def test_networks_by_id(spark, tmp_path):
    nodes = {"1": {"x": 0.5, "y": 1.5}, "2": {"x": 0.6, "y": 1.6, "osm_id": 77}, "none": {"x": 1.0, "y": 1.0}}
    edges = [{"source": 1, "target": 2, "length": 4.5, "geometry": [[0.5, 1.5], [0.6, 1.6]]}, {"source": 2}, {"source": "x", "target": 1}, {"source": 2, "target": 1, "length": None}, {"source": 9, "target": 1}]
    (tmp_path / "net.json").write_text(json.dumps({"nodes": nodes, "edges": edges}))
    got, roads = X.network(spark, str(tmp_path / "net.json"))
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, 1.5), (2, 0.6, 1.6)]
    assert sorted((r["source"], r["target"], r["length"]) for r in roads.collect()) == [(1, 2, 4.5), (2, 1, 1.0)]
    assert not X.is_surveyed(spark, str(tmp_path / "net.json"))


def test_network_lines(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.5, 1.5), (2, 0.6, 1.6)], "node int, lon double, lat double")
    edges = spark.createDataFrame([(1, 2, 3.0, [[0.5, 1.5], [0.6, 1.6]]), (2, 1, 2.0, None)], "source int, target int, length double, geometry array<array<double>>")
    X.write_network(nodes, edges, str(tmp_path / "net"))
    back, roads = X.network_lines(spark, str(tmp_path / "net"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(map(str, roads.drop("source_kind").collect())) == sorted(map(str, edges.collect()))


class Trap:
    def __reduce__(self):
        return print, ("run",)


def test_archives_become_trips(spark, tmp_path):
    held = io.BytesIO()
    np.savez(held, grid=np.array({"10": [0.0, 0.0], "20": [0.1, 0.0], "30": [0.2, 0.01], "x": [1, 1], "40": [np.float64(0.3), 0.0]}, dtype=object), traj=np.array([[10, 10, 30, 0], [20, 40, 0, 0], [10, 0, 0, 0]]))
    (tmp_path / "1_XX_Town.npz").write_bytes(held.getvalue())
    grid = X.grids(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in grid.collect()) == [(10, 0.0, 0.0), (20, 0.1, 0.0), (30, 0.2, 0.01), (40, 0.3, 0.0)]
    nodes = spark.createDataFrame([(1, 0.001, 0.0), (2, 0.1, 0.001), (3, 0.2, 0.0)], "node int, lon double, lat double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "source int, target int, length double")
    got = {r["trip_id"]: r["path"] for r in R.from_archive(X.archives(spark, str(tmp_path)), grid, nodes, edges).collect()}
    assert got == {0: [1, 2, 3], 1: [2, 3]}


def test_archives_run_nothing():
    held = io.BytesIO()
    np.savez(held, grid=np.array({"1": Trap()}, dtype=object))
    with pytest.raises(pickle.UnpicklingError):
        X._grid(held.getvalue())


def test_memories_in_the_registry(spark, sf):
    train, windows = data(spark, sf)
    got = {r["metric"]: r["value"] for r in registry.evaluate(train, windows, ["dmmc"], "events", 0).collect()}
    want = catalog.QUERIES["metrics_dmmc"](spark, sf).first().asDict()
    assert got == {k: want[k] for k in got} and "acc1" in got


def test_states_in_the_registry(spark, sf):
    train, windows = data(spark, sf)
    d = registry.predictor("iohmm", states=3, rounds=2).distribution(train, windows)
    assert d.count() == windows.select("ctx").distinct().count()
    rows = d.selectExpr("aggregate(d.p, 0d, (a, x) -> a + x.p) + (size - size(d.p)) * d.floor as mass").collect()
    assert [r["mass"] for r in rows] == pytest.approx([1.0] * len(rows))
    row = S.metrics(S.scored(windows, d)).first()
    assert row["n"] == windows.count() and 0 < row["acc1"] <= 1


def test_unknown_predictors_and_nodes(spark):
    with pytest.raises(ValueError):
        registry.predictor("oracle")
    train = spark.createDataFrame([([0, 1, 0, 1, 1, 0],)], "path array<int>")
    windows = spark.createDataFrame([([0, 1],), ([7, 9],)], "ctx array<int>")
    rows = {tuple(r["ctx"]): r["d"] for r in registry.predictor("iohmm", states=2, rounds=1).distribution(train, windows).collect()}
    assert set(rows) == {(0, 1), (7, 9)} and rows[7, 9] is not None


def test_expected_counts_equal_enumeration(spark):
    """Every sequence of states of short paths, weighed by its probability."""
    paths = [[0, 1, 2, 0], [2, 2], [1], []]
    model = H.HiddenMarkov(2)
    rng = np.random.default_rng(3)
    model.pi, model.a, model.b = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), size=2), rng.dirichlet(np.ones(3), size=2)
    pi, a, b, ll = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), 0.0
    for obs in filter(None, paths):
        ways = list(itertools.product(range(2), repeat=len(obs)))
        p = np.array([model.pi[w[0]] * np.prod([model.a[x, y] for x, y in itertools.pairwise(w)]) * np.prod([model.b[s, o] for s, o in zip(w, obs, strict=True)]) for w in ways])
        ll += np.log(p.sum())
        for w, q in zip(ways, p / p.sum(), strict=True):
            pi[w[0]] += q
            for x, y in itertools.pairwise(w):
                a[x, y] += q
            for s, o in zip(w, obs, strict=True):
                b[s, o] += q
    df = spark.createDataFrame([(p,) for p in paths], "path array<int>")
    got = model._expect(df, 2, 3)
    for have, want in zip(got, (pi, a, b, ll), strict=True):
        assert have == pytest.approx(want)
