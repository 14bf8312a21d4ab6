"""Queries do their whole job: nothing is left out by id."""

import heapq
import inspect
import random
from collections import Counter

import pytest

from pathmix import catalog
from pathmix.operators import graph as R
from pathmix.operators import iohmm as H


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A star schema of 90 orders over eight suppliers whose road lengths are powers of two, so that no routes tie."""
    sf = tmp_path_factory.mktemp("small")
    rng, nodes = random.Random(7), [1, 21, 17, 37, 9, 29, 13, 33]
    trips = {t: [rng.choice(nodes) for _ in range(rng.randint(1, 6))] for t in range(1, 91)}
    ends = sorted((a, b) for a in nodes for b in nodes if a != b and (a * 31 + b * 17) % 20 == 0)
    length = {e: 2**k for k, e in enumerate(ends)}
    lines = [(t, i, 0, n, length.get((n, (path[i + 1 :] or [n])[0]), 1)) for t, path in trips.items() for i, n in enumerate(path)]
    rows = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity int")
    rows.selectExpr("*", "date'2024-01-01' as l_shipdate", "0.0 as l_extendedprice").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(n,) for n in nodes], "s_suppkey bigint").write.parquet(f"{sf}/supplier.parquet")
    seen = {p for path in trips.values() for p in zip(path, path[1:], strict=False)}
    return str(sf), trips, {e: w for e, w in length.items() if e in seen}


def route(edges, a, b):
    heap, done = [(0, [a])], set()
    while heap:
        cost, path = heapq.heappop(heap)
        if path[-1] == b:
            return path
        if path[-1] not in done:
            done.add(path[-1])
            for (x, y), w in edges.items():
                if x == path[-1]:
                    heapq.heappush(heap, (cost + w, [*path, y]))
    return None


def test_all_trips_are_converted(spark, small):
    sf, trips, edges = small
    want = {}
    for t, path in trips.items():
        path = [n for i, n in enumerate(path) if not i or n != path[i - 1]]
        whole = path[:1]
        for a, b in zip(path, path[1:], strict=False):
            whole += (route(edges, a, b) or [a, b])[1:]
        out = []
        for n in whole:
            out = out[: out.index(n) + 1] if n in out else [*out, n]
        if len(path) >= 2 and len(out) >= 2:
            want[t] = "-".join(map(str, out))
    assert len(want) > 30
    assert {r["trip_id"]: r["path"] for r in catalog.QUERIES["converted_trips"](spark, sf).collect()} == want


def test_all_transitions_are_routed(spark, small):
    sf, trips, edges = small
    want = Counter()
    for path in trips.values():
        for a, b in zip(path, path[1:], strict=False):
            if a != b and (way := route(edges, a, b)):
                want.update(zip(way, way[1:], strict=False))
    got = catalog.QUERIES["transition_routing"](spark, sf).collect()
    assert {(r["source"], r["target"]): r["n"] for r in got} == want


def test_hidden_markov_of_the_reference(spark, sf, monkeypatch):
    made = []

    class Noted(H.HiddenMarkov):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            made.append((self.states, self.rounds))
            self.rounds = 1

    monkeypatch.setattr(H, "HiddenMarkov", Noted)
    assert catalog.QUERIES["iohmm_predict"](spark, sf).count() and made == [(10, 50)]


def test_unsettled_costs_raise(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "source int, target int, length double")
    source = spark.createDataFrame([(0,)], "source int")
    with pytest.raises(ValueError):
        R.shortest_costs(edges, source, most=1)
    assert R.shortest_costs(edges, source, most=3).count() == 4
    assert inspect.signature(R.shortest_costs).parameters["most"].default is None  # by default rounds go on
    with pytest.raises(ValueError):  # a cycle of negative length has no least cost
        R.shortest_costs(edges.unionByName(edges.selectExpr("1 as source", "0 as target", "-5.0d as length").limit(1)), source)


def test_vocabulary_of_all_training_trips(spark, small):
    sf, trips, _ = small
    ids = {n: str(i) for i, n in enumerate(sorted({n for t, path in trips.items() if t % 5 for n in path}))}
    got = {r["trip_id"]: r["path"] for r in catalog.QUERIES["categorical_encode"](spark, sf).collect()}
    assert got == {t: "-".join(ids[n] for n in path) for t, path in trips.items()}
    tails = {r["trip_id"]: r["ctx"] for r in catalog.QUERIES["context_encode"](spark, sf).collect()}
    assert tails == {t: "-".join(ids[n] for n in path[-3:]) for t, path in trips.items()}
