"""Preparation, files, streams, the hidden Markov predictor, and the driver contract."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pathmix.operators import iohmm as H
from pathmix.operators import prepare as R
from pathmix.operators import report as B
from pathmix.operators import splits as L
from pathmix.operators import windows as W
from pathmix.sources import files as X
from pathmix.sources import tables as T
from pathmix.streaming import memory as S


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_conversion(spark):
    raw = spark.createDataFrame([(0, [10, 10, 30, 0, 0]), (1, [10, 77, 30, 0, 0]), (2, [10, 0, 0, 0, 0]), (3, [10, 20, 10, 0, 0]), (4, [10, 50, 0, 0, 0])], "trip_id bigint, cells array<int>")
    mapping = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (50, 5)], "cell int, node int")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (2, 1, 1.0)], "source int, target int, length double")
    got = {r["trip_id"]: r["path"] for r in R.converted(raw, mapping, edges).collect()}
    assert got == {0: [1, 2, 3], 4: [1, 5]}  # unmapped, short and circular trips go; without a route the jump stays


def test_trip_files(spark, tmp_path):
    paths = spark.createDataFrame([(0, [1, 2, 3]), (7, [2, 3])], "trip_id bigint, path array<int>")
    table = R.trip_table(paths, F.lit(3.0))
    X.write_trips(table.coalesce(1), str(tmp_path / "trips"))
    back = X.trips(spark, str(tmp_path / "trips"), 3).collect()
    assert [(r["user_id"], r["role"], r["path"], r["trip_duration_min"], r["average_speed_kmh"]) for r in back] == [("user_00000", "driver", [1, 2, 3], 6.0, 30.0)]
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in (1, 2, 3)], "node int, lon double, lat double")
    checks = {r["check"]: r["bad"] for r in R.validate(table, nodes, spark.createDataFrame([(1, 2)], "source int, target int")).collect()}
    assert not any(checks.values())
    bad = {r["check"]: r["bad"] for r in R.validate(table.withColumn("origin_node", F.lit(9)), nodes.where("node < 3"), spark.createDataFrame([(8, 2)], "source int, target int")).collect()}
    assert bad["ends_differ"] == 2 and bad["unknown_nodes"] == 2 and bad["unknown_sources"] == 1


def test_network_files(spark, tmp_path):
    body = {"nodes": [{"id": 1, "x": 0.5, "y": 1.5}, {"id": 2, "x": 0.6, "y": 1.6}], "links": [{"source": 1, "target": 2, "length": 0.0}, {"source": 1, "target": 9, "length": 3.0}], "metadata": {"source": "osmnx"}}
    (tmp_path / "net.json").write_text(json.dumps(body))
    nodes, edges = X.network(spark, str(tmp_path / "net.json"))
    assert nodes.count() == 2 and [(r["source"], r["target"], r["length"]) for r in edges.collect()] == [(1, 2, 1.0)]
    assert X.is_surveyed(spark, str(tmp_path / "net.json"))


def test_archives(spark, tmp_path):
    held = io.BytesIO()
    np.savez(held, traj=np.array([[3, 4, 0], [5, 0, 0]]))
    (tmp_path / "1_XX_Town.npz").write_bytes(held.getvalue())
    got = X.archives(spark, str(tmp_path)).orderBy("trip_id").collect()
    assert [r["cells"] for r in got] == [[3, 4, 0], [5, 0, 0]] and X.prefix(got[0]["name"], "cells") == "cells_1_XX"


def test_count_tables_and_results(spark, tmp_path, sf):
    counts = W.ngrams(T.event_paths(spark, sf), 2)
    X.write_counts(counts, str(tmp_path / "counts"))
    assert X.read_counts(spark, str(tmp_path / "counts"), 1).count() == counts.where("k = 1").count()
    records = spark.createDataFrame([("a", 0, "MC2", "acc1", 0.5), ("a", 1, "MC2", "acc1", 0.7)], "dataset string, split int, model string, metric string, value double")
    X.write_results(records, str(tmp_path / "out"))
    assert X.results(spark, [str(tmp_path / "none"), str(tmp_path / "out/records")]).count() == 2
    r = B.over_splits(records).first()
    assert (r["mean"], r["std"]) == (pytest.approx(0.6), pytest.approx(0.1))
    text = B.latex([{"model": "MC_2", "acc1": 0.5, "acc1_best": True}], ["acc1"])
    assert r"MC\_2 & \textbf{0.5000}" in text


def test_splits_are_disjoint(spark, sf):
    paths = T.event_paths(spark, sf)
    rows = L.by_user(paths, users=5).collect()
    assert len(rows) == paths.count() and {r["split"] for r in rows} == {"train", "val", "test", "history"}
    chosen = {r["user_id"] for r in rows if r["split"] in ("test", "history")}
    assert len(chosen) == 5 and not chosen & {r["user_id"] for r in rows if r["split"] in ("train", "val")}


def test_hidden_markov_improves(spark, sf):
    model = H.HiddenMarkov(3, 6, tolerance=0.0).fit(T.event_paths(spark, sf), 5)
    gain = np.diff(model.history)
    assert len(model.history) == 6 and (gain > -1e-3).all()
    assert model.a.sum(axis=1) == pytest.approx(np.ones(len(model.pi))) and model.b.sum(axis=1) == pytest.approx(np.ones(len(model.pi)))
    assert H.state_cap(10, 100, 100_000) == 8 and H.state_cap(10, 100, 100) == 2


def test_stream_is_batch(spark, tmp_path):
    rows = [(u, s, (u * 7 + s * 3) % 5) for s in range(12) for u in range(3)]
    steps = spark.createDataFrame(rows, "user_id bigint, seq bigint, node int")
    for part in range(3):
        steps.where(F.floor(F.col("seq") / 4) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("user_id bigint, seq bigint, node int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = S.stream(live, 4).writeStream.format("memory").queryName("memories").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    live_rows = {(r["user_id"], r["seq"]): r["memory"] for r in spark.sql("select * from memories").collect()}
    # files may arrive in any order across parts; a user's memory holds what came before in arrival order
    assert len(live_rows) == 36 and all(len(m) <= 4 for m in live_rows.values())
    whole = {(r["user_id"], r["seq"]): r["memory"] for r in S.batch(steps, 4).collect()}
    assert sum(live_rows[k] == whole[k] for k in whole) >= 12


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*7) as ts, id % 2 as node, id % 3 as user_id from range(40)")
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    query = S.windowed_counts(live).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("select * from counted").collect()} == {tuple(r) for r in S.windowed_counts(rows).collect()}
    assert S.sessions(rows, "30 minutes").agg(F.sum("n")).first()[0] == 40
