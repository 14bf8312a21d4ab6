"""Splits, predictors and traces through files give what they give in memory."""

import pytest
from pyspark.sql import functions as F

from pathmix.operators import flow, registry, splits
from pathmix.operators import graph as R
from pathmix.operators import report as B
from pathmix.operators import score as S
from pathmix.operators import windows as W
from pathmix.plans.report_queries import records
from pathmix.sources import files as X
from pathmix.sources import tables as T

NAMES = ["mc3", "mogen3", "dmmc", "iohmm"]


@pytest.fixture(scope="module")
def saved(spark, sf, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("flow") / "split")
    rows = splits.by_user(T.event_paths(spark, sf), users=5)
    flow.save_split(rows, place, dataset="events", seed=42)
    flow.train(place, NAMES, spark)
    return place


def plain(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_split_and_models_come_back(spark, sf, saved):
    held = flow.load_split(spark, saved)
    assert flow.metadata(spark, saved)["dataset"] == "events" and {"paths", "vocab", "kgrams", "prior", "successors", "histories"} <= set(held)
    rows = splits.by_user(T.event_paths(spark, sf), users=5)
    assert plain(held["paths"]) == plain(rows.select("trip_id", "user_id", "path", "split"))
    train = rows.where("split = 'train'").select("trip_id", "user_id", "path")
    windows = W.samples(rows.where("split = 'test'").select("trip_id", "user_id", "path"), 5)
    for name in NAMES[:2]:
        model, tables = flow.load_model(spark, f"{saved}/models/{name}")
        got, want = (S.metrics(S.scored(windows, d)) for d in (model.apply(tables, windows), registry.predictor(name).distribution(train, windows)))
        assert plain(got) == plain(want)


def test_evaluation_writes_traces(spark, saved):
    got = {(r["model"], r["metric"]): r["value"] for r in flow.evaluate(spark, saved, NAMES, "events", steps=2).collect()}
    assert all((name, "acc1") in got and (name, "nll") in got for name in NAMES)
    assert ("mc3", "ar_ar1") in got and ("dmmc", "ar_ar1") not in got
    trace = spark.read.parquet(f"{saved}/traces/mc3/next")
    assert got["mc3", "acc1"] == pytest.approx(trace.agg(F.avg((F.col("rank") <= 1).cast("double"))).first()[0], abs=1e-6)
    for r in flow.panels(saved, "mc3", spark).collect():
        assert len(r["true"]) == len(r["forced"]) == len(r["loop"]) and len(r["seed"]) == 5 and r["forced"][0] == r["loop"][0]


def test_empty_tables_come_back(spark, tmp_path):
    none = spark.createDataFrame([], "trip_id bigint, user_id bigint, path array<int>")
    model = registry.predictor("mc2")
    flow.save_model("mc2", model.fit(none), str(tmp_path / "m"))
    back, tables = flow.load_model(spark, str(tmp_path / "m"))
    contexts = spark.createDataFrame([([1, 2],)], "ctx array<int>")
    assert back.order == 2 and tables["counts"].count() == 0 and back.apply(tables, contexts).count() == 1


def test_means_are_recomputed(spark, sf, tmp_path):
    X.write_results(records(spark, sf), str(tmp_path / "whole"))
    records(spark, sf).write.partitionBy("dataset").parquet(str(tmp_path / "bare" / "records"))
    want = plain(B.over_splits(records(spark, sf)).select("dataset", "model", "metric", "mean", "splits"))
    for roots in (["none", "bare"], ["whole", "bare"]):
        got = flow.means(spark, [str(tmp_path / r) for r in roots])
        assert plain(got.select("dataset", "model", "metric", "mean", "splits")) == want
    with pytest.raises(FileNotFoundError):
        flow.means(spark, [str(tmp_path / "none")])


def test_features_by_name(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "source int, target int, length double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node int")
    assert {n: sorted(r["node"] for r in f(edges, nodes).collect()) for n, f in R.FEATURES.items()} == {n: [1, 2, 3] for n in R.FEATURES}
