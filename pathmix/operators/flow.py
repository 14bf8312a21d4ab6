"""From paths to scores through files: splits, fitted predictors, traces and records are written and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import registry
from . import report as B
from . import rollout as O
from . import score as S
from . import windows as W


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def _save(tables: dict[str, DataFrame], path: str, meta: dict) -> None:
    for name, table in tables.items():
        by = [c for c in ("split", "k") if c in table.columns][:1]
        table.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    _write_meta(spark, meta | {"tables": {name: table.schema.json() for name, table in tables.items()}}, f"{path}/meta")


def _load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables with their own columns and types, empty ones too."""
    held = metadata(spark, path)["tables"]
    schemas = {name: StructType.fromJson(json.loads(schema)) for name, schema in held.items()}
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names) for name, schema in schemas.items()}


def save_split(rows: DataFrame, path: str, length: int = 5, k: int = 2, clusters: DataFrame | None = None, **meta) -> None:
    """What an evaluation of this split needs: rows (trip_id, user_id, path, split), the vocabulary and k-grams of its
    training paths, visits and successors of one and two nodes there, histories, and a map of clusters if there is one."""
    train = rows.where("split = 'train'").select("trip_id", "user_id", "path")
    tables = {
        "paths": rows.select("trip_id", "user_id", "path", "split"), "vocab": W.vocabulary(train), "kgrams": W.kgram_vocabulary(train, k),
        "prior": W.steps(train).groupBy("node").agg(F.count("*").alias("cnt")), "successors": W.ngrams(train, 2),
        "histories": W.histories(rows.where("split in ('train', 'history')"), "user_id", "trip_id", W.HISTORY),
    } | ({"clusters": clusters} if clusters is not None else {})
    _save(tables, path, {"length": length, "k": k} | meta)


def load_split(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _load(spark, path)


def save_model(name: str, tables: dict[str, DataFrame], path: str, **options) -> None:
    """The tables of a fitted predictor, with the name and options that make it."""
    _save(tables, path, {"model": name, "options": options})


def load_model(spark: SparkSession, path: str) -> tuple[registry.Predictor | registry.Memories | registry.States, dict[str, DataFrame]]:
    meta = metadata(spark, path)
    return registry.predictor(meta["model"], **meta["options"]), _load(spark, path)


def train(split: str, names: list[str], spark: SparkSession) -> None:
    """Fits the predictors on a saved split and writes each below it. Where users' histories are held out of training,
    memories read them and the population does not."""
    paths = load_split(spark, split)["paths"]
    own = {part: paths.where(F.col("split") == part).select("trip_id", "user_id", "path") for part in ("train", "history")}
    held = None if own["history"].isEmpty() else own["history"]
    for name in names:
        model = registry.predictor(name)
        tables = model.fit(own["train"], held) if isinstance(model, registry.Memories) else model.fit(own["train"])
        save_model(name, tables, f"{split}/models/{name}")


def next_nodes(scored: DataFrame) -> DataFrame:
    """The trace of scored windows: trip_id, pos, true, pred, rank."""
    return scored.select("trip_id", "pos", F.col("target").alias("true"), F.col("top1").alias("pred"), "rank")


def forced(trace: DataFrame) -> DataFrame:
    """Per trip what follows its first window and what the predictor made of each true context: trip_id, true, pred."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "true", "pred")))
    return trace.groupBy("trip_id").agg(steps.alias("s")).select("trip_id", F.transform("s", lambda x: x["true"]).alias("true"), F.transform("s", lambda x: x["pred"]).alias("pred"))


def closed_loop(model: registry.Predictor | registry.States, tables: dict[str, DataFrame], paths: DataFrame, length: int, most: int) -> DataFrame:
    """The trace of rollouts of up to `most` steps: trip_id, seed, true, pred, ranks, probs."""
    truth = F.slice("path", length + 1, F.least(F.size("path") - length, F.lit(most)))
    seeds = W.at_least(paths, length + 1).select("trip_id", F.slice("path", 1, length).alias("seed"), F.slice("path", 1, length).alias("ctx"), F.size(truth).alias("steps"), truth.alias("truth"))
    return O.greedy(seeds, lambda c: model.apply(tables, c).select("ctx", "d"), length).withColumnRenamed("truth", "true")


def evaluate(spark: SparkSession, split: str, names: list[str], dataset: str, number: int = 0, steps: int = 0) -> DataFrame:
    """Records (dataset, split, model, metric, value) of the saved predictors on the split's test windows; traces are
    written below the split. With `steps` also rollouts, of the predictors that need no user."""
    held, length = load_split(spark, split), metadata(spark, split)["length"]
    test = held["paths"].where("split = 'test'").select("trip_id", "user_id", "path")
    windows, out = W.samples(test, length), None

    def records(row: DataFrame, name: str, prefix: str = "") -> DataFrame:
        values = [c for c in row.columns if c not in ("n", "paths", "tokens")]
        one = row.select(F.lit(dataset).alias("dataset"), F.lit(number).alias("split"), F.lit(name).alias("model"), *[F.col(c).cast("double").alias(prefix + c) for c in values])
        return one.unpivot(["dataset", "split", "model"], [prefix + c for c in values], "metric", "value")

    for name in names:
        model, tables = load_model(spark, f"{split}/models/{name}")
        scored = S.scored(windows, model.apply(tables, windows), list(model.keys), model.floor)
        next_nodes(scored).write.mode("overwrite").parquet(f"{split}/traces/{name}/next")
        parts = [records(S.metrics(scored), name)]
        if steps and not model.keys:
            closed_loop(model, tables, test, length, steps).write.mode("overwrite").parquet(f"{split}/traces/{name}/loop")
            rolled = spark.read.parquet(f"{split}/traces/{name}/loop").withColumnRenamed("true", "truth")
            parts.append(records(O.ar_metrics(O.path_scores(rolled.drop("seed"))), name, "ar_"))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def panels(split: str, name: str, spark: SparkSession) -> DataFrame:
    """trip_id, seed, true, teacher-forced and closed-loop continuation, of equal length: what a path panel shows."""
    loop = spark.read.parquet(f"{split}/traces/{name}/loop")
    own = forced(spark.read.parquet(f"{split}/traces/{name}/next")).select("trip_id", F.col("pred").alias("forced"))
    return loop.join(own, "trip_id").select("trip_id", "seed", "true", F.slice("forced", F.lit(1), F.size("true")).alias("forced"), F.col("pred").alias("loop"))


def means(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Mean results of the first root that holds records or means; recomputed from the records where means are missing."""
    from pyspark.errors import AnalysisException

    for root in roots:
        for read in (lambda r: spark.read.schema("dataset string, model string, metric string, mean double, std double, splits bigint").json(f"{r}/means_json"), lambda r: B.over_splits(spark.read.parquet(f"{r}/records"))):
            try:
                found = read(root)
                if not found.isEmpty():
                    return found
            except AnalysisException:
                continue
    raise FileNotFoundError(json.dumps(roots))
