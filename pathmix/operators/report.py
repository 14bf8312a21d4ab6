"""Aggregation of metric records (dataset, split, model, metric, value) and comparison tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over_splits(records: DataFrame) -> DataFrame:
    """Mean over the splits that have the metric, population deviation where there is more than one."""
    n = F.count("value")
    return records.groupBy("dataset", "model", "metric").agg(F.avg("value").alias("mean"), F.when(n > 1, F.stddev_pop("value")).alias("std"), n.alias("splits"))


def over_datasets(records: DataFrame) -> DataFrame:
    """Mean of the datasets' means, each weighing the same."""
    means = over_splits(records)
    return means.groupBy("model", "metric").agg(F.avg("mean").alias("mean"), F.when(F.count("mean") > 1, F.stddev_pop("mean")).alias("std"), F.count("mean").alias("datasets"))


def pooled(records: DataFrame) -> DataFrame:
    """Mean over all records of all datasets."""
    return records.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def wide(means: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per model, one column per metric; nll also in bits."""
    out = means.groupBy("model").pivot("metric", metrics).agg(F.first("mean"))
    return out.withColumn("ic_bits", F.col("nll") / math.log(2)) if "nll" in metrics else out


def family(model: Column) -> Column:
    """The model's name without its order."""
    return F.regexp_replace(model, "[0-9]+P?$", "")


def order_of(model: Column) -> Column:
    return F.coalesce(F.regexp_extract(model, "([0-9]+)P?$", 1).try_cast("int"), F.lit(0))


def best_per_family(means: DataFrame, metric: str = "acc1") -> DataFrame:
    """The model with the highest value in each family, the first by name of equals."""
    rows = means.where(F.col("metric") == metric).select(family(F.col("model")).alias("family"), "model", "mean")
    best = Window.partitionBy("family").orderBy(F.desc("mean"), "model")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def marked(means: DataFrame, lower: tuple[str, ...] = ("nll", "brier", "km")) -> DataFrame:
    """Adds best: whether a model has its metric's best value (within 1e-12; the lowest for `lower`)."""
    per = Window.partitionBy("metric")
    top = F.when(F.col("metric").isin(*lower), F.min("mean").over(per)).otherwise(F.max("mean").over(per))
    return means.withColumn("best", F.abs(F.col("mean") - top) <= 1e-12)


def boxes(records: DataFrame) -> DataFrame:
    """Quartiles and whiskers of each model's metric."""
    q = [F.percentile("value", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return records.where("value is not null and not isnan(value)").groupBy("model", "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), *q, F.max("value").alias("high"))


def fold_summary(records: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and best split per model and metric."""
    return records.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("split", F.struct("value", -F.col("split"))).alias("best_split")
    )


def ordered(models: DataFrame, groups: dict[str, int]) -> DataFrame:
    """Models with their place: by group of the family, family, order, name."""
    pairs = F.create_map(*[F.lit(x) for p in groups.items() for x in p])
    rows = models.select("model", F.coalesce(pairs[family(F.col("model"))], F.lit(99)).alias("group"), family(F.col("model")).alias("family"), order_of(F.col("model")).alias("order"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("group", "family", "order", "model")))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old records of models that were not evaluated again, and all new ones."""
    return old.join(new.select("dataset", "model").distinct(), ["dataset", "model"], "left_anti").unionByName(new)


def of_splits(records: DataFrame, splits: list[int]) -> DataFrame:
    return records.where(F.col("split").isin(splits))


def of_networks(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records of data sets that are named by one of the keys or end in _key; all records if no data set matches."""
    names = records.select("dataset").distinct()
    hit = F.lit(False)
    for k in keys:
        hit = hit | (F.col("dataset") == k) | F.col("dataset").endswith(f"_{k}")
    any_ = names.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("_any"))
    return records.join(F.broadcast(any_)).where(hit | (F.col("_any") == 0)).drop("_any")


def without_embeddings(records: DataFrame) -> DataFrame:
    """Records of models that are not encoded by graph embeddings."""
    return records.where(~(F.contains("model", F.lit("graph_embedding")) | F.upper("model").endswith("_GE")))


def safe_name(column: Column) -> Column:
    """An id as part of a file name: every character but letters, digits, - and _ becomes _."""
    return F.regexp_replace(column, r"[^\p{L}\p{N}_-]", "_")


def latex(rows: list[dict], columns: list[str]) -> str:
    """A booktabs table of collected rows (a comparison table has a row per model); best values in bold."""
    escape = lambda s: str(s).replace("_", r"\_").replace("%", r"\%")
    lines = [r"\begin{tabular}{l" + "r" * len(columns) + "}", r"\toprule", " & ".join(["model", *map(escape, columns)]) + r" \\", r"\midrule"]
    for r in rows:
        cells = []
        for c in columns:
            v = r.get(c)
            text = "--" if v is None else f"{v:.4f}"
            cells.append(rf"\textbf{{{text}}}" if r.get(f"{c}_best") else text)
        lines.append(" & ".join([escape(r["model"]), *cells]) + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", ""])
