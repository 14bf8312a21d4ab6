"""Scores of predictions: windows joined with the distribution of their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distributions as D


def rounded(d: Column, digits: int = 9) -> Column:
    """So that equal probabilities that were summed in different order tie."""
    return F.struct(F.transform(d["p"], lambda x: F.struct(x["node"].alias("node"), F.round(x["p"], digits).alias("p"))).alias("p"), F.round(d["floor"], digits).alias("floor"))


def scored(windows: DataFrame, predicted: DataFrame, keys: list[str] | None = None, floor: float = 1e-300, strict: bool = False) -> DataFrame:
    """windows with p_true, rank, nll (nats), brier, top1 for the `predicted` (keys, ctx, size, d) of their context.

    rank is optimistic: one more than the nodes with a higher probability; `strict` gives a target without a bump
    the last rank. The join has one row per distinct context on its right side.
    """
    rows = windows.join(predicted, [*(keys or []), "ctx"])
    d, size = F.col("d"), F.col("size").cast("double")
    tied = rounded(d)
    return (
        rows.withColumn("p_true", D.at(d, F.col("target")))
        .withColumn("rank", D.rank(tied, F.col("target"), F.col("size").cast("int") if strict else None))
        .withColumn("nll", -F.ln(F.greatest(F.col("p_true"), F.lit(floor))))
        .withColumn("brier", D.brier(d, F.col("target"), size))
        .withColumn("top1", D.top(tied))
        .drop("d")
    )


def metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, acc1, acc3, acc5, mrr, nll, brier, ndcg5 (rounded to 6 digits), in one aggregation."""

    def share(k: int) -> Column:
        return F.round(F.avg((F.col("rank") <= k).cast("double")), 6)

    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), share(1).alias("acc1"), share(3).alias("acc3"), share(5).alias("acc5"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"),
        F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("brier"), 6).alias("brier"),
        F.round(F.avg(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)), 6).alias("ndcg5"),
    )


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of the predicted probability: windows, mean probability of the target, hits of the best guess."""
    bin_ = F.least(F.floor(F.col("p_true") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p_true"), 6).alias("mean_p"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("hit_rate"))


def persistence(windows: DataFrame) -> DataFrame:
    """Windows, those whose target repeats the last node, their share, and distinct targets."""
    same = (F.col("target") == F.element_at("ctx", -1)).cast("bigint")
    return windows.agg(F.count("*").alias("n"), F.sum(same).alias("hits"), F.round(F.avg(same.cast("double")), 6).alias("accuracy"), F.countDistinct("target").alias("labels"))


def at_decisions(windows: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Windows whose current node has at least `least` distinct successors."""
    degree = edges.where("source <> target").groupBy(F.col("source").alias("_node")).agg(F.countDistinct("target").alias("degree"))
    return windows.withColumn("_node", F.element_at("ctx", -1)).join(degree, "_node", "left").where(F.coalesce("degree", F.lit(0)) >= least).drop("_node")
