"""Choice of the Markov order by an information criterion on ramp-up counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .settled import cut


def walks_of_length(edges: DataFrame, highest: int) -> DataFrame:
    """k, walks: walks of k steps over the distinct edges, for k = 1..highest: one join and sum per step."""
    steps = cut(edges.select("source", "target").distinct())
    level = steps.groupBy("target").agg(F.count("*").cast("double").alias("w"))
    out = level.agg(F.lit(1).alias("k"), F.sum("w").alias("walks"))
    for k in range(2, highest + 1):
        level = level.select(F.col("target").alias("source"), "w").join(steps, "source").groupBy("target").agg(F.sum("w").alias("w"))
        out = out.union(level.agg(F.lit(k).alias("k"), F.sum("w").alias("walks")))
    return out


def log_likelihood(train: DataFrame, highest: int, size: int) -> DataFrame:
    """k, ll of all paths under ramp-up tables of order 1..highest: start, moves at order min(i, k), and the end."""
    alpha = 1.0 / size
    out = None
    for top in range(1, highest + 1):
        start, moves, ends = W.rampup(train, top)
        per = moves.select("k", "ctx", "cnt").unionByName(ends.select("k", "ctx", "cnt")).groupBy("k", "ctx").agg(F.sum("cnt").alias("n"))
        starts = start.agg(F.sum("cnt").alias("t"))
        first = start.join(F.broadcast(starts)).agg(F.sum(F.col("cnt") * F.ln((F.col("cnt") + alpha) / (F.col("t") + alpha * size))).alias("ll"))
        p = F.ln((F.col("cnt") + alpha) / (F.col("n") + alpha * (size + 1)))
        inner = moves.join(per, ["k", "ctx"]).agg(F.sum(F.col("cnt") * p).alias("ll"))
        last = ends.join(per, ["k", "ctx"]).agg(F.sum(F.col("cnt") * p).alias("ll"))
        row = first.union(inner).union(last).agg(F.lit(top).alias("k"), F.sum("ll").alias("ll"))
        out = row if out is None else out.union(row)
    return out


def criterion(train: DataFrame, edges: DataFrame, highest: int, size: int) -> DataFrame:
    """k, dof (walks of up to k steps), ll, score (dof - ll), chosen (the first minimum)."""
    from pyspark.sql.window import Window

    up = Window.orderBy("k")
    dof = walks_of_length(edges, highest).withColumn("dof", F.sum("walks").over(up)).select("k", "dof")
    rows = dof.join(log_likelihood(train, highest, size), "k").withColumn("score", F.col("dof") - F.col("ll"))
    best = rows.agg(F.min_by("k", F.struct("score", "k")).alias("best"))
    return rows.join(F.broadcast(best)).select("k", "dof", "ll", "score", (F.col("k") == F.col("best")).alias("chosen"))
