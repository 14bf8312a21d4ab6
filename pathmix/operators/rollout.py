"""Closed-loop continuation of paths: all paths advance together, one step per loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from . import distributions as D
from . import windows as W
from .settled import cut
from .score import rounded


def greedy(seeds: DataFrame, predict: Callable[[DataFrame], DataFrame], tail: int) -> DataFrame:
    """seeds (key columns, ctx, steps) continued by the most probable node, `steps` times each: keys, pred, and with
    `truth` (the nodes that really follow) also ranks and p of the true nodes.

    `predict` turns distinct (ctx) into (ctx, d); only the last `tail` nodes of a path are its context, so paths with
    the same context share one prediction.
    """
    keys = [c for c in seeds.columns if c not in ("ctx", "steps", "truth")]
    rows = seeds.withColumn("pred", F.array().cast("array<int>")).withColumn("ranks", F.array().cast("array<int>")).withColumn("probs", F.array().cast("array<double>"))
    most, last = seeds.agg(F.max("steps")).first()[0] or 0, None
    for step in range(most):
        rows = rows.withColumn("ctx", P.tail(F.col("ctx"), tail))
        ahead = predict(rows.where(F.col("steps") > step).select("ctx").distinct())
        rows = rows.join(ahead, "ctx", "left")
        tied = rounded(F.col("d"))
        best = F.coalesce(D.top(tied), F.element_at("ctx", -1))
        going = F.col("steps") > step
        true = F.get("truth", F.lit(step))
        rows = (
            rows.withColumn("_n", best)
            .withColumn("ranks", F.when(going, F.concat("ranks", F.array(D.rank(tied, true)))).otherwise(F.col("ranks")))
            .withColumn("probs", F.when(going, F.concat("probs", F.array(D.at(F.col("d"), true)))).otherwise(F.col("probs")))
            .withColumn("pred", F.when(going, F.concat("pred", F.array("_n"))).otherwise(F.col("pred")))
            .withColumn("ctx", F.when(going, F.concat("ctx", F.array("_n"))).otherwise(F.col("ctx")))
            .drop("d", "_n")
        )
        # the next step reads these rows twice (contexts and paths), so they are written once
        rows = last = cut(rows, last)
    return rows.select(*keys, "truth", "pred", "ranks", "probs")


def leading_run(ranks: Column) -> Column:
    """Steps before the first miss."""
    first = F.array_position(F.transform(ranks, lambda r: (r != 1).cast("int")), 1)
    return F.when(first > 0, first - 1).otherwise(F.size(ranks)).cast("int")


def horizon(ranks: Column, share: float = 0.75) -> Column:
    """The last step up to which at least `share` of all steps were hits; 0 if none."""
    cumulated = F.transform(ranks, lambda r, i: F.size(F.filter(F.slice(ranks, F.lit(1), i + 1), lambda x: x == 1)) / (i + 1))
    reached = F.transform(cumulated, lambda c, i: F.when(c >= share, i + 1).otherwise(0))
    return F.coalesce(F.array_max(reached), F.lit(0)).cast("int")


def path_scores(rolled: DataFrame, theta: float = 0.75, floor: float = 1e-12) -> DataFrame:
    """Per path: steps, hits, leading run, horizon, endpoint match, Jaccard of node sets, edit distance, mean nll."""
    keys = [c for c in rolled.columns if c not in ("truth", "pred", "ranks", "probs")]
    r = F.col("ranks")
    return rolled.select(
        *keys, F.size("pred").alias("steps"), F.size(F.filter(r, lambda x: x == 1)).alias("hits"), F.size(F.filter(r, lambda x: x <= 3)).alias("hits3"),
        F.round(D.total(r, lambda x: 1.0 / x), 6).alias("rr"), leading_run(r).alias("lead_run"), horizon(r, theta).alias("horizon"),
        (F.element_at("pred", -1) == F.element_at("truth", -1)).cast("int").alias("endpoint"), F.round(P.jaccard(F.col("pred"), F.col("truth")), 6).alias("jaccard"),
        P.edit_distance(F.col("pred"), F.col("truth")).alias("edits"), F.round(D.total(F.col("probs"), lambda p: -F.ln(F.greatest(p, F.lit(floor)))) / F.size("probs"), 6).alias("nll"),
    )


def ar_metrics(scores: DataFrame) -> DataFrame:
    """Token shares over all steps, path shares over paths."""
    n = F.sum("steps")
    return scores.agg(
        F.count("*").alias("paths"), n.cast("bigint").alias("tokens"), F.round(F.sum("hits") / n, 6).alias("ar1"), F.round(F.sum("hits3") / n, 6).alias("ar3"), F.round(F.sum("rr") / n, 4).alias("mrr"),
        F.round(F.avg(F.col("endpoint").cast("double")), 6).alias("endpoint"), F.round(F.avg("jaccard"), 5).alias("jaccard"), F.round(F.avg(F.col("lead_run").cast("double")), 6).alias("lead_run"),
        F.round(F.avg(F.col("horizon").cast("double")), 6).alias("horizon"), F.round(F.avg(F.col("edits").cast("double")), 6).alias("edits"),
    )


def beam(seeds: DataFrame, predict: Callable[[DataFrame], DataFrame], tail: int, width: int = 3) -> DataFrame:
    """keys, pred, logp, place: the `width` most probable continuations of each seed."""
    keys = [c for c in seeds.columns if c not in ("ctx", "steps", "truth")]
    rows = seeds.select(*keys, "ctx", "steps").withColumn("pred", F.array().cast("array<int>")).withColumn("logp", F.lit(0.0))
    most, last = seeds.agg(F.max("steps")).first()[0] or 0, None
    for step in range(most):
        rows = rows.withColumn("ctx", P.tail(F.col("ctx"), tail))
        going, done = rows.where(F.col("steps") > step), rows.where(F.col("steps") <= step)
        near = going.join(predict(going.select("ctx").distinct()), "ctx").select(*keys, "ctx", "steps", "pred", "logp", F.explode("d.p").alias("x")).where("x.p > 0")
        grown = near.select(*keys, F.concat("ctx", F.array("x.node")).alias("ctx"), "steps", F.concat("pred", F.array("x.node")).alias("pred"), (F.col("logp") + F.ln("x.p")).alias("logp"))
        order = Window.partitionBy(*keys).orderBy(F.desc(F.round("logp", 9)), "pred")
        rows = grown.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r").unionByName(done.select(*keys, "ctx", "steps", "pred", "logp"))
        # the next step reads these rows twice (contexts and paths), so they are written once
        rows = last = cut(rows, last)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("logp", 9)), "pred")
    return rows.select(*keys, "pred", "logp", F.row_number().over(order).alias("place"))


def between(pairs: DataFrame, predict: Callable[[DataFrame], DataFrame], length: int, most: int = 20, recent: int = 9) -> DataFrame:
    """pairs (key, origin, destination) walked greedily from `length` copies of the origin: key, path, reached. Where
    the best node is among the last `recent` ones the second best is taken; a walk ends at its destination."""
    rows = pairs.withColumn("path", F.array("origin")).withColumn("ctx", F.array_repeat("origin", length)).withColumn("reached", F.col("origin") == F.col("destination"))
    keys, last = [c for c in pairs.columns if c not in ("origin", "destination")], None
    for _ in range(most):
        rows = rows.withColumn("ctx", P.tail(F.col("ctx"), length))
        rows = rows.join(predict(rows.where(~F.col("reached")).select("ctx").distinct()), "ctx", "left")
        tied = rounded(F.col("d"))
        order = F.transform(F.array_sort(F.transform(tied["p"], lambda x: F.struct((-x["p"]).alias("q"), x["node"].alias("node")))), lambda x: x["node"])
        first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        pick = F.when(F.array_contains(P.tail(F.col("path"), recent), first) & second.isNotNull(), second).otherwise(first)
        going = ~F.col("reached") & pick.isNotNull()
        rows = (
            rows.withColumn("_n", F.when(going, pick))
            .withColumn("path", F.when(F.col("_n").isNotNull(), F.concat("path", F.array("_n"))).otherwise(F.col("path")))
            .withColumn("ctx", F.when(F.col("_n").isNotNull(), F.concat("ctx", F.array("_n"))).otherwise(F.col("ctx")))
            .withColumn("reached", F.col("reached") | F.coalesce(F.col("_n") == F.col("destination"), F.lit(False)))
            .drop("d", "_n")
        )
        # the next step reads these rows twice (contexts and paths), so they are written once
        rows = last = cut(rows, last)
    return rows.select(*keys, "origin", "destination", "path", "reached")


def top_successors(train: DataFrame, highest: int) -> DataFrame:
    """k, sfx, node: the most frequent successor of each context, the smaller of equals; what back-off needs."""
    return W.rows_of(W.ngrams(train, highest)).select("k", "sfx", D.top(D.from_counts(F.struct("n", "nexts"))).alias("node"))
