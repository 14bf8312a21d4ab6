"""A hidden Markov predictor: expectation steps over partitions, small parameters on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W


def state_cap(states: int, size: int, observations: int) -> int:
    """The number of states that vocabulary and data can carry."""
    return min(states, max(2, min(8, size, min(12, max(2, observations // 200)))))


def _forward_backward(obs: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    n, s = len(obs), len(pi)
    alpha, scale = np.zeros((n, s)), np.zeros(n)
    alpha[0] = pi * b[:, obs[0]]
    for t in range(n):
        if t:
            alpha[t] = alpha[t - 1] @ a * b[:, obs[t]]
        scale[t] = alpha[t].sum() or 1e-300
        alpha[t] /= scale[t]
    beta = np.ones((n, s))
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (b[:, obs[t + 1]] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    moves = np.zeros((s, s))
    for t in range(n - 1):
        x = alpha[t][:, None] * a * (b[:, obs[t + 1]] * beta[t + 1])[None, :]
        moves += x / x.sum()
    return gamma, moves, float(np.log(scale).sum())


class HiddenMarkov:
    """States S, start pi[S], moves a[S, S] on the driver; emissions b[S, V] as small arrays for small vocabularies."""

    def __init__(self, states: int = 8, rounds: int = 20, tolerance: float = 1e-4, seed: int = 42, move_prior: float = 0.1, emit_prior: float = 2.0):
        self.states, self.rounds, self.tolerance, self.seed = states, rounds, tolerance, seed
        self.move_prior, self.emit_prior = move_prior, emit_prior
        self.history: list[float] = []

    def fit(self, paths: DataFrame, size: int, progress: Callable[[int, float], None] | None = None) -> HiddenMarkov:
        """paths (path of nodes 0..size-1). Each round is one pass: partitions send their expected counts."""
        marginal = np.zeros(size)
        for r in W.steps(paths).groupBy("node").agg(F.count("*").alias("n")).collect():
            marginal[r["node"]] = r["n"]
        total = marginal.sum()
        self.marginal = marginal / total
        s = state_cap(self.states, size, int(total))
        rng = np.random.default_rng(self.seed)
        self.pi, self.a = rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), size=s)
        logits = np.log(self.marginal + 1e-12) + 1.5 * rng.standard_normal((s, size))
        self.b = np.exp(logits - logits.max(axis=1, keepdims=True))
        self.b /= self.b.sum(axis=1, keepdims=True)
        for k in range(self.rounds):
            pi, a, b, ll = self._expect(paths, s, size)
            self.pi = (pi + 1e-6) / (pi + 1e-6).sum()
            self.a = (a + self.move_prior) / (a + self.move_prior).sum(axis=1, keepdims=True)
            emit = b + self.emit_prior * self.marginal
            self.b = emit / emit.sum(axis=1, keepdims=True)
            self.history.append(ll / total)
            if progress:
                progress(k, ll / total)
            if k and abs(self.history[-1] - self.history[-2]) < self.tolerance:
                break
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """part (pi, a, b), row, values: the parameters, one row for pi and one per state for the others."""
        rows = [("pi", 0, self.pi.tolist()), *[(part, k, v.tolist()) for part, held in (("a", self.a), ("b", self.b)) for k, v in enumerate(held)]]
        return spark.createDataFrame(rows, "part string, row int, values array<double>")

    @classmethod
    def from_table(cls, table: DataFrame) -> HiddenMarkov:
        rows = sorted(map(tuple, table.collect()))
        held = {part: np.array([v for p, _, v in rows if p == part]) for part in ("pi", "a", "b")}
        model = cls(len(held["a"]))
        model.pi, model.a, model.b = held["pi"][0], held["a"], held["b"]
        return model

    def _expect(self, paths: DataFrame, s: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        pi0, a0, b0 = self.pi, self.a, self.b

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pi, a, b, ll = np.zeros(s), np.zeros((s, s)), np.zeros((s, size)), 0.0
            for part in parts:
                for path in part["path"]:
                    obs = np.asarray(path, np.int64)
                    if len(obs):
                        gamma, moves, own = _forward_backward(obs, pi0, a0, b0)
                        pi += gamma[0]
                        a += moves
                        np.add.at(b.T, obs, gamma)
                        ll += own
            flat = np.concatenate([pi, a.ravel(), b.ravel(), [ll]])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        sums = paths.select("path").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(s + s * s + s * size + 1)
        for r in sums:
            flat[r["i"]] = r["v"]
        return flat[:s], flat[s : s + s * s].reshape(s, s), flat[s + s * s : -1].reshape(s, size), float(flat[-1])

    def tilt(self, contexts: DataFrame) -> DataFrame:
        """ctx, prefer: what the filtered state after ctx makes of each node; a node unseen in training tells nothing."""
        pi, a, b = self.pi, self.a, self.b

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for ctx in part["ctx"]:
                    state = pi
                    for k, node in enumerate(ctx):
                        state = state if k == 0 else state @ a
                        if 0 <= node < b.shape[1]:
                            state = state * b[:, node]
                            state = state / (state.sum() or 1.0)
                    out.append(((state @ a) @ b).tolist())
                yield pd.DataFrame({"ctx": part["ctx"], "prefer": out})

        return contexts.select("ctx").distinct().mapInPandas(run, "ctx array<int>, prefer array<double>")


def predict(train: DataFrame, model: HiddenMarkov, contexts: DataFrame, amount: float = 0.05) -> DataFrame:
    """ctx, d: counts of what follows the last two nodes (or one) times a tilt of 1 -+ amount by the preferred nodes."""
    return predict_counts(W.ngrams(train, 2), model, contexts, amount)


def predict_counts(counts: DataFrame, model: HiddenMarkov, contexts: DataFrame, amount: float = 0.05) -> DataFrame:
    """`predict` from counts of orders one and two."""
    from . import distributions as D

    found = W.match(contexts.select("ctx").distinct(), W.rows_of(counts), 2).join(model.tilt(contexts), "ctx")
    gate = D.from_counts(F.element_at("found", -1))
    score = F.transform(gate["p"], lambda x: F.get("prefer", x["node"]))
    low, high = F.array_min(score), F.array_max(score)
    factor = lambda v: F.when(high > low, 1 - amount + 2 * amount * (F.get("prefer", v) - low) / (high - low)).otherwise(F.lit(1.0))
    raw = F.struct(F.transform(gate["p"], lambda x: F.struct(x["node"].alias("node"), (x["p"] * factor(x["node"])).alias("p"))).alias("p"), F.lit(0.0).alias("floor"))
    return found.where(F.size("found") > 0).withColumn("_raw", raw).select("ctx", D.scaled(F.col("_raw"), D.total(F.col("_raw.p"), lambda x: x["p"])).alias("d"))
