"""Predictors by name: what to prepare, and the rule that makes distributions of it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import iohmm as H
from . import models as M
from . import windows as W


@dataclass(frozen=True)
class Predictor:
    """`order`: nodes of context it looks at; `rampup`: whether it reads ramp-up counts."""

    order: int
    rule: Callable[[], Column]
    rampup: bool = False
    keys: tuple[str, ...] = ()
    floor: float = 1e-300

    def distribution(self, train: DataFrame, windows: DataFrame) -> DataFrame:
        """ctx, size, d for each distinct context of the windows."""
        return self.apply(self.fit(train), windows)

    def fit(self, train: DataFrame) -> dict[str, DataFrame]:
        """The tables that the predictor is made of."""
        tables = {"counts": W.ngrams(train, 1 if self.rampup else max(self.order, 1), 0), "size": M.sizes(train)}
        return tables | ({"rampup": W.rampup(train, self.order)[1]} if self.rampup else {})

    def apply(self, tables: dict[str, DataFrame], windows: DataFrame) -> DataFrame:
        """ctx, size, d for each distinct context of the windows, from the tables of `fit`."""
        ready = M.prepare_counts(tables["counts"], tables["size"], windows, 1 if self.rampup else self.order)
        ready = M.with_rampup(ready, tables["rampup"], self.order) if self.rampup else ready
        return ready.select("ctx", "size", self.rule().alias("d"))


@dataclass(frozen=True)
class Memories:
    """Population and individual memory, gated per user and context: windows need the column `user`."""

    user: str = "user_id"
    trip: str = "trip_id"
    length: int = 5
    order: int = 10
    own_order: int = 3
    floor: float = 1e-8

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.user,)

    def distribution(self, train: DataFrame, windows: DataFrame) -> DataFrame:
        """user, ctx, size, d for each distinct context of each user."""
        return self.apply(self.fit(train), windows)

    @property
    def _top(self) -> int:
        return max(1, min(self.order, self.length - 1))

    def fit(self, train: DataFrame, history: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables; users' own paths are those of `history`, which the population does not see, or of `train`."""
        own = W.histories(train if history is None else history, self.user, self.trip, W.HISTORY)
        own = W.history_ngrams(own, self.user, self.own_order)
        return {"counts": W.overlap_ngrams(train, self.length, self._top), "own": own, "size": M.sizes(train)}

    def apply(self, tables: dict[str, DataFrame], windows: DataFrame) -> DataFrame:
        ind = M.individual(tables["own"], windows, self.user, tables["size"], self.own_order)
        gated = M.gate(M.population_counts(tables["counts"], tables["size"], windows, self._top), ind, self.order)
        return gated.select(self.user, "ctx", "size", F.col("mixed").alias("d"))


@dataclass(frozen=True)
class States:
    """The hidden Markov predictor; nodes are numbers from 0. A context that no count matches falls back as order one does."""

    states: int = 10
    rounds: int = 50
    keys: tuple[str, ...] = ()
    floor: float = 1e-300

    def distribution(self, train: DataFrame, windows: DataFrame) -> DataFrame:
        """ctx, size, d for each distinct context of the windows."""
        return self.apply(self.fit(train), windows)

    def fit(self, train: DataFrame) -> dict[str, DataFrame]:
        size = train.agg(F.max(F.array_max("path"))).first()[0] + 1
        model = H.HiddenMarkov(self.states, self.rounds).fit(train, size)
        return {"counts": W.ngrams(train, 2, 0), "size": M.sizes(train), "states": model.table(train.sparkSession)}

    def apply(self, tables: dict[str, DataFrame], windows: DataFrame) -> DataFrame:
        counts, model = tables["counts"], H.HiddenMarkov.from_table(tables["states"])
        base = M.prepare_counts(counts, tables["size"], windows, 1).select("ctx", "size", M.backoff(1).alias("_d"))
        return base.join(H.predict_counts(counts.where("k > 0"), model, windows), "ctx", "left").select("ctx", "size", F.coalesce("d", "_d").alias("d"))


def predictor(name: str, **options) -> Predictor | Memories | States:
    """mcN (back-off of order N), hwmcN (all orders weighted), akom, cpt, cptplus, mogen; options go to the rule, and
    `order` sets the order where the name holds none. dmmc (population and individual memory) and iohmm (hidden
    states) take the options of `Memories` and `States`."""
    if name.lower() == "dmmc":
        return Memories(**options)
    if name.lower() == "iohmm":
        return States(**options)
    found = re.fullmatch(r"(mc|hwmc|akom|cpt|cptplus|mogen)(\d*)", name.lower())
    if not found:
        raise ValueError(f"no predictor {name}")
    kind, digits = found.groups()
    order = int(digits) if digits else int(options.pop("order", 5 if kind.startswith("cpt") else 10))
    if kind == "mc":
        return Predictor(order, lambda: M.backoff(order))
    if kind == "hwmc":
        return Predictor(order, lambda: M.weighted(order, **options))
    if kind == "akom":
        return Predictor(order, lambda: M.all_k(order, **options))
    if kind == "mogen":
        return Predictor(order, lambda: M.multi_order(order, **options), rampup=True)
    return Predictor(order, lambda: M.noise_filtered(order, **options))


def evaluate(train: DataFrame, windows: DataFrame, names: list[str], dataset: str, split: int) -> DataFrame:
    """Metric records (dataset, split, model, metric, value) of several predictors on one split."""
    from . import score as S

    out = None
    for name in names:
        chosen = predictor(name)
        row = S.metrics(S.scored(windows, chosen.distribution(train, windows), list(chosen.keys), chosen.floor))
        values = [c for c in row.columns if c != "n"]
        part = row.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(name).alias("model"), *values).unpivot(["dataset", "split", "model"], values, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
