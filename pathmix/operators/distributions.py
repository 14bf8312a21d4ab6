"""Distributions over nodes as sparse bumps and one floor.

A distribution over `size` nodes is a struct: `p`, an array of (node, p) for some nodes, and `floor`, the probability
of every other node. Mixing, entropy, rank and scores have closed forms on it, so no vector of all nodes is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_P = "array<struct<node: int, p: double>>"


def total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x).cast("double"))


def empty(floor: Column) -> Column:
    return F.struct(F.array().cast(NODE_P).alias("p"), floor.cast("double").alias("floor"))


def from_counts(m: Column, scale: Callable[[Column, Column], Column] | None = None, floor: Column | None = None) -> Column:
    """A matched context m (n, nexts) as a distribution; `scale`(cnt, n) gives p, cnt / n by default."""
    scale = scale or (lambda c, n: c / n)
    return F.struct(
        F.transform(m["nexts"], lambda x: F.struct(x["node"].alias("node"), scale(x["cnt"].cast("double"), m["n"].cast("double")).cast("double").alias("p"))).alias("p"),
        (floor if floor is not None else F.lit(0.0)).cast("double").alias("floor"),
    )


def at(d: Column, node: Column) -> Column:
    """p of a node."""
    hit = F.filter(d["p"], lambda x: x["node"] == node)
    return F.coalesce(F.get(hit, F.lit(0))["p"], d["floor"])


def mix(parts: Column) -> Column:
    """Weighted sum of parts, an array of (w, d); weights are taken as they are."""
    nodes = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda m: F.transform(m["d"]["p"], lambda x: x["node"])))))
    return F.struct(
        F.transform(nodes, lambda v: F.struct(v.alias("node"), total(parts, lambda m: m["w"] * at(m["d"], v)).alias("p"))).alias("p"),
        total(parts, lambda m: m["w"] * m["d"]["floor"]).alias("floor"),
    )


def mix2(w: Column | float, one: Column, other: Column) -> Column:
    """w of one and 1 - w of the other."""
    w = F.lit(w) if isinstance(w, float) else w
    return mix(F.array(F.struct(w.alias("w"), one.alias("d")), F.struct((1 - w).alias("w"), other.alias("d"))))


def mass(d: Column, size: Column) -> Column:
    return total(d["p"], lambda x: x["p"]) + (size - F.size(d["p"])) * d["floor"]


def scaled(d: Column, by: Column) -> Column:
    return F.struct(F.transform(d["p"], lambda x: F.struct(x["node"].alias("node"), (x["p"] / by).alias("p"))).alias("p"), (d["floor"] / by).alias("floor"))


def entropy_bits(d: Column) -> Column:
    """Over the bumps with a probability above zero."""
    return total(d["p"], lambda x: F.when(x["p"] > 0, -x["p"] * F.log2(x["p"])).otherwise(F.lit(0.0)))


def entropy_nats(d: Column, size: Column, clamp: float = 1e-8) -> Column:
    """Over all nodes, each probability clamped from below."""

    def part(p: Column) -> Column:
        q = F.greatest(p, F.lit(clamp))
        return -q * F.ln(q)

    return total(d["p"], lambda x: part(x["p"])) + (size - F.size(d["p"])) * part(d["floor"])


def top(d: Column) -> Column:
    """The most probable node, the smallest of equals; 0 without bumps, where all nodes are equal."""
    best = F.aggregate(
        d["p"],
        F.struct(F.lit(None).cast("int").alias("node"), F.lit(-1.0).alias("p")),
        lambda acc, x: F.when((x["p"] > acc["p"]) | ((x["p"] == acc["p"]) & (x["node"] < acc["node"])), F.struct(x["node"].alias("node"), x["p"].alias("p"))).otherwise(acc),
    )
    return F.when(F.size(d["p"]) == 0, F.lit(0)).otherwise(best["node"])


def rank(d: Column, node: Column, size: Column | None = None) -> Column:
    """1 + number of nodes with a higher probability; with `size` a node that has no bump ranks last (strict)."""
    p = at(d, node)
    optimistic = 1 + F.size(F.filter(d["p"], lambda x: x["p"] > p))
    if size is None:
        return optimistic
    return F.when(F.exists(d["p"], lambda x: x["node"] == node), optimistic).otherwise(size)


def brier(d: Column, node: Column, size: Column) -> Column:
    squares = total(d["p"], lambda x: x["p"] * x["p"]) + (size - F.size(d["p"])) * d["floor"] * d["floor"]
    return squares - 2 * at(d, node) + 1


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exp over an array, shifted by its maximum; null if it is empty."""
    high = F.array_max(values)
    return high + F.ln(total(values, lambda x: F.exp(x - high)))
