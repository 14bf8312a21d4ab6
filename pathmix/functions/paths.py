"""Expressions on node paths (arrays of node ids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_text(column: Column) -> Column:
    """Comma-joined ids to an array; blanks are dropped, null is an empty path, what isn't a number becomes null."""
    parts = F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).try_cast("int"))


def parse_literal(column: Column) -> Column:
    """A list literal such as [1, 2, 3] to an array; null or malformed text is an empty path."""
    return F.coalesce(F.from_json(column, "array<int>"), F.array().cast("array<int>"))


def text(path: Column, separator: str = "-") -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), separator)


def positive(path: Column) -> Column:
    """Drops the zeros that pad fixed-width trajectories."""
    return F.filter(path, lambda x: x > 0)


def collapse_runs(path: Column) -> Column:
    """Keeps the first of each run of equal neighbours."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))


def erase_loops(path: Column, kind: str = "int") -> Column:
    """On a revisit drops everything since the first visit."""
    return F.aggregate(
        path,
        F.array().cast(f"array<{kind}>"),
        lambda acc, x: F.when(F.array_contains(acc, x), F.slice(acc, F.lit(1), F.array_position(acc, x).cast("int"))).otherwise(F.concat(acc, F.array(x))),
    )


def tail(path: Column, n: int) -> Column:
    """The last n elements, or all."""
    return F.slice(path, F.greatest(F.size(path) - n + 1, F.lit(1)), F.lit(n))


def suffixes(path: Column, longest: int, shortest: int = 1) -> Column:
    """Struct (k, sfx) for each suffix length that fits, shortest first."""
    top = F.least(F.size(path), F.lit(longest))
    lengths = F.when(top >= shortest, F.sequence(F.lit(shortest), top)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda k: F.struct(k.alias("k"), F.slice(path, F.size(path) - k + 1, k).alias("sfx")))


def kgrams(path: Column, k: int) -> Column:
    """All runs of k neighbours, in order."""
    n = F.size(path) - k + 1
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(path, i, F.lit(k)))


def join_kgrams(grams: Column) -> Column:
    """The path whose k-grams these are: the first whole, then the last node of each further one."""
    rest = F.transform(F.slice(grams, 2, F.greatest(F.size(grams) - 1, F.lit(0))), lambda g: F.element_at(g, -1))
    return F.when(F.size(grams) > 0, F.concat(F.element_at(grams, 1), rest)).otherwise(F.array().cast("array<int>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of the node sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def letters(path: Column) -> Column:
    """One character per node (ids below 60,000), so that string functions work on paths."""
    return F.array_join(F.transform(path, lambda x: F.decode(F.unhex(F.lpad(F.hex(x + 0x1000), 4, "0")), "UTF-16BE")), "")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two paths with unit costs."""
    return F.levenshtein(letters(a), letters(b))


def stitch(routes: Column) -> Column:
    """Concatenates route segments, each but the first without its first node."""
    return F.flatten(F.transform(routes, lambda r, i: F.when(i == 0, r).otherwise(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))))


def decay(path: Column, rate: float = 0.5) -> Column:
    """Normalised recency weights exp(-rate * age), newest last."""
    raw = F.transform(path, lambda x, i: F.exp(-rate * (F.size(path) - 1 - i)))
    return F.transform(raw, lambda w: w / F.aggregate(raw, F.lit(0.0), lambda s, v: s + v))
