"""Regular-expression spans with code-point positions, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: bigint, end: bigint, kind: int, match: string>>"


#: Code points before a match that count as its context.
CONTEXT = 24
#: Code points of the pieces into which a text is cut where stretches of it are replaced.
PIECE = 4096


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int = 0) -> Column:
    """For each place the sum (by `op`) of the values up to it. Doubling distances: n log n steps for n values."""

    def round_(acc: Column, power: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), power)
        shifted = F.concat(F.array_repeat(F.lit(neutral).cast("bigint"), far), F.slice(acc, F.lit(1), F.size(acc) - far))
        return F.zip_with(acc, shifted, op)

    def scan(v: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(rounds, v, round_))

    return bound(values, scan)


def find(text: Column, pattern: str, kind: int, likely: Column | None = None, context: bool = False) -> Column:
    """All leftmost non-overlapping matches of `pattern`, as structs of start, end (exclusive), kind and match; with
    `context` also `before`, what stands before it (up to CONTEXT code points, none of an earlier match).

    Positions are running sums of the lengths of the pieces between matches and of the matches; `likely` is a cheaper
    condition that every text with a match meets. Time grows with the text and, by n log n, with its matches, as long
    as the pattern itself reads each character a bounded number of times.
    """
    empty = F.array().cast(SPAN[:-2] + ", before: string>>" if context else SPAN)
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap"))

    def spans(x: Column) -> Column:
        steps = F.transform(x["match"], lambda m, i: (F.length(F.get(x["gap"], i)) + F.length(m)).cast("bigint"))

        def span(e: Column, i: Column) -> Column:
            match = F.get(x["match"], i)
            before = [F.right(F.get(x["gap"], i), F.lit(CONTEXT)).alias("before")] if context else []
            return F.struct((e - F.length(match)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), match.alias("match"), *before)

        return F.transform(running(steps, lambda a, b: a + b), span)

    has = text.rlike(pattern)
    return F.when(has if likely is None else likely & has, bound(parts, spans)).otherwise(empty)


def others(spans: Column, base: Column, kind: int) -> Column:
    """start, end and kind of the distinct spans (all of this kind), without those that start and end like one of `base`."""

    def code(s: Column) -> Column:
        return F.shiftleft(s["start"], 32) + s["end"]

    kept = F.array_except(F.transform(spans, code), F.transform(base, code))
    return F.transform(kept, lambda c: F.struct(F.shiftright(c, 32).alias("start"), c.bitwiseAND(F.lit((1 << 32) - 1)).alias("end"), F.lit(kind).alias("kind")))


def touching(spans: Column, base: Column) -> Column:
    """span and `hit` for each of the spans: whether it shares a place with one of `base`. In order of their ends.

    Base spans are told at their start and spans ask just before their end for the furthest base end told so far, so
    all are answered by one sort and one running maximum.
    """

    def events(x: Column) -> Column:
        tell = F.transform(x["base"], lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("asks"), b["end"].alias("reach"), x["none"].alias("span")))
        ask = F.transform(x["spans"], lambda s: F.struct((s["end"] - 1).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("reach"), s.alias("span")))
        return F.array_sort(F.concat(tell, ask))

    def answered(e: Column) -> Column:
        reach = running(F.transform(e, lambda v: v["reach"]), lambda a, b: F.greatest(a, b))
        return bound(F.struct(e.alias("events"), reach.alias("reach")), told)

    def told(x: Column) -> Column:
        each = F.transform(x["events"], lambda v, i: F.struct(v["span"].alias("span"), (F.get(x["reach"], i) > v["span"]["start"]).alias("hit"), v["asks"].alias("asks")))
        return F.transform(F.filter(each, lambda v: v["asks"] == 1), lambda v: F.struct(v["span"].alias("span"), v["hit"].alias("hit")))

    none = F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(False).alias("hit")))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), none).otherwise(bound(bound(F.struct(spans.alias("spans"), base.alias("base"), F.get(spans, -1).alias("none")), events), answered))


def written(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each maximal covered stretch replaced by `mark`; stretches that only touch keep a mark each.

    The text is cut into pieces of PIECE code points first, so that each stretch costs its own length and two pieces.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cut(own: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        around = F.array_join(F.slice(own, first + 1, last - first + 1), "")
        return F.substring(around, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

    def whole(x: Column) -> Column:
        size = F.length(text).cast("bigint")
        before = F.transform(x["spans"], lambda s, i: F.struct(F.coalesce(F.get(x["reach"], i - 1), F.lit(0).cast("bigint")).alias("from"), s["start"].alias("to")))
        kept = F.transform(F.filter(before, lambda g: g["from"] <= g["to"]), lambda g: F.concat(cut(x["pieces"], g["from"], g["to"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), cut(x["pieces"], F.element_at(x["reach"], -1), size))

    def reached(o: Column) -> Column:
        reach = running(F.transform(o, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return bound(F.struct(o.alias("spans"), reach.alias("reach"), pieces.alias("pieces")), whole)

    return F.when(F.size(spans) > 0, bound(ordered, reached)).otherwise(text)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z > 0, 1 - upper).otherwise(upper)
