"""Personal data: fixed patterns, and further candidates judged by boosted trees over format and context."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import settle

NAMES = ["email", "ip", "card", "phone", "mail_like", "number_like", "ident_like"]
#: Fixed patterns. A match begins where a run of its first class begins, or where the match before it ended. Groups
#: that repeat are possessive: they give nothing back, which changes no match and keeps the stack flat on long texts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates, meant for recall; their spans may overlap each other's and the fixed ones.
AT, DOT = r"(?:@|\x20?[\[(]at[\])]\x20?)", r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
MAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}" + AT + r"[A-Za-z0-9-]{2,63}(?:" + DOT + r"[A-Za-z0-9-]{2,24}){0,4}"
NUMBER_LIKE = r"(?<![0-9+])(?:[0-9]{9,19}|\(?[0-9]{1,4}\)?(?:[\x20./-]\(?[0-9]{1,5}\)?){2,5})(?![0-9])"
IDENT_LIKE = r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])"
#: Numbers that are dates: negative examples.
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2})$"
#: Words of the context, by family: fixed values.
CUES = r"(?i)(mail|contact|write to|phone|call|tel|fax|mobile|card|visa|pay|iban|account|address|\bip\b|host|server|ssn|passport)"
#: Boosting: rounds, shrinkage, penalty; precision that a threshold must show on the half that the trees did not see.
ROUNDS, RATE, PENALTY, PRECISION = 24, 0.3, 1.0, 0.95
FEATURES = ["f_kind", "f_dots", "f_digits", "f_marks", "f_letters", "f_groups", "f_tail", "f_cue", "f_edge"]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a string of digits is at most 255, however long it is."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= F.lit("255")))


def _valid(s: Column) -> Column:
    """Whether a match of a fixed pattern passes that pattern's own check."""

    def by(x: Column) -> Column:
        digits = x["digits"]
        return (
            F.when(x["kind"] == 0, F.lit(True))
            .when(x["kind"] == 1, F.forall(F.split(x["match"], r"\."), _small))
            .when(x["kind"] == 2, F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
            .otherwise(F.length(digits).between(9, 15))
        )

    return S.bound(F.struct(s["kind"].alias("kind"), s["match"].alias("match"), _digits(s["match"]).alias("digits")), by)


def iban(match: Column) -> Column:
    """Whether country, check digits and account number leave 1 by 97."""
    moved = F.concat(F.substring(match, 5, 40), F.substring(match, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda acc, v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _features(x: Column) -> list[Column]:
    """Small integers of a candidate's format (as if written plainly: @ and dots) and context; their product bounds the
    table that the trees are fitted on. x: kind, plain, before."""
    m = x["plain"]
    digits = F.length(_digits(m))
    marks = F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    return [
        x["kind"].alias("f_kind"),
        F.least(F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))), F.lit(3)).cast("int").alias("f_dots"),
        F.least(F.floor(digits / 2), F.lit(9)).cast("int").alias("f_digits"),
        F.least(marks, F.lit(5)).cast("int").alias("f_marks"),
        F.least(F.ceil(letters / 6), F.lit(4)).cast("int").alias("f_letters"),
        F.least(F.size(F.split(m, "[^0-9]+")), F.lit(6)).cast("int").alias("f_groups"),
        F.least(F.length(F.regexp_extract(m, "([A-Za-z]*)$", 1)), F.lit(4)).cast("int").alias("f_tail"),
        x["before"].rlike(CUES).cast("int").alias("f_cue"),
        F.when(x["before"] == "", 2).otherwise(x["before"].rlike(r"[\s:(\[,;]$").cast("int")).cast("int").alias("f_edge"),
    ]


def fit(rows: list[tuple[tuple[int, ...], int, int]]) -> list[tuple]:
    """Newton boosting with trees of depth two over counted rows (features, label, count).

    Returns trees (feature, bound, left, right); left and right are (feature, bound, leaf, leaf).
    """
    if not rows:
        return []
    x = np.array([r[0] for r in rows], np.int64)
    y, n = np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64)
    bounds = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
    margin_ = np.zeros(len(rows))
    trees: list[tuple] = []

    def split(part: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, found = 1e-9, (0, -1)
        whole_g, whole_h = g[part].sum(), h[part].sum()
        for f, own in enumerate(bounds):
            for b in own:
                low = part & (x[:, f] <= b)
                lg, lh = g[low].sum(), h[low].sum()
                gain = lg**2 / (lh + PENALTY) + (whole_g - lg) ** 2 / (whole_h - lh + PENALTY) - whole_g**2 / (whole_h + PENALTY)
                if gain > best * (1 + 1e-9):
                    best, found = gain, (f, int(b))
        return found

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin_))
        g, h = n * (y - p), n * p * (1 - p)
        f, b = split(np.ones(len(rows), bool), g, h)
        sides = []
        for part in (x[:, f] <= b, x[:, f] > b):
            f2, b2 = split(part, g, h)
            leaves = []
            for own in (part & (x[:, f2] <= b2), part & (x[:, f2] > b2)):
                leaves.append(round(float(RATE * g[own].sum() / (h[own].sum() + PENALTY)), 9))
                margin_[own] += leaves[-1]
            sides.append((f2, b2, *leaves))
        trees.append((f, b, *sides))
    return trees


def margin(trees: list[tuple], x: list) -> float | Column:
    """Sum of the trees at features x: numbers, or columns for an expression."""
    total = F.lit(0.0) if x and isinstance(x[0], Column) else 0.0

    def choose(test, a, b):
        return F.when(test, a).otherwise(b) if isinstance(test, Column) else a if test else b

    for f, b, low, high in trees:
        arms = [choose(x[s[0]] <= s[1], s[2], s[3]) for s in (low, high)]
        total = total + choose(x[f] <= b, *arms)
    return total


def _threshold(trees: list[tuple], rows: list[tuple[tuple[int, ...], int, int]]) -> float:
    """Least margin from which upwards the rows are right with PRECISION; beyond all of them if there is none."""
    scored = sorted(((margin(trees, list(x)), y, n) for x, y, n in rows), reverse=True)
    right = seen = 0
    best = math.inf
    for k, (m, y, n) in enumerate(scored):
        right, seen = right + y * n, seen + n
        if right >= PRECISION * seen and (k + 1 == len(scored) or scored[k + 1][0] < m):
            best = m
    return best


def _found(body: Column) -> Column:
    """base: spans of the fixed patterns that pass their check; wide: spans of the generators with label and features.

    Weak labels: a candidate that shares a place with a fixed span is personal (1); one that shares a place with a
    match which failed its check, an @ without an address, a date, or an account number whose check digits are wrong
    isn't (0); the rest (null) is for the trees to tell.
    """
    flags = F.struct(F.contains(body, F.lit("@")).alias("at"), F.contains(body, F.lit("+")).alias("plus"), body.rlike("[0-9]").alias("digit"), body.rlike(r"[\[(]at[\])]").alias("hidden"))

    def fixed(f: Column) -> Column:
        matches = F.concat(S.find(body, EMAIL, 0, f["at"]), S.find(body, IP, 1, f["digit"]), S.find(body, CARD, 2, f["digit"]), S.find(body, PHONE, 3, f["plus"]))
        told = F.transform(matches, lambda s: F.struct(s["start"], s["end"], s["kind"], _valid(s).alias("valid")))
        wide = F.concat(S.find(body, MAIL_LIKE, 4, f["at"] | f["hidden"], True), S.find(body, NUMBER_LIKE, 5, f["digit"], True), S.find(body, IDENT_LIKE, 6, f["digit"], True))
        return S.bound(F.struct(told.alias("told"), F.transform(wide, _described).alias("wide")), parted)

    def parted(x: Column) -> Column:
        def spans(valid: bool) -> Column:
            return F.transform(F.filter(x["told"], lambda s: s["valid"] == F.lit(valid)), lambda s: F.struct(s["start"], s["end"], s["kind"]))

        return S.bound(F.struct(spans(True).alias("base"), spans(False).alias("failed"), x["wide"].alias("wide")), labelled)

    def labelled(x: Column) -> Column:
        good = F.transform(S.touching(x["wide"], x["base"]), lambda t: F.struct(t["span"]["start"].alias("start"), t["span"]["end"].alias("end"), F.when(t["hit"], 1).alias("label"), t["span"].alias("own")))
        told = F.transform(
            S.touching(good, x["failed"]),
            lambda t: F.struct(
                t["span"]["start"].alias("start"), t["span"]["end"].alias("end"), F.coalesce(t["span"]["label"], F.when(t["hit"], 0), t["span"]["own"]["guess"]).alias("label"),
                *[t["span"]["own"][f].alias(f) for f in FEATURES],
            ),
        )
        return F.struct(x["base"].alias("base"), told.alias("wide"))

    return S.bound(flags, fixed)


def _described(s: Column) -> Column:
    """start, end, what the match alone says of its label, features."""
    plain = F.regexp_replace(F.regexp_replace(s["match"], AT, "@"), DOT, ".")

    def facts(x: Column) -> Column:
        m = x["plain"]
        guess = (
            F.when((x["kind"] == 4) & F.contains(s["match"], F.lit("@")), 0)
            .when((x["kind"] == 5) & m.rlike(DATE), 0)
            .when((x["kind"] == 6) & m.rlike("^[A-Z]"), iban(m).cast("int"))
        )
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), guess.alias("guess"), *_features(x))

    return S.bound(F.struct(s["kind"].alias("kind"), plain.alias("plain"), s["before"].alias("before")), facts)


def _model(found: DataFrame) -> tuple[list[tuple], float]:
    """Trees and threshold from the labelled candidates of all documents, counted by features. The trees are fitted on
    one half of the documents and the threshold on the other; equal texts are in one half. Without labels of both kinds
    there are no trees."""
    counted = (
        found.select("half", F.explode("f.wide").alias("c")).where("c.label is not null")
        .select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.label").alias("y"), "half").groupBy(*FEATURES, "y", "half").agg(F.count("*").alias("n")).collect()
    )
    halves: list[list] = [[], []]
    for r in sorted(counted):
        halves[r["half"]].append((tuple(r[f] for f in FEATURES), r["y"], r["n"]))
    if any(len({y for _, y, _ in half}) < 2 for half in halves):
        return [], math.inf
    trees = fit(halves[0])
    return trees, _threshold(trees, halves[1])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of each whole text: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    Matches of the fixed patterns that pass their check always stay. Spans of wider generators are added as mail_like,
    number_like or ident_like where the trees' margin reaches the threshold; they may overlap each other and fixed
    spans, but none is added that starts and ends like a fixed one. The trees are fitted on weak labels (see `_found`)
    of all documents; a table with too few of them gets no added spans. Null and empty texts have none; repeated
    rows give repeated results; an empty table gives an empty result; other columns are left out. Time grows in
    proportion to a text's length and, by n log n, to its matches. Expressions of the JVM only; candidates (not texts)
    are written once to the shared folder, as the trees need the counts of all of them first. The counts have a bounded
    number of rows.
    """
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = settle(own.select("k", F.pmod(F.xxhash64("t"), F.lit(2)).alias("half"), _found(F.col("t")).alias("f")))
    trees, least = _model(found)
    found = found.select("k", "f.base", "f.wide")
    if trees and least < math.inf:
        chosen = F.filter("wide", lambda s: margin(trees, [s[f] for f in FEATURES]) >= least)
        found = found.withColumn("chosen", chosen)

        def own(kind: int) -> Column:
            return S.others(F.filter("chosen", lambda s: s["f_kind"] == kind), F.col("base"), kind)

        more = F.concat(*map(own, (4, 5, 6)))
    else:
        more = F.filter("base", lambda s: F.lit(False))
    found = found.withColumn("more", more)
    return found.select(
        F.col("k").alias(key), *[S.count(F.col("base"), k).alias(f"n_{NAMES[k]}") for k in range(4)],
        F.sha2(S.written(F.col("base"), NAMES), 256).alias("base_sha256"), S.written(F.concat("base", "more"), NAMES).alias("spans"), F.size("more").cast("bigint").alias("n_added"),
        (F.size("base") + F.size("more")).cast("bigint").alias("n_spans"),
    )
