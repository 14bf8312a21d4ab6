"""Secret scans: fixed patterns, and a battery of randomness tests with control of the false-discovery rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans as S
from .common import numbered, settle

NAMES = ["assign", "access", "hex", "random"]
#: Fixed patterns. The quantifiers of access and hex carry the least length: a shorter run has no match inside.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_ASSIGN = 8
#: What the battery tests: runs of this many characters of the encodings' alphabets.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets, smallest first; a run's encoding is the first that holds all its characters. `gain`: how much less
#: uniform ordinary words written in that alphabet are (size * sum of squared letter shares - 1).
ENCODINGS = (
    ("hex", "0123456789abcdef", 0.9),
    ("HEX", "0123456789ABCDEF", 0.9),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789", 1.3),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 2.8),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.9),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 2.9),
)
#: Beyond this many standard errors a run's order isn't random.
VETO = 3.3


def _battery(run: Column) -> Column:
    """Encoding, length class and p of one run: how likely ordinary writing is to look as random as it does.

    chi-squared: the statistic for a uniform alphabet is compared with its distribution for ordinary writing, whose
    centre grows with the length, so that short runs need more. Runs above and below the middle of the alphabet and
    the lag-one serial correlation veto (p = 1) what isn't random in its order.
    """
    body = F.regexp_replace(run, "=+$", "")
    code = F.coalesce(*[F.when(body.rlike(f"^[{a.replace('-', chr(92) + '-')}]+$"), F.lit(k)) for k, (_, a, _) in enumerate(ENCODINGS)], F.lit(-1))
    told = F.struct(body.alias("body"), code.alias("code"))

    def facts(t: Column) -> Column:
        letters = F.element_at(F.array(*[F.lit(a) for _, a, _ in ENCODINGS]), t["code"] + 1)
        gain = F.element_at(F.array(*[F.lit(g) for _, _, g in ENCODINGS]), t["code"] + 1)
        return F.struct(t["code"].alias("code"), letters.alias("letters"), F.length(letters).cast("double").alias("k"), gain.alias("gain"), F.split(t["body"], "").alias("chars"), t["body"].alias("body"))

    def places(f: Column) -> Column:
        size = F.size(f["chars"]).cast("double")
        squares = F.aggregate(F.array_distinct(f["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(f["body"]) - F.length(F.replace(f["body"], c, F.lit(""))), F.lit(2.0)))
        x = F.transform(f["chars"], lambda c: F.instr(f["letters"], c).cast("double") - 1)
        return F.struct(f["code"].alias("code"), f["k"].alias("k"), f["gain"].alias("gain"), size.alias("n"), squares.alias("squares"), x.alias("x"))

    judged = S.bound(told, lambda t: F.when(t["code"] >= 0, S.bound(facts(t), lambda f: S.bound(places(f), lambda v: S.bound(_sums(v), _judged)))))
    return judged


def _sums(f: Column) -> Column:
    """What the tests need of a run, each sum taken in one pass: of x, of x squared, of x times the next x; how many lie
    in the upper half of the alphabet, and how often neighbours lie in different halves."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    x, k = f["x"], f["k"]
    tail, head = F.slice(x, F.lit(2), F.size(x)), F.slice(x, F.lit(1), F.size(x) - 1)
    return F.struct(
        f["code"].alias("code"), f["n"].alias("n"), k.alias("k"), f["gain"].alias("gain"), f["squares"].alias("squares"),
        total(x).alias("sum"), F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b).alias("sum2"), total(F.zip_with(head, tail, lambda a, b: a * b)).alias("lagged"),
        F.get(x, F.lit(0)).alias("first"), F.element_at(x, -1).alias("last"),
        total(F.transform(x, lambda v: (v >= k / 2).cast("double"))).alias("up"),
        total(F.zip_with(head, tail, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double"))).alias("turns"),
    )


def _judged(f: Column) -> Column:
    n, k, up = f["n"], f["k"], f["up"]
    chi = k / n * f["squares"] - n
    shift = n * f["gain"]
    p_plain = S.normal_cdf((chi - (k - 1) - shift) / F.sqrt(2 * (k - 1) + 4 * shift))
    both = up * (n - up)
    runs = f["turns"] + 1
    mean_runs = 2 * both / n + 1
    spread = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
    mean = f["sum"] / n
    var = f["sum2"] - n * mean * mean
    lag = f["lagged"] - mean * (2 * f["sum"] - f["first"] - f["last"]) + (n - 1) * mean * mean
    serial = F.when(var > 1e-6, (lag / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    veto = (F.abs((runs - mean_runs) / spread) > VETO) | (F.abs(serial) > VETO) | (both == 0)
    p = F.when(veto, F.lit(1.0)).otherwise(F.greatest(p_plain, F.lit(1e-30)))
    return F.struct(
        (f["code"] * 16 + F.least(F.floor(F.log2(n / 20) * 2), F.lit(15))).cast("int").alias("class"),
        F.least(F.floor(-F.log10(p) * 50), F.lit(1400)).cast("int").alias("grade"),
    )


def _found(body: Column) -> Column:
    """base: spans of the fixed patterns; runs: start, end, class and grade of what the battery tests."""

    def tested(raw: Column) -> Column:
        assign = F.filter(S.find(body, ASSIGN, 0, F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= LEAST_ASSIGN)
        some = F.size(raw) > 0  # what HEX matches lies within such a run
        base = F.concat(assign, S.find(body, ACCESS, 1, F.contains(body, F.lit("AKIA"))), S.find(body, HEX, 2, some))
        runs = F.transform(raw, lambda s: F.struct(s["start"], s["end"], _battery(s["match"]).alias("test")))
        good = F.transform(F.filter(runs, lambda r: r["test"].isNotNull()), lambda r: F.struct(r["start"], r["end"], r["test"]["class"].alias("class"), r["test"]["grade"].alias("grade")))
        return F.struct(F.transform(base, lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("base"), good.alias("runs"))

    return S.bound(S.find(body, RUN, 3), tested)


def _floors(runs: DataFrame, rate: float) -> dict[int, int]:
    """Least grade of each class (encoding and length) at which the Benjamini-Hochberg bound holds over rows (class, grade).

    Grades are p-values on a fine logarithmic grid, so the counts per class and grade have a fixed size.
    """
    grades = runs.groupBy("class", "grade").agg(F.count("*").alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = grades.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("class")))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("grade") / 50) <= rate * F.col("rank") / F.col("m"))
    return {r["class"]: r["floor"] for r in passed.groupBy("class").agg(F.min("grade").alias("floor")).collect()}


def _passed(found: Column, floors: dict[int, int]) -> Column:
    """The runs that pass the battery."""
    if not floors:
        return F.filter(found["runs"], lambda s: F.lit(False))
    floor = F.create_map(*[F.lit(x) for pair in sorted(floors.items()) for x in pair])
    return F.filter(found["runs"], lambda s: s["grade"] >= floor[s["class"]])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.01) -> DataFrame:
    """Secrets of each whole text: key, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans of the fixed patterns always stay. A run of encoding letters is added as `random` when the battery's p
    passes the false-discovery bound `rate` within its class of encoding and length; counts per class cover all
    documents. It may lie inside a fixed span (the value of an assignment) but isn't repeated where it is one;
    `n_random` counts all runs that pass, those of fixed spans too. Null and empty texts have none; equal spans of different kinds are both kept; repeated rows give repeated results; an
    empty table gives none; other columns are left out. Time grows in proportion to a text's length and, by n log n,
    to its matches. Expressions of the JVM only; what is found (not the texts) is written once to the shared folder,
    since the bound needs it all before any span is chosen.
    """
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = settle(own.select("k", _found(F.col("t")).alias("f")))
    floors = _floors(found.select(F.explode("f.runs").alias("r")).select("r.class", "r.grade"), rate)
    judged = found.select("k", "f.base", _passed(F.col("f"), floors).alias("passed"))
    return judged.select(
        F.col("k").alias(key), *[S.count(F.col("base"), n).alias(f"n_{NAMES[n]}") for n in range(3)],
        F.sha2(S.written(F.col("base"), NAMES), 256).alias("base_sha256"), S.written(F.concat("base", S.others(F.col("passed"), F.col("base"), 3)), NAMES).alias("spans"),
        F.size("passed").cast("bigint").alias("n_random"),
    )


def redact(df: DataFrame, text: str = "text", rate: float = 0.01, mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `df`, with every span of `scan` in the text replaced by `mark` and `length` set anew.

    The bound's counts are taken in a pass of their own, so no text is written or shuffled. Null texts stay null and
    texts without spans stay as they are, with their `length`; overlapping spans get one mark; repeated rows are
    treated alike; an empty table stays empty; columns may bear any names, as they are addressed by place.
    """
    names = df.columns
    rows = numbered(df)
    at = f"c{names.index(text)}"
    found = _found(F.coalesce(F.col(at), F.lit("")))
    floors = _floors(rows.select(F.explode(found["runs"]).alias("r")).select("r.class", "r.grade"), rate)
    rows = rows.withColumn("found", found)
    rows = rows.withColumn("all", F.concat("found.base", S.others(_passed(F.col("found"), floors), F.col("found.base"), 3)))
    hit = F.size("all") > 0
    rows = rows.withColumn(at, F.when(hit, S.redacted(F.col(at), F.col("all"), mark)).otherwise(F.col(at)))
    if length and length in names:
        n = f"c{names.index(length)}"
        rows = rows.withColumn(n, F.when(hit, F.length(at).cast(df.schema.fields[names.index(length)].dataType)).otherwise(F.col(n)))
    return rows.drop("found", "all").toDF(*names)
