"""Splits and samples by an arithmetic key, the same on every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import histories, ranked

#: Fixed values of the key: multiplier, seed step, modulus.
FACTOR, SEED_STEP, MODULUS = 2_654_435_761, 40_503, 1_000_003


def key(column: str | Column, seed: int = 42) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.pmod(c.cast("bigint"), F.lit(MODULUS)) * FACTOR + seed * SEED_STEP, F.lit(MODULUS))


def _ordered(rows: DataFrame, by: str, seed: int) -> DataFrame:
    """Adds _i, the place of each distinct `by` in the order of its key, and _n, their number."""
    ids = rows.select(by).distinct().withColumn("_o", F.struct(key(by, seed).alias("k"), F.col(by).alias("id")))
    ids = ranked(ids, "_o", "_i").select(by, "_i")
    n = ids.agg(F.count("*").alias("_n"))
    return rows.join(ids, by).join(F.broadcast(n))


def by_trip(rows: DataFrame, by: str = "trip_id", test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: test, then val, the rest train; each of the first two holds at least one."""
    sized = _ordered(rows, by, seed)
    n_test, n_val = F.greatest(F.floor(F.col("_n") * test), F.lit(1)), F.greatest(F.floor(F.col("_n") * val), F.lit(1))
    split = F.when(F.col("_i") < n_test, "test").when(F.col("_i") < n_test + n_val, "val").otherwise("train")
    return sized.withColumn("split", split).drop("_i", "_n")


def by_user(rows: DataFrame, user: str = "user_id", trip: str = "trip_id", least: int = 3, users: int = 100, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: of `users` users with at least `least` trips a share of the trips is test and the rest history (held
    out of training); the other users' trips are val or train."""
    trips = rows.select(user, trip).distinct()
    own = Window.partitionBy(user)
    trips = trips.withColumn("_t", F.count("*").over(own)).withColumn("_r", F.row_number().over(own.orderBy(key(trip, seed), trip)))
    able = _ordered(trips.where(F.col("_t") >= least).select(user).distinct(), user, seed).where(F.col("_i") < users).select(user, F.lit(True).alias("_e"))
    marked = trips.join(able, user, "left")
    rest = by_trip(marked.where("_e is null").select(trip), trip, val, 0.0, seed + 1).select(trip, F.when(F.col("split") == "test", "val").otherwise("train").alias("split"))
    chosen = marked.where("_e").select(trip, F.when(F.col("_r") <= F.greatest(F.floor(F.col("_t") * test), F.lit(1)), "test").otherwise("history").alias("split"))
    return rows.join(chosen.union(rest), trip)


def subsample(rows: DataFrame, by: str, share: float, seed: int = 42) -> DataFrame:
    """The first floor(share * n) (at least one) in the order of the key."""
    sized = _ordered(rows, by, seed)
    return sized.where(F.col("_i") < F.greatest(F.floor(F.col("_n") * share), F.lit(1))).drop("_i", "_n")


def first_by_key(rows: DataFrame, by: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` of them, in the order of the key."""
    return _ordered(rows, by, seed).where(F.col("_i") < most).drop("_i", "_n")


def folds(rows: DataFrame, by: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: by trip, so that windows of one trip never meet across folds."""
    return rows.withColumn("fold", F.pmod(key(by, seed), F.lit(k)).cast("int"))


def every(rows: DataFrame, by: str, step: int = 50) -> DataFrame:
    """Every `step`-th in sorted order."""
    ids = ranked(rows.select(by).distinct(), by, "_i")
    return rows.join(ids.where(F.col("_i") % step == 0).select(by), by, "left_semi")


def shuffled_histories(rows: DataFrame, user: str, trip: str, longest: int | None = None, seed: int = 42) -> DataFrame:
    """user and the concatenation of the user's paths in the order of the key, its last `longest` nodes."""
    return histories(rows.withColumn("_o", F.struct(key(trip, seed).alias("k"), F.col(trip).alias("id"))), user, "_o", longest)


def by_window(windows: DataFrame, trip: str = "trip_id", pos: str = "pos", test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split (test, train) to single windows; windows of one trip meet across the two, so scores are too good."""
    own = key(F.pmod(F.col(trip).cast("bigint"), F.lit(MODULUS)) * 1009 + F.col(pos), seed)
    return windows.withColumn("split", F.when(own < int(MODULUS * test), "test").otherwise("train"))


def pick(rows: DataFrame, by: str, seed: int = 42) -> DataFrame:
    """One row: the first in the order of the key."""
    return rows.orderBy(key(by, seed), by).limit(1)
