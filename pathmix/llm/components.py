"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Far beyond the steps that any graph needs (their number grows with the logarithm of the size).
MOST_STEPS = 60
#: Up to so many distinct links (16 bytes each) are solved by one task; more take the alternating steps.
ONE_TASK = 500_000


def components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """id and component (smallest id reachable) of every id in a link; settled in the shared folder.

    Links are undirected, may be repeated and may join an id with itself; nulls are left out. Only minima per id are
    gathered, so an id with very many links is summed before it is shuffled, and joins on it can be split.
    """
    pairs = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    edges = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if one_task and edges.limit(one_task + 1).count() <= one_task:
        return settle(edges.repartition(1).mapInArrow(_solve, "id bigint, component bigint"))
    now = settle(edges)
    mark = _mark(now)
    for _ in range(MOST_STEPS):
        large = _large_star(now)
        small = _small_star(large)
        after = settle(small)
        drop_settled(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    out = settle(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct())
    drop_settled(now)
    return out


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of 0..n-1 over links a-b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(np.asarray(batch.column(0)))
        v.append(np.asarray(batch.column(1)))
    ids, place = np.unique(np.concatenate([*u, *v]), return_inverse=True)
    half = len(place) // 2
    low = merged(len(ids), place[:half], place[half:])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], names=["id", "component"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each id tells its larger neighbours the smallest id it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = both.join(least, "u").where("v > u or v = u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each id ties its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
