"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: Rows that one task ranks, about: an arc with more is dealt to several parts, so one repeated key never fills a task.
PART_ROWS = 250_000


def _ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order; a point is a hash of shard and replica alone, so another shard moves no point."""
    mask = (1 << 64) - 1
    points = []
    for s in range(shards):
        for v in range(vnodes):
            x = (s * 0x9E3779B97F4A7C15 + v * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            points.append(((x ^ (x >> 31)) >> 1, s))
    return sorted(points)


def place(arc_rows: dict[int, int], owners: list[int], shards: int, capacity: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each arc, runs (first rank, end rank, shard, first slot) that hold its rows.

    Round r: each arc offers what it still holds to the owner r arcs clockwise; a shard takes offers in ring order
    until it is full. Only counts are needed, so the plan's size is that of the ring, whatever the number of rows.
    """
    arcs, held, taken = len(owners), dict(arc_rows), [0] * shards
    used = dict.fromkeys(arc_rows, 0)
    runs: dict[int, list[tuple[int, int, int, int]]] = {a: [] for a in arc_rows}
    for step in range(arcs):
        waiting = [a for a in sorted(held) if held[a]]
        if not waiting:
            break
        for a in waiting:
            s = owners[(a + step) % arcs]
            n = min(held[a], capacity[s] - taken[s])
            if n > 0:
                runs[a].append((used[a], used[a] + n, s, taken[s]))
                used[a] += n
                taken[s] += n
                held[a] -= n
    return runs


def shard(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, vnodes: int = 64, load_factor: float = 1.0
) -> DataFrame:
    """Deal all rows of `df` into `shards` shards; returns key, size, text_crc32, law, shard, slot, grown_shard.

    A key's hash falls into an arc of the ring; the arc's virtual node names the shard. A shard holds at most its
    capacity: with load_factor 1 the capacities differ by at most one row and add up to the row count, so shard
    sizes differ by at most one (law `rows`); a larger factor gives ceil(factor * rows / shards) and moves fewer
    keys. Keys that find their shard full go on clockwise. Slots run from 0 in each shard without gaps.

    Keys, sizes and checksums (not the texts) are written once to the shared folder with a number per row, and both
    the counts and the ranks read them there: whatever the input is and whichever task runs again, they agree. Rows
    per (arc, part) are counted on the executors; the driver turns those counts (ring size plus one per PART_ROWS
    rows) into runs of ranks, and each row finds its run by its rank. A row without a run is an error, not a loss. A
    null key hashes like any other value; null text has size 8 and the checksum of the empty text; equal rows are told
    apart by their number and are interchangeable; an empty table gives an empty result. Other columns are ignored.
    """
    points = _ring(shards, vnodes)
    at, owners = [p for p, _ in points], [s for _, s in points]
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(17)), 1).alias("_h"),
    )
    # the arc is found by one comparison among evenly spaced starting points, then at most a few further ones
    grid = 1 << 12
    table = [[p for p in at if p >> 51 == g] for g in range(grid)]
    before = [bisect.bisect_left(at, g << 51) for g in range(grid)]
    cell = F.shiftrightunsigned(F.col("_h"), 51).cast("int")
    starts = F.from_json(F.lit(str(before)), "array<int>")
    lists = F.from_json(F.lit(str(table)), "array<array<bigint>>")
    arc = F.get(starts, cell) + F.size(F.filter(F.get(lists, cell), lambda p: p < F.col("_h")))
    rows = settle(rows.select("*", (arc % len(at)).cast("int").alias("_arc"), F.monotonically_increasing_id().alias("_number")))
    spark = df.sparkSession
    whole = {r["_arc"]: r["n"] for r in rows.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    dealt = {a: -(-n // PART_ROWS) for a, n in whole.items() if n > PART_ROWS}
    if dealt:
        many = F.broadcast(spark.createDataFrame(sorted(dealt.items()), "_arc int, _parts int"))
        part = F.pmod(F.xxhash64("_number"), F.coalesce("_parts", F.lit(1))).cast("int")
        rows = rows.join(many, "_arc", "left").withColumn("_part", part).drop("_parts")
        counts = {(r["_arc"], r["_part"]): r["n"] for r in rows.groupBy("_arc", "_part").agg(F.count("*").alias("n")).collect()}
    else:
        rows = rows.withColumn("_part", F.lit(0))
        counts = {(a, 0): n for a, n in whole.items()}
    per_arc: dict[int, int] = {}
    offset: dict[tuple[int, int], int] = {}
    for a, p in sorted(counts):
        offset[a, p] = per_arc.get(a, 0)
        per_arc[a] = offset[a, p] + counts[a, p]
    total = sum(per_arc.values())
    if load_factor <= 1:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        capacity = [-int(-load_factor * total // shards)] * shards
    runs = place(per_arc, owners, shards, capacity)
    plan = [
        (a, p, [(max(lo, base), min(hi, base + counts[a, p]), s, slot + max(lo, base) - lo) for lo, hi, s, slot in runs[a] if lo < base + counts[a, p] and hi > base], base)
        for (a, p), base in offset.items()
    ]
    schema = "_arc int, _part int, _runs array<struct<lo: bigint, hi: bigint, shard: int, slot: bigint>>, _base bigint"
    order = Window.partitionBy("_arc", "_part").orderBy("_h", "_key", "text_crc32", "size", "_number")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(spark.createDataFrame(plan, schema)), ["_arc", "_part"], "left")
    rank = F.col("_rank") + F.col("_base")
    run = F.get(F.filter("_runs", lambda r: (r["lo"] <= rank) & (r["hi"] > rank)), F.lit(0))
    run = F.coalesce(run, F.raise_error(F.lit("a row has no place on the ring")).cast("struct<lo: bigint, hi: bigint, shard: int, slot: bigint>"))
    return ranked.withColumn("_run", run).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("rows" if load_factor <= 1 else "bounded").alias("law"),
        F.col("_run.shard").alias("shard"), (F.col("_run.slot") + rank - F.col("_run.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
