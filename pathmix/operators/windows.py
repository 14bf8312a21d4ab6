"""Windows, histories and encodings over a table of paths (key columns and `path`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from .settled import cut


#: Nodes of a user's history that individual memories read: fixed value.
HISTORY = 3000


def at_least(paths: DataFrame, nodes: int) -> DataFrame:
    return paths.where(F.size("path") >= nodes)


def samples(paths: DataFrame, length: int) -> DataFrame:
    """One row per target with `length` nodes before it: keys, pos (of the target), ctx, target."""
    keys = [c for c in paths.columns if c != "path"]
    starts = F.when(F.size("path") > length, F.sequence(F.lit(0), F.size("path") - length - 1)).otherwise(F.array().cast("array<int>"))
    rows = paths.select(*keys, "path", F.explode(starts).alias("i"))
    return rows.select(*keys, (F.col("i") + length).alias("pos"), F.slice("path", F.col("i") + 1, F.lit(length)).alias("ctx"), F.get("path", F.col("i") + length).alias("target"))


def steps(paths: DataFrame) -> DataFrame:
    keys = [c for c in paths.columns if c != "path"]
    return paths.select(*keys, F.posexplode("path").alias("pos", "node"))


def vocabulary(paths: DataFrame) -> DataFrame:
    """node and its rank among all distinct nodes (idx from 0).

    Ranks come from per-bucket counts over a range partitioning, so no task sees all nodes.
    """
    nodes = paths.select(F.explode("path").alias("node")).distinct()
    return ranked(nodes, "node", "idx")


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the position (from 0) of each distinct value in sorted order, without one task for all rows: values are
    dealt in sorted ranges, ranked in their range, and shifted by the sizes of the ranges before it."""
    dealt = rows.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    dealt = cut(dealt)  # both the counts and the ranks read the same rows, whichever task runs again
    inside = dealt.withColumn("_r", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))
    sizes = inside.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_shift", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_p", "_shift")), "_p").select(*rows.columns, (F.col("_r") + F.col("_shift")).cast("bigint").alias(name))


def encode(paths: DataFrame, vocab: DataFrame) -> DataFrame:
    """Nodes to idx; unknown nodes are dropped, and paths without a known one."""
    keys = [c for c in paths.columns if c != "path"]
    rows = steps(paths).join(vocab, "node")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("s")).select(*keys, F.transform("s", lambda x: x["idx"]).alias("path"))


def kgram_vocabulary(paths: DataFrame, k: int) -> DataFrame:
    """kgram and id: its rank among the distinct k-grams in order."""
    grams = paths.select(F.explode(P.kgrams(F.col("path"), k)).alias("kgram")).distinct()
    return ranked(grams, "kgram", "id")


def kgram_encode(paths: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Each path as the ids of its k-grams; unknown ones are skipped, paths without a known one dropped."""
    keys = [c for c in paths.columns if c != "path"]
    rows = paths.select(*keys, F.posexplode(P.kgrams(F.col("path"), k)).alias("pos", "kgram")).join(vocab, "kgram")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s")).select(*keys, F.transform("s", lambda x: x["id"]).alias("path"))


def kgram_decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    keys = [c for c in encoded.columns if c != "path"]
    rows = encoded.select(*keys, F.posexplode("path").alias("pos", "id")).join(vocab, "id")
    grams = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "kgram"))).alias("s"))
    return grams.select(*keys, P.join_kgrams(F.transform("s", lambda x: x["kgram"])).alias("path"))


def lags(paths: DataFrame) -> DataFrame:
    """keys, pos, node and the next two nodes (null beyond the end)."""
    keys = [c for c in paths.columns if c != "path"]
    return paths.select(*keys, F.posexplode("path").alias("pos", "node"), "path").select(
        *keys, "pos", "node", F.get("path", F.col("pos") + 1).alias("next1"), F.get("path", F.col("pos") + 2).alias("next2")
    )


def histories(paths: DataFrame, user: str, order: str, longest: int | None = None) -> DataFrame:
    """user and the concatenation of the user's paths in the given order, its last `longest` nodes."""
    whole = paths.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(order, "path"))).alias("s")).select(user, F.flatten(F.transform("s", lambda x: x["path"])).alias("nodes"))
    return whole if longest is None else whole.withColumn("nodes", P.tail(F.col("nodes"), longest))


def history_ngrams(histories_: DataFrame, user: str, highest: int) -> DataFrame:
    """user, k, ctx, next, cnt over each history, orders 1 to `highest`."""
    return ngrams(histories_.select(user, F.col("nodes").alias("path")), highest, keys=[user])


def ngrams(paths: DataFrame, highest: int, lowest: int = 1, keys: list[str] | None = None) -> DataFrame:
    """k, ctx, next, cnt: how often each node follows each context of `lowest` to `highest` nodes (0: no context).

    Targets are all nodes but a path's first. Counts are summed on the map side before the one shuffle.
    """
    keys = keys or []
    targets = F.when(F.size("path") > 1, F.sequence(F.lit(1), F.size("path") - 1)).otherwise(F.array().cast("array<int>"))

    def at(i):
        top = F.least(i, F.lit(highest))
        orders = F.when(top >= lowest, F.sequence(F.lit(lowest), top)).otherwise(F.array().cast("array<int>"))
        return F.transform(orders, lambda k: F.struct(k.alias("k"), F.slice("path", i - k + 1, k).alias("ctx"), F.get("path", i).alias("next")))

    rows = paths.select(*keys, F.explode(F.flatten(F.transform(targets, at))).alias("g"))
    return rows.groupBy(*keys, "g.k", "g.ctx", "g.next").agg(F.count("*").alias("cnt"))


def overlap_ngrams(paths: DataFrame, length: int, highest: int) -> DataFrame:
    """k, ctx, next, cnt as overlapping windows of `length` nodes (without their targets) would give them.

    A (k+1)-gram at p in a path of n nodes lies in min(p, n-length-1) - max(0, p+k-length+1) + 1 windows, so
    the counts need no windows at all.
    """
    top = min(highest, length - 1)
    n = F.size("path")
    targets = F.when(n > length, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def at(i):
        def gram(k):
            p = i - k
            times = F.least(p, n - length - 1) - F.greatest(F.lit(0), i - length + 1) + 1
            return F.struct(k.alias("k"), F.slice("path", p + 1, k).alias("ctx"), F.get("path", i).alias("next"), times.alias("times"))

        return F.transform(F.sequence(F.lit(1), F.least(i, F.lit(top))), gram)

    rows = paths.select(F.explode(F.flatten(F.transform(targets, at))).alias("g")).where("g.times > 0")
    return rows.groupBy("g.k", "g.ctx", "g.next").agg(F.sum("g.times").alias("cnt"))


def rampup(paths: DataFrame, highest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start (node, cnt), transition (k, ctx, next, cnt) and terminal (k, ctx, cnt) counts in which a node at
    position i counts at order min(i, highest) alone."""
    start = paths.where(F.size("path") > 0).groupBy(F.get("path", F.lit(0)).alias("node")).agg(F.count("*").alias("cnt"))
    targets = F.when(F.size("path") > 1, F.sequence(F.lit(1), F.size("path") - 1)).otherwise(F.array().cast("array<int>"))

    def gram(i):
        k = F.least(i, F.lit(highest))
        return F.struct(k.alias("k"), F.slice("path", i - k + 1, k).alias("ctx"), F.get("path", i).alias("next"))

    moves = paths.select(F.explode(F.transform(targets, gram)).alias("g")).groupBy("g.k", "g.ctx", "g.next").agg(F.count("*").alias("cnt"))
    k = F.least(F.size("path"), F.lit(highest))
    ends = paths.where(F.size("path") > 0).groupBy(k.alias("k"), F.slice("path", F.size("path") - k + 1, k).alias("ctx")).agg(F.count("*").alias("cnt"))
    return start, moves, ends


def rows_of(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per context: k, sfx, n (its total) and nexts (node, cnt): what a look-up joins with."""
    keys = keys or []
    return counts.groupBy(*keys, "k", F.col("ctx").alias("sfx")).agg(F.sum("cnt").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("next").alias("node"), "cnt"))).alias("nexts"))


def match(contexts: DataFrame, table: DataFrame, highest: int, keys: list[str] | None = None, lowest: int = 1) -> DataFrame:
    """contexts (keys, ctx; distinct) with `found`: k, n, nexts of every suffix in the table, shortest first.

    One equi-join on (keys, k, suffix) with one row per context on the model's side, whatever the number of
    successors; a context without any match keeps an empty array.
    """
    keys = keys or []
    parts = contexts.select(*keys, "ctx", F.explode_outer(P.suffixes(F.col("ctx"), highest, lowest)).alias("s"))
    parts = parts.select(*keys, "ctx", F.col("s.k").alias("k"), F.col("s.sfx").alias("sfx"))
    joined = parts.join(table, [*keys, "k", "sfx"], "left")
    found = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("k", "n", "nexts")))
    return joined.groupBy(*keys, "ctx").agg(F.array_sort(found).alias("found"))


def longest_match(contexts: DataFrame, table: DataFrame, highest: int, keys: list[str] | None = None) -> DataFrame:
    """Highest matched order of each context (0 if none)."""
    keys = keys or []
    parts = contexts.select(*keys, "ctx", F.explode_outer(P.suffixes(F.col("ctx"), highest)).alias("s")).select(*keys, "ctx", F.col("s.k").alias("k"), F.col("s.sfx").alias("sfx"))
    known = table.select(*keys, "k", "sfx").distinct().withColumn("hit", F.lit(True))
    return parts.join(known, [*keys, "k", "sfx"], "left").groupBy(*keys, "ctx").agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("k"))), F.lit(0)).alias("k"))
