"""Individual memory online: each user's last nodes, as a batch window and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def batch(steps: DataFrame, size: int, user: str = "user_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """steps (user, order, node) with memory: the user's `size` nodes before this row."""
    before = Window.partitionBy(user).orderBy(*order).rowsBetween(-size, -1)
    return steps.withColumn("memory", F.collect_list("node").over(before))


def stream(steps: DataFrame, size: int, idle: str | None = None) -> DataFrame:
    """The same over a stream of (user_id, seq, node): each row sees the rows before it, also within one micro-batch.
    State is one bounded list per user; with `idle` (milliseconds) it is dropped for users that stay silent."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = []
        for seq, node in zip(rows["seq"], rows["node"], strict=True):
            out.append((key[0], seq, node, list(memory)))
            memory = [*memory, int(node)][-size:]
        state.update((memory,))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=["user_id", "seq", "node", "memory"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return steps.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, seq bigint, node int, memory array<int>", "memory array<int>", "append", timeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Node counts per event-time window of a stream (or a table) with (ts, node); rows later than `late` are dropped."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(span, "node").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "node", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end, events."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
