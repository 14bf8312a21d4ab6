"""Paths, a road graph and coordinates derived from the star-schema tables.

Paths are kept as one row per trip with an array of nodes: one shuffle gathers a trip, and all window and n-gram
work after that is per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Nodes of the event paths, in order: fixed values.
EVENT_NODES = ["click", "error", "purchase", "signup", "view"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, user_id, pos, node: one trip per user and week."""
    events = read(spark, sf_dir, "events")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("bigint")
    node = (F.array_position(F.array(*[F.lit(n) for n in EVENT_NODES]), F.col("event_type")) - 1).cast("int")
    rows = events.select((F.col("user_id") * 100 + week).alias("trip_id"), "user_id", node.alias("node"), "ts", "event_id")
    order = Window.partitionBy("trip_id").orderBy("ts", "event_id")
    return rows.select("trip_id", "user_id", (F.row_number().over(order) - 1).alias("pos"), "node")


def _paths(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "node"))).alias("s"))
    return gathered.select(*keys, F.transform("s", lambda x: x["node"]).alias("path"))


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, user_id, path."""
    events = read(spark, sf_dir, "events")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("bigint")
    node = (F.array_position(F.array(*[F.lit(n) for n in EVENT_NODES]), F.col("event_type")) - 1).cast("int")
    return _paths(events.select((F.col("user_id") * 100 + week).alias("trip_id"), "user_id", node.alias("node"), "ts", "event_id"), ["trip_id", "user_id"], ["ts", "event_id"])


def supplier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id (order), path of suppliers over the order's lines."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").cast("int").alias("node"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return _paths(rows, ["trip_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, lon, lat of each supplier."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(s.cast("int").alias("node"), (s * 37 % 360 - 180 + 0.5).alias("lon"), (s * 17 % 170 - 85 + 0.5).alias("lat"))


def road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, length (integers): a sparse directed graph over consecutive suppliers."""
    lines = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    pairs = lines.select(F.col("l_suppkey").cast("int").alias("source"), F.lead("l_suppkey").over(order).cast("int").alias("target"), F.col("l_quantity").cast("int").alias("length"))
    kept = pairs.where((F.col("source") != F.col("target")) & ((F.col("source") * 31 + F.col("target") * 17) % 20 == 0))
    return kept.groupBy("source", "target").agg(F.min("length").alias("length"))
