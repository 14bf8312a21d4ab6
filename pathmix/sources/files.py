"""Readers of trip tables, networks and raw archives in their native formats, and the writers of results."""

from __future__ import annotations

import io
import json
import pickle
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

TRIP = (
    "user_id string, date date, role string, orig_trip_id bigint, agent_id string, origin_node int, destination_node int, q_path string, q_km double, capacity int, "
    "occupied_seats int, detour_tolerance double, detour_ratio double, tau double, earliest_departure timestamp_ntz, latest_arrival timestamp_ntz, trip_distance_km double, "
    "trip_duration_min double, average_speed_kmh double"
)
#: Parts of a network file; ids are read as text, so that a malformed one spoils its own row alone.
NODE = "struct<id: string, osm_id: bigint, x: double, y: double>"
EDGES = "array<struct<source: string, target: string, length: double, speed_kph: int, geometry: array<array<double>>>>"


def trips(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """The trip table with `path` parsed from q_path (or route_taken); `least` nodes at least. A missing user makes each
    trip its own user."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"{c} {dict(x.split(' ') for x in TRIP.split(', ')).get(c, 'string')}" for c in header)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    if "q_path" in header:
        rows = rows.withColumn("path", P.parse_text(F.col("q_path")))
    elif "route_taken" in header:
        rows = rows.withColumn("path", P.parse_literal(F.col("route_taken")))
    else:
        raise ValueError("neither q_path nor route_taken")
    if "user_id" not in header:
        rows = rows.withColumn("user_id", F.concat(F.lit("trip_"), F.monotonically_increasing_id().cast("string")))
    return rows.where(F.size("path") >= least)


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, lon, lat) and edges (source, target, length, geometry) of a network file. Nodes are a list, or an
    object by id; edges are `links` or `edges`. A missing or zero length is 1; nodes whose id is no whole number, and
    edges without both ends in the nodes, are dropped."""
    raw = spark.read.text(path, wholetext=True)
    held = F.get_json_object("value", "$.nodes")
    by_id = F.transform(F.map_entries(F.from_json(held, f"map<string, {NODE}>")), lambda x: F.struct(x["key"].alias("id"), x["value"]["x"].alias("x"), x["value"]["y"].alias("y")))
    listed = F.transform(F.from_json(held, f"array<{NODE}>"), lambda x: F.struct(x["id"].alias("id"), x["x"].alias("x"), x["y"].alias("y")))
    nodes = raw.select(F.explode(F.when(held.startswith("{"), by_id).otherwise(listed)).alias("n"))
    nodes = nodes.select(F.col("n.id").try_cast("int").alias("node"), F.col("n.x").alias("lon"), F.col("n.y").alias("lat")).where("node is not null")
    rows = raw.select(F.explode(F.from_json(F.coalesce(F.get_json_object("value", "$.links"), F.get_json_object("value", "$.edges")), EDGES)).alias("e")).select("e.*")
    rows = rows.select(F.col("source").try_cast("int").alias("source"), F.col("target").try_cast("int").alias("target"), F.coalesce(F.nullif("length", F.lit(0.0)), F.lit(1.0)).alias("length"), "geometry")
    known = nodes.select("node")
    rows = rows.join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi")
    return nodes, rows.select("source", "target", "length", "geometry")


def is_surveyed(spark: SparkSession, path: str) -> bool:
    """Whether the network says it comes from the public map."""
    raw = spark.read.schema("metadata struct<source: string>").option("multiLine", True).json(path)
    return raw.where(F.col("metadata.source").isin("osm", "osmnx")).limit(1).count() > 0


def archives(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """name, trip_id, cells of the trajectory arrays in NumPy archives, one task per file; nothing is unpickled."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    rows = np.asarray(held["traj"], np.int32)
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.rpartition("/")[2]] * len(part)), pa.array(np.arange(lo, lo + len(part), dtype=np.int64)), pa.array(list(part), pa.list_(pa.int32()))], names=["name", "trip_id", "cells"]
                    )

    return files.mapInArrow(run, "name string, trip_id bigint, cells array<int>")


#: What a pickled array of plain dicts, lists and numbers is made of: fixed values. Nothing else is ever called.
ARRAY_PARTS = {"_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer"}


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if name in ARRAY_PARTS and module in ("numpy", "numpy.core.multiarray", "numpy._core.multiarray", "numpy.core.numeric", "numpy._core.numeric") or (module, name) == ("_codecs", "encode"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is no part of a plain array")


def _grid(content: bytes) -> dict:
    """The dict that an archive holds as `grid`, an array of one object."""
    from numpy.lib import format as npy

    with zipfile.ZipFile(io.BytesIO(content)).open("grid.npy") as held:
        read = npy.read_array_header_1_0 if npy.read_magic(held)[0] == 1 else npy.read_array_header_2_0
        read(held)
        return _Plain(held).load().item()


def grids(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """name, cell, lon, lat of the grids in NumPy archives, one task per file. A grid is a pickled dict of cell ids and
    places; an archive that holds anything but plain arrays, dicts, lists and numbers there is refused. Cells whose id is
    no whole number, or without two coordinates, are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = [(int(k), float(v[0]), float(v[1])) for k, v in _grid(content).items() if str(k).lstrip("-").isdecimal() and len(v) >= 2]
                ids, lon, lat = zip(*cells, strict=True) if cells else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rpartition("/")[2]] * len(cells), pa.string()), pa.array(ids, pa.int32()), pa.array(lon, pa.float64()), pa.array(lat, pa.float64())], names=["name", "cell", "lon", "lat"]
                )

    return files.mapInArrow(run, "name string, cell int, lon double, lat double")


def prefix(name: str, family: str) -> str:
    """380_US_City.npz of a family of archives to family_380_US."""
    parts = name.rpartition("/")[2].removesuffix(".npz").split("_")
    return "_".join([family, *parts[:2]])


def write_trips(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_network(nodes: DataFrame, edges: DataFrame, path: str, source: str = "grid") -> None:
    """Nodes and edges as JSON lines, one data set each, so that neither has to fit one task; read by `network_lines`."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumn("source_kind", F.lit(source)).write.mode("overwrite").json(f"{path}/edges")


def network_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, lon, lat) and edges (source, target, length, geometry, source_kind) that `write_network` wrote;
    lines without a node, or without both ends, are dropped."""
    nodes = spark.read.schema("node int, lon double, lat double").json(f"{path}/nodes").where("node is not null")
    edges = spark.read.schema("source int, target int, length double, geometry array<array<double>>, source_kind string").json(f"{path}/edges")
    return nodes, edges.where("source is not null and target is not null")


def write_counts(table: DataFrame, path: str) -> None:
    """A count table partitioned by order, so that a model of order k reads no more than it needs."""
    table.write.mode("overwrite").partitionBy("k").parquet(path)


def read_counts(spark: SparkSession, path: str, highest: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if highest is None else rows.where(F.col("k") <= highest)


def write_results(records: DataFrame, path: str) -> None:
    """Metric records as Parquet by dataset, and their means as CSV and JSON."""
    from ..operators import report

    records.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/records")
    means = report.over_splits(records).orderBy("dataset", "model", "metric")
    means.write.mode("overwrite").option("header", True).csv(f"{path}/means_csv")
    means.write.mode("overwrite").json(f"{path}/means_json")


def results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several result places that exists (most complete first)."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(json.dumps(paths))
