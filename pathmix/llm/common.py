"""What the text operators share: table reading, shared-folder checkpoints, and Arrow text as flat bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised kernels handle at once; their temporary arrays take about 60 times as much.
CHUNK_BYTES = (1 << 20) - 1
#: Rows that go to a Python worker at once, at most: texts can be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set. Python workers started from now on find this package where the driver found it."""
    if (root := str(Path(__file__).parents[2])) not in (paths := spark.sparkContext.environment.get("PYTHONPATH", "")).split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, root)))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The columns by place, c0, c1, ...: their own names may hold dots, clash or repeat."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        place = spark.sparkContext.getCheckpointDir()
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pathmix-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathmix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Remove the files behind a settled frame once no later step reads them."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/pathmix-" in name:
            place = jvm.org.apache.hadoop.fs.Path(name)
            place.getFileSystem(conf).delete(place, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings, and the offsets at which each begins (one more than strings). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together; a longer row is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_B = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = 1 << (n - 1).bit_length()
        inverse = pow(_B, -1, 1 << 64)
        for k, base in enumerate((_B, inverse)):
            row = np.full(m, base, np.uint64)
            row[0] = 1
            _POW[k] = np.multiply.accumulate(row)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, all bits spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Maximal runs of word bytes in rows i..j of a flat text column, in order, with A-Z lower-cased hashes.

    start, end: byte positions in the whole buffer; row: row of each word, from 0 for row i; hash: 64 bits;
    first: for each row the index of its first word, with a last entry for the end.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, i: int, j: int, is_word: np.ndarray):
        lo, hi = int(at[i]), int(at[j])
        raw = data[lo:hi]
        inside = is_word[raw]
        cut = at[i : j + 1] - lo
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, stop = edge[:-1] == 1, edge[1:] == -1
        bounds = cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < hi - lo)]
        both = bounds[inside[bounds] & inside[bounds - 1]] if len(bounds) else bounds
        begin[both] = True
        stop[both - 1] = True
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
        self.hash = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        self.start, self.end = start + lo, end + lo
        self.first = np.searchsorted(start, cut, "left")
        self.row = np.repeat(np.arange(j - i), np.diff(self.first))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words p..p+k-1 for each p at which that many follow."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for x in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[x : x + n]
    return mix(out)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of rows that follow each other with equal first `keys` columns: tables and where groups begin
    (and the last ends). Rows must be sorted by those columns; a table holds at least one group."""
    rest: list[pa.Table] = []
    last: tuple | None = None

    def edges(table: pa.Table) -> list[int]:
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in range(keys):
            values = table.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        head = tuple(table.column(k)[0].as_py() for k in range(keys))
        inner = edges(table)
        if rest and head == last and len(inner) == 2:
            rest.append(table)  # the group goes on through the whole batch
            continue
        whole = pa.concat_tables([*rest, table]).combine_chunks() if rest else table
        cut = edges(whole)
        if len(cut) > 2:
            yield whole.slice(0, cut[-2]), cut[:-1]
            whole = whole.slice(cut[-2])
        rest, last = [whole], tuple(whole.column(k)[0].as_py() for k in range(keys))
    if rest:
        whole = pa.concat_tables(rest).combine_chunks()
        yield whole, edges(whole)
