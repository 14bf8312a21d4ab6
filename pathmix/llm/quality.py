"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k over their ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import LOWER, _powers, drop_settled, flat, mix, numbered, pieces, settle

#: Buckets of the hashed models, added count, rows of the histogram that finds a rank, and their bound when refined.
BUCKETS, ADDED, BINS = 1 << 14, 0.5, 4096
#: Log weights are divided by this before the noise is added: the lower, the less luck near the border.
TEMPERATURE = 0.125
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def grams(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every hashed n-gram of rows i..j.

    Tokens are runs of word characters or of other visible ones. n-grams: one and two tokens (A-Z lower-cased), and
    one to three token shapes (kind, capitals, length, whether the word before is the same), in parts of the buckets
    of their own.
    """
    lo, hi = int(at[i]), int(at[j])
    raw, cut = data[lo:hi], at[i : j + 1] - lo
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if hi == lo:
        return none
    kind = _CLASS[raw]
    change = np.ones(hi - lo, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[cut[:-1][cut[:-1] < hi - lo]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], hi - lo)
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    if not len(start):
        return none
    row = np.searchsorted(cut, start, "right") - 1
    power, inverse = _powers(hi - lo + 1)
    total = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
    size = (end - start).astype(np.uint64)
    h = mix((total[end] - total[start]) * inverse[start] + size)
    capitals = np.zeros(hi - lo + 1, np.int32)
    np.cumsum((raw >= 65) & (raw <= 90), out=capitals[1:])
    smalls = np.zeros(hi - lo + 1, np.int32)
    np.cumsum((raw >= 97) & (raw <= 122), out=smalls[1:])
    up, down = capitals[end] - capitals[start], smalls[end] - smalls[start]
    word = kind[start] == 1
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) & word[1:]
    case = np.where(up == 0, 0, np.where((up > 1) & (down == 0), 2, 1))
    shape = np.where(word, 8 + case, np.uint64(0) + (raw[start] % 7)).astype(np.uint64) * np.uint64(16) + np.minimum(size, np.uint64(6)) + same * np.uint64(1024)
    shape = mix(shape + np.uint64(77))
    out_row, out = [], []

    def add(values: np.ndarray, n: int, part: int) -> None:
        own = row[: len(values)]
        inside = own == row[n - 1 :] if n > 1 else slice(None)
        out_row.append(own[inside])
        half = np.uint64(BUCKETS // 4)
        out.append((mix(values + np.uint64(n))[inside] % half).astype(np.int64) + part * (BUCKETS // 4))

    base = np.uint64(0xD6E8FEB86659FD93)
    add(h, 1, 0)
    if len(h) > 1:
        add(h[:-1] * base + h[1:], 2, 1)
    add(shape, 1, 2)
    if len(h) > 1:
        add(shape[:-1] * base + shape[1:], 2, 2)
    if len(h) > 2:
        add((shape[:-2] * base + shape[1:-1]) * base + shape[2:], 3, 3)
    return np.concatenate(out_row), np.concatenate(out)


def fit(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target and raw model per bucket. Raw: all rows of `df`; target: those whose key `target` lists.

    Each task counts buckets as it reads; only counts are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, at = flat(batch.column(0))
            wanted = np.asarray(batch.column(1))
            for i, j in pieces(at):
                row, bucket = grams(data, at, i, j)
                raw += np.bincount(bucket, minlength=BUCKETS)
                aim += np.bincount(bucket[wanted[i:j][row]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(aim[seen])], names=["bucket", "raw", "aim"])

    marked = df.select(text, F.col(key).alias("_key")).join(F.broadcast(target.select(F.col(key).alias("_key")).distinct().withColumn("_aim", F.lit(True))), "_key", "left")
    counts = marked.select(text, F.coalesce("_aim", F.lit(False)).alias("_aim")).mapInArrow(count, "bucket bigint, raw bigint, aim bigint")
    raw, aim = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).collect():
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["aim"]
    if not aim.any():
        return np.zeros(BUCKETS)
    ratio = np.zeros(BUCKETS)
    for part in np.split(np.arange(BUCKETS), 4):
        a, b = aim[part] + ADDED, raw[part] + ADDED
        ratio[part] = np.log(a / a.sum()) - np.log(b / b.sum())
    return ratio


def _weights(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    data, at = flat(column)
    out = np.zeros(len(column))
    for i, j in pieces(at):
        row, bucket = grams(data, at, i, j)
        n = np.bincount(row, minlength=j - i)
        out[i:j] = np.bincount(row, ratio[bucket], minlength=j - i) / np.sqrt(np.maximum(n, 1))
    return out


def _gumbel(key: Column) -> Column:
    """Gumbel noise from a hash of the key: the same for a document wherever and whenever it is drawn."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(40_503)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(-F.ln(u))


def weigh(df: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, least: float | None = None) -> DataFrame:
    """Columns `keep` (the key alone if None), log_weight and draw (log weight over TEMPERATURE plus Gumbel noise); with `least` only
    rows whose draw is at least that, and only the columns `keep`.

    The log weight is the log ratio summed over a text's n-grams over the root of their number, so that neither
    long nor short texts win by length. Null and empty texts weigh 0.
    """
    columns = keep or [key]
    model = df.sparkSession.sparkContext.broadcast(ratio)
    kinds = dict(zip(df.columns, df.schema.fields, strict=True))
    place = {c: f"c{k}" for k, c in enumerate(df.columns)}
    rows = numbered(df).select(*[F.col(place[c]).alias(f"k{k}") for k, c in enumerate(columns)], F.col(place[text]).alias("text"), _gumbel(F.col(place[key])).alias("noise"))
    n = len(columns)
    inner = [f"k{k}" for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = _weights(batch.column(n), model.value)
            draw = weight / TEMPERATURE + np.asarray(batch.column(n + 1))
            if least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(weight), pa.array(draw)], names=[*inner, "log_weight", "draw"])
            else:  # by place: the columns may bear any names
                yield pa.RecordBatch.from_arrays(batch.columns[:n], names=inner).filter(pa.array(draw >= least))

    schema = StructType([StructField(k, kinds[c].dataType) for k, c in zip(inner, columns, strict=True)])
    if least is None:
        schema = schema.add("log_weight", "double").add("draw", "double")
    return rows.mapInArrow(run, schema).toDF(*columns, *(["log_weight", "draw"] if least is None else []))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of BINS rows that narrow on the bin which holds it; -inf if k is too large."""
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0:
        return math.inf
    if not n or k > n:
        return -math.inf
    inside, above = values.where(F.col(column).isNotNull()), 0
    while high > low:
        width = (high - low) / BINS
        if low + width == low:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        bins = inside.where(F.col(column).between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    return low


def _border(scored: DataFrame) -> float:
    """The log weight that best parts labelled good (y) from bad rows; where none is wrong, a quarter of the way from
    the good ones to the bad. Counted on a grid of sixteenths within +-4096, so the table has a fixed bound."""
    grid = F.greatest(F.least(F.floor(F.col("log_weight") * 16), F.lit(1 << 16)), F.lit(-(1 << 16)))
    rows = sorted((r["g"], r["good"] or 0, r["bad"] or 0) for r in scored.where("y is not null").groupBy(grid.alias("g")).agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return -math.inf
    best, border, lost, caught = math.inf, -math.inf, 0, 0
    for n, (g, a, b) in enumerate(rows):
        lost, caught = lost + a, caught + b
        if (wrong := lost / good + (bad - caught) / bad) < best and n + 1 < len(rows):
            best, border = wrong, rows[n + 1][0] / 16 - (rows[n + 1][0] - g) / 64
    return border if best < 1 else -math.inf


def choose(df: DataFrame, labels: DataFrame, k: int | None = None, sample: int = 20_000, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray, float]:
    """Gumbel top-k by importance: (settled key, log_weight, draw of all rows, log ratios, least draw that is kept).

    The target model is fitted on the labelled rows of good quality and not toxic among `sample` labelled rows with
    the smallest hash (the bound of that sample); the raw model counts all rows. Without k, as many rows are kept
    as have a log weight above the border that best parts the sample's rows of quality 1 from those of quality 0. The
    border does not look at toxic: toxic rows of good quality mostly stay, this is no filter for them. Equal draws
    (repeated rows) at the last place are all kept. A document labelled more than once counts with its worst label. Without
    labels of both kinds all rows are kept. The key's type must be the labels' own.
    """
    order = F.xxhash64(F.col(key), F.lit(7))
    marks = labels.groupBy(key).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where(F.col(key).isNotNull() & F.col("quality").isNotNull())
    marks = settle(marks.orderBy(order, key).limit(sample))
    ratio = fit(df, marks.where("quality = 1 and coalesce(toxic, 0) = 0"), key, text)
    scored = weigh(df, ratio, key, text).join(F.broadcast(marks.select(F.col(key), F.col("quality").cast("bigint").alias("y"))), key, "left")
    scored = settle(scored)
    if k is None:
        border = _border(scored)
        k = scored.where(F.col("log_weight") > border).count()
    drop_settled(marks)
    return scored, ratio, kth_largest(scored, "draw", k)


def keep(df: DataFrame, labels: DataFrame, k: int | None = None, sample: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows: key, log_weight, draw, kept (true)."""
    scored, _, least = choose(df, labels, k, sample, key, text)
    return scored.where(F.col("draw") >= least).select(key, "log_weight", "draw", F.lit(True).alias("kept"))


def filtered(df: DataFrame, labels: DataFrame, k: int | None = None, sample: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows of `df` with all its columns. Texts are weighed again where they are read, so none is shuffled."""
    scored, ratio, least = choose(df, labels, k, sample, key, text)
    drop_settled(scored)
    return weigh(df, ratio, key, text, df.columns, least)
