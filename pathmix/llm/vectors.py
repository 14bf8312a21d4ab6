"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, settle
from .components import components, merged

#: Rows of one part of a cell (a tile holds two), pairs that are verified at once, rows that the grid aims at in a cell.
TILE, PAIRS, AIM = 4096, 1 << 15, 4096
#: Coordinates of the grid at least; more come only with tables far beyond AIM rows a label.
GRID = 2
#: Full cells whose counts are broadcast; with more, rows and counts are joined by shuffling both.
LISTED = 1_000_000


def rotation(width: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


class Subspaces:
    """Blocks of rotated coordinates, their budgets and their grids.

    Unit vectors with cosine c have squared distance 2 - 2c. If that is within a budget, some block's squared
    distance is within its share of it (in proportion to its width): otherwise the sum would exceed the whole. A
    block's pairs within its share lie in the same or adjacent cells of a grid over the block's first coordinates.
    """

    def __init__(self, width: int, cosine: float, blocks: int, grid: int):
        self.turn = rotation(width)
        self.blocks = min(blocks, width)
        self.starts = np.linspace(0, width, self.blocks + 1).astype(int)[:-1]
        self.sizes = np.diff(np.append(self.starts, width))
        self.budget = (2 - 2 * cosine) * self.sizes / width * (1 + 1e-9) + 1e-12
        self.grid = grid

    def cells(self, z: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, at home) of every cell in which a row has to appear: its own one as home, and as a visitor
        those adjacent cells within the radius that come later in order. So each pair meets exactly once."""
        lo, g = self.starts[block], min(self.grid, int(self.sizes[block]))
        radius = self.budget[block] ** 0.5
        x = z[:, lo : lo + g] / (2 * radius)
        own = np.floor(x).astype(np.int64)
        side = np.where(x - own < 0.5, -1, 1)  # with cells twice the radius wide only one neighbour per axis is near
        away = np.where(x - own < 0.5, x - own, own + 1 - x) * 2 * radius  # distance to that neighbour
        rows, cells, home = [], [], []
        for mask in range(1 << g):
            on = ((mask >> np.arange(g)) & 1).astype(bool)
            step = np.where(on, side, 0)
            later = np.zeros(len(z), bool)
            undecided = np.ones(len(z), bool)
            for k in range(g):
                later |= undecided & (step[:, k] > 0)
                undecided &= step[:, k] == 0
            near = (away[:, on] ** 2).sum(axis=1) <= self.budget[block] * (1 + 1e-6) + 1e-12
            pick = np.flatnonzero(later & near if mask else np.ones(len(z), bool))
            rows.append(pick)
            cells.append(own[pick] + step[pick])
            home.append(np.full(len(pick), mask == 0))
        code = np.zeros(sum(map(len, rows)), np.uint64)
        for k in range(g):
            code = code * np.uint64(0x9E3779B97F4A7C15) + np.concatenate(cells)[:, k].astype(np.uint64)
        return np.concatenate(rows), code.view(np.int64), np.concatenate(home)

    def first(self, za: np.ndarray, zb: np.ndarray) -> np.ndarray:
        """The first block in which each pair is within its share."""
        return (np.add.reduceat((za - zb) ** 2, self.starts, axis=1) <= self.budget).argmax(axis=1)


def _profiles(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, width and raw (doubles) of each row; raw is null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, widths = [], []
            for value, mark in zip(batch.column(1), batch.column(2), strict=True):
                numbers = value.values if value.is_valid and mark.is_valid else None
                ok = numbers is not None and len(numbers) and not numbers.null_count
                v = numbers.to_numpy(zero_copy_only=False).astype(np.float64) if ok else np.zeros(0)
                ok = bool(len(v)) and bool(np.isfinite(v).all()) and bool(v.any())
                if ok:
                    v = v / np.abs(v).max()  # neither overflow nor underflow in the norm
                raw.append((v + 0.0).tobytes() if ok else None)
                widths.append(len(v) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(widths, pa.int32()), pa.array(raw, pa.binary())], names=["id", "label", "width", "raw"])

    return df.select(F.col(key).cast("bigint"), vector, F.col(label).cast("bigint")).mapInArrow(run, "id bigint, label bigint, width int, raw binary")


def _turned(batch: pa.RecordBatch, column: int, spaces: Subspaces) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their rotated coordinates."""
    v = np.frombuffer(b"".join(batch.column(column).to_pylist()), np.float64).reshape(batch.num_rows, -1)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return unit, unit @ spaces.turn


def _counts(classes: DataFrame, spaces: Subspaces) -> DataFrame:
    """(label, block, cell, k): how many rows each cell sees, counted per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label = np.asarray(batch.column(0))
                _, z = _turned(batch, 1, spaces)
                for block in range(spaces.blocks):
                    row, cell, _ = spaces.cells(z, block)
                    seen, n = np.unique(np.stack([label[row], cell]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(np.full(len(n), block, np.int32)), pa.array(seen[1]), pa.array(n)], names=["label", "block", "cell", "k"])

    return classes.select("label", "raw").mapInArrow(run, "label bigint, block int, cell bigint, k bigint").groupBy("label", "block", "cell").agg(F.sum("k").alias("k"))


def _placed(classes: DataFrame, spaces: Subspaces) -> DataFrame:
    """(label, block, cell, home, id, code, near) for each cell in which a class of equal vectors appears; near: the
    block's coordinates as floats. The vectors themselves stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, z = _turned(batch, 3, spaces)
            for block in range(spaces.blocks):
                row, cell, home = spaces.cells(z, block)
                lo = spaces.starts[block]
                own = np.ascontiguousarray(z[:, lo : lo + spaces.sizes[block]].astype(np.float32))
                near = pa.array([r.tobytes() for r in own], pa.binary())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(np.full(len(row), block, np.int32)), pa.array(cell), pa.array(home), batch.column(1).take(at), batch.column(2).take(at), near.take(at)],
                    names=["label", "block", "cell", "home", "id", "code", "near"],
                )

    return classes.select("label", "id", "code", "raw").mapInArrow(run, "label bigint, block int, cell bigint, home boolean, id bigint, code bigint, near binary")


TILE_KEY = ["label", "block", "cell", "tile"]


def _tiles(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """The placed rows with `tile` and `second`. A cell of more than TILE rows is cut into parts; each two of them, and
    each with itself, are a tile; `second`: whether the row is of the tile's later part. The cut comes before any
    shuffle of the rows."""
    full = settle(counts.where(F.col("k") > TILE))
    few = full.limit(LISTED + 1).count() <= LISTED
    joined = placed.join(F.broadcast(full) if few else full, ["label", "block", "cell"], "left")
    parts = F.coalesce(F.ceil(F.col("k") / TILE), F.lit(1)).cast("int")
    rows = joined.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id", "code"), F.col("parts")).cast("int"))
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct((F.least(o, F.col("own")).cast("bigint") * F.col("parts") + F.greatest(o, F.col("own"))).alias("tile"), (o < F.col("own")).alias("second")),
    )
    rows = rows.withColumn("t", F.explode(tiles))
    return rows.select("label", "block", "cell", F.col("t.tile").alias("tile"), F.col("t.second").alias("second"), "home", "id", "code", "near")


def _met(second: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of some rows of a tile's first side and of its second, and which pairs of them count: over all, each pair
    once, one of the two at home."""
    a = np.flatnonzero(~second)
    b = np.flatnonzero(second) if second.any() else a
    for lo in range(0, len(a), 512):
        own = a[lo : lo + 512]
        meet = home[own][:, None] | home[b]
        yield own, b, meet if b is not a else meet & (own[:, None] < b)


def _survivors(tiles: DataFrame, spaces: Subspaces) -> DataFrame:
    """The rows of each tile that have at least one other within the block's share: keys only, never pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in grouped(batches, 4):
            block, second, home = (table.column(k).to_numpy() for k in (1, 4, 5))
            kept = np.zeros(table.num_rows, bool)
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                x = np.frombuffer(b"".join(table.column(8).slice(lo, hi - lo).to_pylist()), np.float32).reshape(hi - lo, -1).astype(np.float64)
                norms = (x * x).sum(axis=1)
                for a, b, meet in _met(second[lo:hi], home[lo:hi]):
                    far = norms[a][:, None] + norms[b] - 2 * (x[a] @ x[b].T)
                    close = meet & (far <= spaces.budget[block[lo]] * (1 + 1e-4) + 1e-6)  # room for the rounding to floats
                    kept[lo + a[close.any(axis=1)]] = True
                    kept[lo + b[close.any(axis=0)]] = True
            yield from table.select([0, 1, 2, 3, 4, 5, 6, 7]).filter(pa.array(kept)).to_batches()

    dealt = tiles.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY).select(*TILE_KEY, "second", "home", "id", "code", "near")
    return dealt.mapInArrow(run, "label bigint, block int, cell bigint, tile bigint, second boolean, home boolean, id bigint, code bigint")


def _linked(rows: DataFrame, spaces: Subspaces, cosine: float) -> DataFrame:
    """(id, links, root) per tile and linked class: links counts vectors, root is the least id it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in grouped(batches, 4):
            block, second, home, ids, many = (table.column(k).to_numpy() for k in (1, 4, 5, 6, 7))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                unit, z = _turned(table.slice(lo, hi - lo), 8, spaces)
                k, pairs = many[lo:hi], []
                for a, b, meet in _met(second[lo:hi], home[lo:hi]):
                    i, j = np.nonzero(meet & (unit[a] @ unit[b].T >= cosine))
                    i, j = a[i], b[j]
                    for p in range(0, len(i), PAIRS):
                        x, y = i[p : p + PAIRS], j[p : p + PAIRS]
                        mine = spaces.first(z[x], z[y]) == block[lo]
                        pairs.append((x[mine], y[mine]))
                if any(len(x) for x, _ in pairs):
                    i, j = (np.concatenate([x[s] for x in pairs]) for s in (0, 1))
                    order = np.argsort(ids[lo:hi], kind="stable")
                    rank = np.empty(hi - lo, np.int64)
                    rank[order] = np.arange(hi - lo)
                    root = ids[lo:hi][order][merged(hi - lo, rank[i], rank[j])][rank]
                    links = np.bincount(i, k[j], hi - lo) + np.bincount(j, k[i], hi - lo)
                    seen = np.flatnonzero(links)
                    out.append((ids[lo:hi][seen], links[seen].astype(np.int64), root[seen]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "links", "root"])

    dealt = rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    return dealt.select(*TILE_KEY, "second", "home", "id", "many", "raw").mapInArrow(run, "id bigint, links bigint, root bigint")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, blocks: int = 4) -> DataFrame:
    """Links between vectors of one label with a cosine (in doubles) of at least `cosine`.

    Returns per row: key, n_links (other vectors linked directly), component_id (smallest key reachable), kept (key
    = component_id). A null label, and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing and are kept; vectors of different widths don't link; equal vectors of a label are one class whose
    members all link (a repeated row counts as another vector); an empty table gives an empty one; other columns are
    left out.

    What is dealt to cells are keys and one block's coordinates. A cell of more than TILE rows is cut into parts that
    meet pairwise, so no task holds more than two parts at once. Of each tile those rows survive that have another one
    within the block's share; only to them the vectors are brought, and pairs are verified and counted inside the
    tile, each in the first block in which it is within its share. No pairs are written out. The key must be a number.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be a whole number")
    profiles = settle(_profiles(df, key, vector, label))
    good = profiles.where("raw is not null and id is not null").withColumn("same", F.unhex(F.md5("raw")))
    classes = good.groupBy("label", "width", "same").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.min("raw").alias("raw"))
    classes = settle(classes.withColumn("code", F.xxhash64("label", "raw")))
    widths = classes.groupBy("width").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()
    found: DataFrame | None = None
    for r in sorted(widths):
        more = np.ceil(np.log(max(r["n"] / r["labels"], 1) / AIM) / np.log(2.2)) if r["n"] > AIM * r["labels"] else 0
        spaces = Subspaces(r["width"], cosine, blocks, int(min(8, GRID + more)))
        own = classes.where(F.col("width") == r["width"])
        tiles = _tiles(_placed(own, spaces), _counts(own, spaces))
        near = settle(_survivors(tiles, spaces))
        part = _linked(near.join(own.select("id", "code", "many", "raw"), ["id", "code"]), spaces, cosine)
        found = part if found is None else found.union(part)
    n, low = F.lit(0).cast("bigint"), F.col("rep")
    keyed = profiles.select("id", "label", "width", F.unhex(F.md5("raw")).alias("same"))
    out = keyed.join(classes.select("label", "width", "same", F.col("id").alias("rep"), "many"), ["label", "width", "same"], "left")
    if found is not None:
        found = settle(found)
        links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
        reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        out = out.join(links, "rep", "left").join(reach.select(F.col("id").alias("rep"), "component"), "rep", "left")
        n, low = F.coalesce("links", n), F.coalesce("component", low)
    low = F.coalesce(low, "id")
    kind = dict(df.dtypes)[key]
    return out.select(
        F.col("id").cast(kind).alias(key), (n + F.coalesce(F.col("many") - 1, F.lit(0))).cast("bigint").alias("n_links"), low.cast(kind).alias("component_id"), (low == F.col("id")).alias("kept")
    )
