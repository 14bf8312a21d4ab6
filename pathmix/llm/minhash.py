"""Near duplicates by a chosen-path set similarity join over minhash sketches, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_settled, flat, grouped, mix, pieces, settle, windows
from .components import components

#: Coordinates of a sketch that name children, and those (of one byte, a multiple of eight below 256) that estimate.
COORDS, COMPARED = 64, 248
#: A score above all estimates: members of one component.
JOINED = 1 << 20
#: Shingles whose sets one task holds at once when texts of a tile meet with their full sets.
VOLUME = 4_000_000
#: Texts of one block of a node; a node of more is compared in tiles of two blocks each.
SPLIT = 512
#: Rows of a few numbers each that are broadcast; with more, tables are joined by shuffling both.
LISTED = 1_000_000

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_ODD, _ODD_COMPARED = np.split(mix(np.arange(1, COORDS + COMPARED + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), [COORDS])


def shingles(data: np.ndarray, at: np.ndarray, i: int, j: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows i..j, row after row and sorted within each, and where each row begins."""
    words = Words(data, at, i, j, IS_WORD)
    all_windows = windows(words.hash, width)
    sets = []
    for r in range(j - i):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= width:
            own = all_windows[a : b - width + 1].copy()
            own.sort()
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            sets.append(windows(np.append(words.hash[a:b], np.uint64(b - a)), b - a + 1))
        else:
            sets.append(np.zeros(0, np.uint64))
    first = np.zeros(j - i + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), first


def sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COORDS minima (32 bits each) per row; rows without shingles get zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, COORDS), np.uint32)
    if len(full):
        for c in range(COORDS):
            out[full, c] = np.minimum.reduceat(values * _ODD[c], first[full]) >> np.uint64(32)
    return out


def compact(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """COMPARED minima of one byte each per row, for estimates; rows without shingles get zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, COMPARED), np.uint8)
    if len(full):
        for c in range(COMPARED):
            out[full, c] = np.minimum.reduceat(values * _ODD_COMPARED[c], first[full]) >> np.uint64(32)
    return out


def agree(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Equal coordinates of one compact sketch and each of many (both as rows of COMPARED bytes)."""
    words = (many == one).view(np.uint64)
    return ((words.sum(axis=-1) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def forest(sketches: np.ndarray, comp: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of a largest spanning forest over estimates of at least `least`; members of a component need none."""
    n = len(sketches)
    best, origin = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    out = []
    for _ in range(n):
        i = int(best.argmax())
        if best[i] == -2:
            break
        if least <= best[i] < JOINED:
            out.append((int(origin[i]), i))
        best[i] = -2
        open_ = best > -2
        score = agree(sketches[i], sketches)
        score[comp == comp[i]] = JOINED
        better = open_ & (score > best)
        best[better], origin[better] = score[better], i
    return out


def confirmed(comp: np.ndarray, main: np.ndarray, views: np.ndarray, sets: list[np.ndarray], least: int, percent: int) -> list[tuple[int, int]]:
    """Links between different components of one tile that hold on the full sets; of those that join the same two
    components one is given. Every pair of different components whose estimate is at least `least` is counted,
    unless links found before it have joined them; members of `main` only meet others."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(place) + 1, bool)
    comp = comp.copy()
    out = []
    for i in np.flatnonzero(~main):
        near = (comp != comp[i]) & (agree(views[i], views) >= least)
        near[: i + 1] &= main[: i + 1]
        other = np.flatnonzero(near)
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        own = place[ends[i] - size[i] : ends[i]]
        mark[own] = True
        lengths = size[other]
        heads = np.cumsum(lengths) - lengths
        take = np.arange(lengths.sum()) + np.repeat(ends[other] - lengths - heads, lengths)
        shared = np.add.reduceat(mark[place[take]].astype(np.int64), heads)
        mark[own] = False
        for j in other[100 * shared >= percent * (size[i] + lengths - shared)]:
            if comp[j] != comp[i]:
                out.append((int(i), int(j)))
                comp[comp == comp[j]] = comp[i]
    return out


LINK = "a bigint, b bigint"


def _links(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    rows = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], names=["a", "b"])


def listed(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The rows whose id is listed: the list is broadcast up to LISTED ids, beyond that both sides are shuffled."""
    return rows.join(F.broadcast(ids) if count <= LISTED else ids, "id", "left_semi")


def dealt_join(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` (key, id, ...) joined with a settled `table` of one row per key, whose `size` says how many rows bear it.

    Rows of a key of more than SPLIT rows, and more than one in LISTED of all rows (so fewer than LISTED keys, which are
    broadcast), are dealt over parts of SPLIT by a hash of the id, and the key's row is copied for each part: no task
    reads a whole hot key.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    parts = F.ceil(F.col(size) / SPLIT).cast("int")
    hot = F.col(size) > max(SPLIT, total // max(LISTED, 1))
    dealt = rows.join(F.broadcast(table.where(hot).select(key, parts.alias("_parts"))), key, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("id"), "_parts").cast("int"), F.lit(0))).drop("_parts")
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(hot, parts - 1).otherwise(F.lit(0)))))
    return dealt.join(copies, [key, "_part"]).drop("_part")


class ChosenPath:
    """The join: sketches of texts in, confirmed components out.

    Every tree sends a text to children named by some of its sketch's minwise tokens; whether a token opens a child
    depends on the path and the token alone, so similar texts meet. Nodes of up to `leaf` texts are compared
    exhaustively on compact sketches; larger ones branch on. A node proposes a spanning forest of its estimates, so
    n copies make at most n proposals, and whatever resembles each other in some node is in one component of all
    proposals. Such a group meets once, with its full sets: there every pair whose estimate is high enough is counted
    exactly unless the links found before it have joined it. So no link is lost and no pairs are written out.
    """

    def __init__(self, percent: int = 80, width: int = 4, trees: int = 12, leaf: int = 8192, depth: int = 8):
        self.percent, self.width, self.trees, self.leaf, self.depth = percent, width, trees, leaf, depth
        share = percent / 100
        #: Estimates four and a half standard errors below the bound still count as candidates.
        self.least = int(COMPARED * (share - 4.5 * (share * (1 - share) / COMPARED) ** 0.5))
        self.branch = 1 / (share * COORDS)

    # what each task does with the texts it reads

    def profiles(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, n (set size), i1, i2 (set identity), path (COORDS minima), view (compact sketch)."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = flat(batch.column(1))
                for i, j in pieces(at):
                    values, first = shingles(data, at, i, j, width)
                    n = np.diff(first)
                    ends = np.zeros((2, len(values) + 1), np.uint64)
                    np.cumsum(mix(values), out=ends[0, 1:])
                    np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=ends[1, 1:])
                    one, two = (e[first[1:]] - e[first[:-1]] for e in ends)
                    path, view = sketch(values, first), compact(values, first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, j - i), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                            pa.array([r.tobytes() for r in path], pa.binary()), pa.array([r.tobytes() for r in view], pa.binary()),
                        ],
                        names=["id", "n", "i1", "i2", "path", "view"],
                    )

        return df.select(F.col(key).cast("bigint"), text).mapInArrow(run, "id bigint, n bigint, i1 bigint, i2 bigint, path binary, view binary")

    def sets(self, df: DataFrame, ids: DataFrame, key: str, text: str, repeated: bool) -> DataFrame:
        """id, view and the full sorted set of each listed document; only texts of listed documents are worked on."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = flat(batch.column(1))
                for i, j in pieces(at):
                    values, first = shingles(data, at, i, j, width)
                    view = pa.array([r.tobytes() for r in compact(values, first)], pa.binary())
                    members = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), view, members], names=["id", "view", "members"])

        rows = listed(df.select(F.col(key).cast("bigint").alias("id"), text), ids, ids.count())
        out = rows.mapInArrow(run, "id bigint, view binary, members array<bigint>").where(F.size("members") > 0)
        return out.dropDuplicates(["id", "members"]) if repeated else out

    # nodes

    def children(self, rows: DataFrame, trees: int, rate: float) -> DataFrame:
        """(node, id) of the children that each (node, id, path) opens; the roots of the trees are nodes 0, 1, ..."""
        bound = np.uint64(min(rate, 1.0) * 2.0**64 * (1 - 1e-9))
        seeds = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = mix(np.arange(COORDS, dtype=np.uint64) + np.uint64(501))
            for batch in batches:
                if not batch.num_rows:
                    continue
                path = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDS).astype(np.uint64)
                above = np.asarray(batch.column(0)).view(np.uint64)
                who = np.asarray(batch.column(1))
                for seed in seeds:
                    child = mix((path * np.uint64(0x9E3779B97F4A7C15) + place) ^ mix(above ^ seed)[:, None])
                    r, c = np.nonzero(mix(child ^ np.uint64(0x5851F42D4C957F2D)) < bound)
                    yield pa.RecordBatch.from_arrays([pa.array(child[r, c].view(np.int64)), pa.array(who[r])], names=["node", "id"])

        return rows.select("node", "id", "path").mapInArrow(run, "node bigint, id bigint")

    def tiles(self, rows: DataFrame) -> DataFrame:
        """Proposed links (a < b) of rows (node, tile, id, comp, view): a spanning forest of each tile."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, edges in grouped(batches, 2):
                ids, comp = (table.column(k).to_numpy() for k in (2, 3))
                views = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(-1, COMPARED)
                out: set[tuple[int, int]] = set()
                for a, b in zip(edges, edges[1:], strict=False):
                    if b - a == 2:
                        found = [(0, 1)] if comp[a] != comp[a + 1] and agree(views[a], views[a + 1 : b])[0] >= least else []
                    else:
                        found = forest(views[a:b], comp[a:b], least) if b - a > 1 else []
                    out.update((int(min(ids[a + i], ids[a + j])), int(max(ids[a + i], ids[a + j]))) for i, j in found)
                yield _links(out)

        dealt = rows.repartition("node", "tile").sortWithinPartitions("node", "tile", "id")
        return dealt.select("node", "tile", "id", "comp", "view").mapInArrow(run, LINK)

    def exact(self, groups: DataFrame, fresh: DataFrame | None, found: DataFrame | None, sizes: DataFrame, sets: DataFrame) -> list[DataFrame]:
        """Confirmed links (a, b) within groups (id, component) of what resembles each other, settled.

        `fresh`: links proposed since the groups met last (None: all); only groups with one between different
        components meet. A group whose sets are too large for one task is cut into blocks. These first settle within
        themselves; then the blocks of its largest component meet all else in the group, if that fits one task, or
        all blocks meet pairwise.
        """
        known = groups.select("id", F.col("component").alias("group")).join(sizes, "id")
        if found is None:
            known = known.withColumn("comp", F.col("id"))
        else:
            known = known.join(found.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            ends = found.select("id", F.col("component").alias("c"))
            open_ = fresh.join(ends.toDF("a", "ca"), "a", "left").join(ends.toDF("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
            meeting = open_.select(F.col("a").alias("id")).join(groups, "id").select(F.col("component").alias("group")).distinct()
        volume = known.groupBy("group").agg(F.sum("n").alias("volume"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("texts")).where("c1 < c2")
        if found is not None:
            volume = volume.join(meeting, "group", "left_semi")
        known = settle(dealt_join(known, settle(volume.select("group", "volume", "texts")), "group", "texts").drop("texts"))
        count = F.ceil(F.col("volume") / VOLUME).cast("int")
        block = F.pmod(F.xxhash64("id"), count).cast("int")
        links = [settle(self._meet(known.select("group", block.alias("tile"), "id", "comp", F.lit(False).alias("main")), sets))]
        large = known.where(F.col("volume") > VOLUME)
        if large.limit(1).count():
            again = components(links[0] if found is None else links[0].union(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))
            large = large.drop("comp").join(again.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            each = large.groupBy("group", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
            tops = each.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("k").alias("texts")).where("comps > 1")
            tops = settle(tops.select("group", F.col("top.comp").alias("main_comp"), F.col("top.n").alias("main_n"), "texts"))
            large = dealt_join(large, tops, "group", "texts").withColumn("main", F.col("comp") == F.col("main_comp"))
            few = F.col("volume") - F.col("main_n") <= VOLUME
            whole = F.sequence(F.lit(0), count - 1)
            pair = F.transform(whole, lambda o: F.least(o, block) * count + F.greatest(o, block))
            tile = F.when(few & F.col("main"), F.array(block)).when(few, whole).otherwise(F.array_distinct(pair))
            tiled = settle(large.select("group", F.explode(tile).alias("tile"), "id", "comp", (F.col("main") & few).alias("main")))
            links.append(settle(self._meet(tiled, sets)))
        return links

    def _meet(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        least, percent = self.least, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, edges in grouped(batches, 2):
                ids, comp, main = (table.column(k).to_numpy() for k in (2, 3, 4))
                views = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, COMPARED)
                members = table.column(6)
                out: set[tuple[int, int]] = set()
                for a, b in zip(edges, edges[1:], strict=False):
                    if b - a > 1 and not main[a:b].all():
                        own = [members[k].values.to_numpy().view(np.uint64) for k in range(a, b)]
                        out.update((int(min(ids[a + i], ids[a + j])), int(max(ids[a + i], ids[a + j]))) for i, j in confirmed(comp[a:b], main[a:b], views[a:b], own, least, percent))
                yield _links(out)

        few = F.broadcast(rows) if rows.count() <= LISTED else rows
        dealt = sets.join(few, "id").repartition("group", "tile").sortWithinPartitions("group", "tile", "id")
        return dealt.select("group", "tile", "id", "comp", "main", "view", "members").mapInArrow(run, LINK)

    def to_pivot(self, rows: DataFrame) -> DataFrame:
        """Proposed links between (id, view) and the pivot of its node (pivot, pivot_view)."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                views, others = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COMPARED) for k in (2, 3))
                words = (views == others).view(np.uint64).sum(axis=1)
                near = ((words * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64) >= least
                a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                near &= a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near])], names=["a", "b"])

        return rows.select("id", "pivot", "view", "pivot_view").mapInArrow(run, LINK)

    def round(self, rows: DataFrame, found: DataFrame | None, reps: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Proposals of the tiles, those to pivots, and the rows (node, id) of the next round, if any.

        A node of up to SPLIT texts is one tile; one of up to `leaf` is cut into blocks that meet pairwise, so that no
        task reads a whole hot node; a larger one is cut into blocks of its largest component, each with all others, if
        those are few; else its texts meet a pivot outside that component and branch on.
        """
        known = rows if found is None else rows.join(found, "id", "left")
        known = known.select("node", "id", (F.coalesce("component", "id") if found is not None else F.col("id")).alias("comp"))
        each = known.groupBy("node", "comp").agg(F.count("*").alias("k"))
        sizes = each.groupBy("node").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
        sizes = settle(sizes.where("comps > 1").select("node", "size", F.col("top.comp").alias("main_comp"), (F.col("size") - F.col("top.k")).alias("others")))
        known = dealt_join(known, sizes, "node", "size").withColumn("main", F.col("comp") == F.col("main_comp"))

        def met(parts: Column) -> Column:
            """Pairs of blocks, each pair a tile: the tiles in which a row has to appear."""
            own = F.pmod(F.xxhash64("id"), parts).cast("int")
            return F.array_distinct(F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.least(o, own) * parts + F.greatest(o, own)))

        count = F.ceil(F.col("size") / self.leaf).cast("int")
        block = F.pmod(F.xxhash64("id"), count).cast("int")
        few = F.col("others") <= self.leaf
        fine = F.ceil(F.col("size") / SPLIT).cast("int")
        tile = F.when(F.col("size") <= min(self.leaf, SPLIT), F.array(F.lit(0))).when(F.col("size") <= self.leaf, met(fine))
        tile = tile.when(few & F.col("main"), F.array(block)).when(few, F.sequence(F.lit(0), count - 1))
        if last:  # exhaustive, for whatever no branching has parted
            tile = tile.otherwise(met(count))
        tiled = known.select("node", F.explode(tile).alias("tile"), "id", "comp")
        ids = rows.select("id").distinct()
        proposed = self.tiles(tiled.join(listed(reps.select("id", "view"), ids, ids.count()), "id"))
        if last or not sizes.where((F.col("size") > self.leaf) & ~few).limit(1).count():
            return proposed, None, None
        big = settle(known.where((F.col("size") > self.leaf) & ~few))
        ids = big.select("id").distinct()
        big = settle(big.join(listed(reps, ids, ids.count()), "id"))
        pivots = big.where(~F.col("main")).groupBy("node").agg(F.min_by(F.struct("id", "view"), "id").alias("p"), F.first("size").alias("texts"))
        pivots = settle(pivots.select("node", F.col("p.id").alias("pivot"), F.col("p.view").alias("pivot_view"), "texts"))
        return proposed, self.to_pivot(dealt_join(big, pivots, "node", "texts")), self.children(big, 1, 2 * self.branch)

    def run(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """key, n_shingles, component_id, kept: one row per row of `df`; see `near_duplicates`."""
        profiles = settle(self.profiles(df, key, text))
        whole = profiles.where("n > 0 and id is not null")
        repeated = whole.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() > 0
        # equal sets have equal sketches, so any of them will do
        same = whole.groupBy("i1", "i2", "n").agg(F.min("id").alias("rep"), F.first("path").alias("path"), F.first("view").alias("view"))
        classes = settle(same)
        reps = classes.select(F.col("rep").alias("id"), "n", "path", "view")
        if repeated:  # a document with several texts may stand for several sets
            reps = settle(reps.dropDuplicates(["id", "view"]))
        sizes = reps.groupBy("id").agg(F.sum("n").alias("n")) if repeated else reps.select("id", "n")
        first = self.children(reps.withColumn("node", F.lit(0).cast("bigint")), self.trees, self.branch)
        shared = settle(first.groupBy("node").agg(F.count("*").alias("k")).where("k > 1"))
        rows: DataFrame | None = settle(dealt_join(first, shared, "node", "k").drop("k"))
        drop_settled(shared)
        proposed: DataFrame | None = None
        links: DataFrame | None = None
        found: DataFrame | None = None
        sets: DataFrame | None = None
        for depth in range(self.depth + 1):
            if rows is None:
                break
            tiled, pivots, onward = self.round(rows, found, reps, depth == self.depth)
            pairs = settle(tiled if pivots is None else tiled.union(pivots))
            proposed = pairs if proposed is None else pairs.union(proposed)
            groups = components(proposed)
            new = groups.select("id") if sets is None else groups.select("id").join(sets.select("id").distinct(), "id", "left_anti")
            more = settle(self.sets(df, new, key, text, repeated))
            sets = more if sets is None else sets.union(more)
            for part in self.exact(groups, pairs, found, sizes, sets):
                links = part if links is None else links.union(part)
            found = components(links)
            rows = None if onward is None else settle(onward)
        out = profiles.select("id", "n", "i1", "i2").join(classes.select("i1", "i2", "n", "rep"), ["i1", "i2", "n"], "left")
        rep = F.coalesce("rep", "id")
        if found is not None:
            out = out.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
            rep = F.coalesce("component", rep)
        return out.select(
            F.col("id").cast(dict(df.dtypes)[key]).alias(key), F.col("n").alias("n_shingles"), rep.cast(dict(df.dtypes)[key]).alias("component_id"), (rep == F.col("id")).alias("kept")
        )


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = 4, **options: int) -> DataFrame:
    """Components of texts whose shingle sets overlap by `percent` (100 * intersection >= percent * union).

    Words are runs of visible characters, A-Z lower-cased; a set holds the distinct shingles of `width` words, or the
    whole text as one if it has fewer. Returns per row: key, n_shingles, component_id (smallest key reachable over
    links), kept (key = component_id). Equal sets are one text for the join. Texts without words, or null, are linked
    with nothing and kept; repeated rows share their component; a null key keeps its row and links nothing; an empty
    table gives an empty one; other columns are left out. Links are confirmed on full sets; a pair at the bound
    meets in some node of `trees` trees with probability of about 1 - exp(-trees).
    Intermediate tables (sketches, nodes, links, sets of candidates) are written to the shared folder. The key must be
    a whole number.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be a whole number")
    return ChosenPath(percent, width, **options).run(df, key, text)


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, **options: int) -> DataFrame:
    """The rows of `df`, all columns, of which one per component stays: that with the smallest key."""
    gone = near_duplicates(df, key, text, percent, width, **options).where("not kept").select(F.col(key).alias("_gone")).distinct()
    gone = settle(gone)
    if gone.count() <= LISTED:
        return df.join(F.broadcast(gone), df[key] == gone["_gone"], "left_anti")
    return df.join(gone, df[key] == gone["_gone"], "left_anti")
