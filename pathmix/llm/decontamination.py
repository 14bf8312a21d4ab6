"""Benchmark decontamination: suffix arrays over shards of the documents, searched with every suffix of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, flat, mix, numbered, pieces

#: Bytes of item text in one block of the test set; each block is broadcast by itself, so its size is bounded.
BLOCK_BYTES = 4 << 20
#: Bytes of document text in one shard: one suffix array.
SHARD_BYTES = (1 << 20) - 1

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


@dataclass
class Block:
    """Windows of some items: big-endian word hashes as byte strings, and where each window occurs in the items."""

    width: int
    low: np.ndarray  # S(8 * width): the window, padded with zeros
    high: np.ndarray  # the last key that begins with the window
    size: np.ndarray  # words of each window
    owners: list[np.ndarray]  # for each window its rows (item number, first word)
    items: np.ndarray  # item number -> id
    ones: np.ndarray  # bit maps of the windows' first word and first pair of words
    pairs: np.ndarray


BITS = 20


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of hashes as byte strings that sort like the rows."""
    return np.ascontiguousarray(matrix.astype(">u8")).view(f"S{8 * matrix.shape[1]}").ravel()


def build(ids: list, texts: list[str | None], width: int) -> Block:
    data, at = flat(pa.array(texts, pa.string()))
    words = Words(data, at, 0, len(texts), IS_WORD)
    owners: dict[bytes, list[tuple[int, int]]] = {}
    for i in range(len(texts)):
        own = words.hash[words.first[i] : words.first[i + 1]]
        for q in range(max(1, len(own) - width + 1) if len(own) else 0):
            owners.setdefault(own[q : q + width].astype(">u8").tobytes(), []).append((i, q))
    found = sorted(owners)
    size = np.array([len(k) // 8 for k in found], np.int64)
    ones, pairs = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, bool)
    for key in found:
        head = np.frombuffer(key[:16], ">u8").astype(np.uint64)
        if len(head) == 1:
            ones[_slot(head)] = True
        else:
            pairs[_slot(_pair(head[:1], head[1:]))] = True
    kind = f"S{8 * width}"
    low = np.array(found, kind) if found else np.zeros(0, kind)
    high = np.array([k + b"\xff" * (8 * width - len(k)) for k in found], kind) if found else np.zeros(0, kind)
    return Block(width, low, high, size, [np.array(owners[k], np.int64) for k in found], np.array(ids, object), ones, pairs)


def search(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the block's windows among the words of one shard: (word position, window number).

    The shard's suffix array holds the suffixes that begin like some window (by its first word or pair); the others
    can't match. Suffixes end with their document. Both ends of each test suffix are found by binary search.
    """
    h, n = words.hash, len(words.hash)
    if not n or not len(block.low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = words.first[1:][words.row]  # end of each word's document
    maybe = block.ones[_slot(h)]
    if n > 1:
        maybe[:-1] |= block.pairs[_slot(_pair(h[:-1], h[1:]))]
    suffixes = np.flatnonzero(maybe)
    if not len(suffixes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = suffixes[:, None] + np.arange(block.width)
    matrix = h[np.minimum(place, n - 1)]
    matrix[place >= last[suffixes][:, None]] = 0
    keys = _keys(matrix)
    order = np.argsort(keys, kind="stable")
    keys, suffixes = keys[order], suffixes[order]
    lo = np.searchsorted(keys, block.low, "left")
    hi = np.searchsorted(keys, block.high, "right")
    many = hi - lo
    window = np.repeat(np.arange(len(block.low)), many)
    at = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
    return suffixes[at], window


def maximal(words: Words, block: Block, at: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Longest verbatim matches: (row, item number, first word in the document, first word in the item, words)."""
    if not len(at):
        return []
    times = np.array([len(o) for o in block.owners])[window]
    p = np.repeat(at, times)
    own = np.concatenate([block.owners[w] for w in window])
    item, q, size = own[:, 0], own[:, 1], np.repeat(block.size[window], times)
    order = np.lexsort((p, p - q, item))
    p, q, item, size = p[order], q[order], item[order], size[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1) | (words.row[p[1:]] != words.row[p[:-1]])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(p)) - 1
    row = words.row[p[heads]]
    return list(zip(row.tolist(), item[heads].tolist(), (p[heads] - words.first[row]).tolist(), q[heads].tolist(), (p[tails] + size[tails] - p[heads]).tolist(), strict=True))


def blocks(benchmark: DataFrame, width: int, key: str, text: str) -> list:
    """The test set as broadcast blocks of bounded size; the driver holds one block at a time."""
    sc, out = benchmark.sparkSession.sparkContext, []
    ids: list = []
    texts: list = []
    held = 0

    def close() -> None:
        if ids:
            out.append(sc.broadcast(build(ids, texts, width)))

    for r in benchmark.select(key, text).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        held += len((r[1] or "").encode())
        if held >= BLOCK_BYTES:
            close()
            ids, texts, held = [], [], 0
    close()
    return out


def _scan(tests: list, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[set], list[list]]]:
    """For each shard of a batch: first row, words and hit words of each document, its items, its longest matches."""
    data, at = flat(column)
    for i, j in pieces(at, SHARD_BYTES):
        words = Words(data, at, i, j, IS_WORD)
        edge = np.zeros(len(words.hash) + 1, np.int32)
        items: list[set] = [set() for _ in range(i, j)]
        longest: list[list] = [[] for _ in range(i, j)]
        for held in tests:
            block = held.value
            p, w = search(words, block)
            np.add.at(edge, p, 1)
            np.add.at(edge, p + block.size[w], -1)
            for r, k, a, b, n in maximal(words, block, p, w):
                items[r].add(block.items[k])
                longest[r].append((block.items[k], a, b, n))
            if len(tests) > 1:
                del held._value  # a worker keeps one block
        hit = np.cumsum(edge[:-1]) > 0
        yield i, np.diff(words.first), np.bincount(words.row[hit], minlength=j - i), items, longest


def scan(df: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """For each document: key, n_words, n_hit, n_items, items_sha256, contaminated, longest, matches.

    Words are runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII. A window is `width`
    consecutive words of an item, or the whole item if shorter; a document word inside any occurrence is hit.
    `matches` lists the longest verbatim matches (item, word positions in document and item, words); `longest` is
    the largest of their lengths. Words are compared by 64-bit hashes, windows by the sequence of these.
    Null or empty texts have no words, items without words no windows; repeated rows give repeated results, repeated
    items count by id; an empty test set hits nothing; other columns are left out. Nothing is shuffled; each task
    sorts suffixes of one bounded shard at a time, or of one document if that is longer.
    """
    tests = blocks(benchmark, width, item_key, text)
    kinds = dict(benchmark.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for _, n_words, n_hit, items, longest in _scan(tests, batch.column(1)):
                for values, more in zip(
                    out,
                    (
                        n_words.tolist(), n_hit.tolist(), [len(s) for s in items],
                        [hashlib.sha256(",".join(sorted(map(str, s))).encode()).hexdigest() for s in items],
                        (n_hit > 0).tolist(), [max((m[3] for m in rows), default=0) for rows in longest],
                        [[dict(zip(("item", "doc_word", "item_word", "words"), m, strict=True)) for m in rows] for rows in longest],
                    ),
                    strict=True,
                ):
                    values += more
            arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[item_key]]
            match = pa.list_(pa.struct([("item", arrow), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), match)
            columns = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "matches"])

    schema = (
        f"`{key}` {dict(df.dtypes)[key]}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, "
        f"matches array<struct<item: {kinds[item_key]}, doc_word: bigint, item_word: bigint, words: bigint>>"
    )
    return df.select(key, text).mapInArrow(run, schema)


def remove(df: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of `df`, all columns, without the documents that hold any window of the test items.

    Null and empty texts stay, repeated rows stay or go together, an empty test set removes nothing, an empty table
    stays empty; columns may bear any names, as they are addressed by place.
    """
    tests = blocks(benchmark, width, item_key, text)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [n == 0 for _, _, n_hit, _, _ in _scan(tests, batch.column(at)) for n in n_hit]
            yield batch.filter(pa.array(clean, pa.bool_()))

    rows = numbered(df)
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)
