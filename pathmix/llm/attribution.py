"""Token counts of sections: documents are encoded once, and token spans are joined to section spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: How a token that crosses a border is allocated.
RULES = ("most", "first", "share")


class Spans:
    """A byte-level vocabulary that gives ids and the character span of each token."""

    def __init__(self, name: str):
        path = name if "/" in name else public_tokenizers.path(name)
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and for each the first code point it touches and the one after the last it touches."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        end = np.cumsum(self.size[ids])
        start = end - self.size[ids]
        if not text.isascii():
            point = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
            start, end = point[start], point[end - 1] + 1
        return ids, start, end


def allocate(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section [low, high), and how many tokens cross a border.

    Tokens and sections are each in order; sections don't overlap. Rules: `first`, the section that holds the
    token's first character; `most`, the one that holds most of its characters, the earlier of equals; `share`,
    each section in proportion to the characters it holds. A token outside all sections counts nowhere.
    """
    total = np.zeros(len(low))
    if not len(start) or not len(low):
        return total, 0
    a = np.searchsorted(high, start, "right")  # first section that ends after the token's start
    b = np.searchsorted(low, end, "left") - 1  # last section that begins before its end
    whole = (a == b) & (low[np.minimum(a, len(low) - 1)] <= start) & (end <= high[np.maximum(b, 0)])
    total += np.bincount(a[whole], minlength=len(low))
    crossing = np.flatnonzero(~whole & (a <= b))
    for t in crossing:
        held = {s: int(min(end[t], high[s]) - max(start[t], low[s])) for s in range(int(a[t]), int(b[t]) + 1)}
        held = {s: n for s, n in held.items() if n > 0}
        if rule == "share":
            for s, n in held.items():
                total[s] += n / int(end[t] - start[t])
        elif rule == "first":
            for s in held:
                total[s] += low[s] <= start[t] < high[s]
        elif held:
            total[max(held, key=lambda s: (held[s], -s))] += 1
    return total, len(crossing)


_SPANS: dict[str, Spans] = {}


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Each line with the line feed that ends it; a text that ends in one has no empty line after it."""
    ends, at = [], -1
    while (at := text.find("\n", at + 1)) >= 0:
        ends.append(at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    high = np.array(ends, np.int64)
    return np.concatenate([[0], high[:-1]]), high


def attribute(
    df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", key: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "most"
) -> DataFrame:
    """Tokens of each section of each whole text: key, section (from 0), start, end (code points), n_tokens,
    n_crossing (of the whole text's tokens, how many cross a border), doc_tokens (of the whole text).

    `sections` names a column of array<struct<start, end>>, ordered and without overlap; without it the sections
    are the text's lines. n_tokens is bigint, or double under rule `share`. Under `most` and `first` with sections
    that cover the text, a text's n_tokens add up to doc_tokens. Null and empty texts have one section of no tokens
    (none if `sections` is given and empty or null); repeated rows give repeated results; other columns are left
    out. Nothing is shuffled: each text is encoded where it is read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = "double" if rule == "share" else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _SPANS:
            _SPANS[vocabulary] = Spans(vocabulary)
        coder = _SPANS[vocabulary]
        for batch in batches:
            out: list[tuple] = []
            rows, held = [], 0
            for r, value in enumerate(batch.column(1)):
                body = value.as_py() or ""
                if sections is None:
                    low, high = _lines(body)
                else:
                    given = batch.column(2)[r].as_py() or []
                    low, high = (np.array([s[k] for s in given], np.int64) for k in ("start", "end"))
                ids, start, end = coder.spans(body)
                total, crossing = allocate(start, end, low, high, rule)
                out.append((low, high, total, np.full(len(low), crossing), np.full(len(low), len(ids))))
                rows.append(np.full(len(low), r))
                held += len(low)
                if held >= 100_000:
                    yield _table(batch, rows, out, key, kind)
                    out, rows, held = [], [], 0
            if out:
                yield _table(batch, rows, out, key, kind)

    columns = [key, text] + ([sections] if sections else [])
    schema = f"`{key}` {dict(df.dtypes)[key]}, section int, start bigint, end bigint, n_tokens {kind}, n_crossing bigint, doc_tokens bigint"
    return df.select(*columns).mapInArrow(run, schema)


def _table(batch: pa.RecordBatch, rows: list[np.ndarray], out: list[tuple], key: str, kind: str) -> pa.RecordBatch:
    low, high, total, crossing, whole = (np.concatenate(c) for c in zip(*out, strict=True))
    section = np.concatenate([np.arange(len(r), dtype=np.int32) for r in rows])
    ids = batch.column(0).take(pa.array(np.concatenate(rows)))
    counts = pa.array(total if kind == "double" else total.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(section), pa.array(low), pa.array(high), counts, pa.array(crossing.astype(np.int64)), pa.array(whole.astype(np.int64))],
        names=[key, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
    )
