"""Word-level byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

#: Words and token pairs of one generation of a worker's memory, and a word's length. A full generation becomes the old
#: one; what is used again moves on, so frequent words stay and at most two generations are held.
MEMORY_WORDS, MEMORY_PAIRS, MEMORY_LENGTH = 150_000, 150_000, 48
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Fixed values of the tokenizer format: what a text is split into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters on which all Unicode versions in use agree; texts with others are split by the library's own tables.
RARE = (
    r"[^\u0000-\u0530\u0e00-\u0e7f\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u23ff\u2500-\u27bf\u3000-\u30ff"
    r"\u3400-\u4db5\u4e00-\u9fea\uac00-\ud7a3\uff00-\uff5e\U0001f300-\U0001f64f]"
)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file.

    A word is a string of units: its bytes, the last one marked as word end. Tokens are such strings too. A token
    sequence is what the merges give exactly when every neighbouring pair is compatible: no merge across their
    border would have been done before both were whole. So the encoder takes the longest token, checks it against
    its left neighbour, tries shorter ones, and steps back where none fits; each end position fails at most once,
    which makes the work linear in the word's length.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        unit = {letter: chr(b) for b, letter in enumerate(_byte_letters())}

        def units(token: str) -> str:
            whole = suffix and token.endswith(suffix) and token != suffix
            body = "".join(unit[c] for c in (token[: -len(suffix)] if whole else token))
            return body[:-1] + chr(ord(body[-1]) + 256) if whole else body

        self.ids = {units(t): i for t, i in vocab.items()}
        self.rank = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            # a word-end mark belongs to the right part alone
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank[both] = r
            self.parts[both] = (left, right)
            self.joined[left, right] = both
        self.length = {i: len(u) for u, i in self.ids.items()}
        self.shorter: dict[int, int] = {}
        for u, i in self.ids.items():
            for n in range(len(u) - 1, 0, -1):
                if (p := self.ids.get(u[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.matches = ahocorasick.Automaton()
        for u, i in self.ids.items():
            self.matches.add_word(u, (len(u), i))
        self.matches.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(PIECES)
        self.rare = regex.compile(RARE)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.unit = {letter: b for b, letter in enumerate(_byte_letters())}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        strings = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.fits: dict[tuple[int, int], bool] = {}
        self.old_fits: dict[tuple[int, int], bool] = {}
        self.memory = _Memory(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether `left`, `right` side by side is what the merges make of their joint text."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.old_fits.get((left, right))
            if known is None:
                known = self._compatible(left, right)
            if len(self.fits) >= MEMORY_PAIRS:
                self.fits, self.old_fits = {}, self.fits
            self.fits[left, right] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges latest first. A merge across the border that ranks before the one undone last would have come
        # first. Of equal merges the left one is done first, so for undoing, the right one counts as later.
        limit = 1 << 60
        while True:
            both = self.joined.get((left, right))
            if both is not None and 2 * self.rank[both] + 1 < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = 2 * a + 1, self.parts[left][1]
            else:
                limit, right = 2 * b + 2, self.parts[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        units = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        if (whole := self.ids.get(units)) is not None and self._reachable(whole):
            return [whole]
        longest = [0] * len(units)
        found = [-1] * len(units)
        for end, (n, token) in self.matches.iter(units):
            at = end - n + 1
            if n > longest[at]:
                longest[at], found[at] = n, token
        open_end = bytearray(b"\x01") * (len(units) + 1)
        tokens: list[int] = []
        at, token = 0, found[0]
        while True:
            while token is not None:
                end = at + self.length[token]
                if open_end[end] and (not tokens or self.compatible(tokens[-1], token)):
                    break
                token = self.shorter.get(token)
            if token is None:
                open_end[at] = 0
                token = tokens.pop()
                at -= self.length[token]
                continue
            tokens.append(token)
            at = end
            if at == len(units):
                return tokens
            token = found[at]

    @lru_cache(1 << 16)  # noqa: B019  one object per vocabulary file and worker
    def _reachable(self, token: int) -> bool:
        """Whether the merges turn the token's text into the token itself."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        return self._reachable(left) and self._reachable(right) and self._merges_to(token, left, right)

    def _merges_to(self, token: int, left: int, right: int) -> bool:
        limit = 2 * self.rank[token] + 1
        while True:
            both = self.joined.get((left, right))
            if both is not None and both != token and 2 * self.rank[both] + 1 < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = min(limit, 2 * a + 1), self.parts[left][1]
            else:
                limit, right = min(limit, 2 * b + 2), self.parts[right][0]

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers. Null: none."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        out = []
        for part in self.cut.split(text):
            out.append(int(self.special[part]).to_bytes(4, "little") if part in self.special else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if self.rare.search(text):
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return b"".join(self.memory[bytes(self.unit[c] for c in w).decode()] for w, _ in words)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-cased letter by letter: no final sigma
            text = text.replace("Σ", "σ")
        return b"".join(map(self.memory.__getitem__, self.split.findall(text.lower())))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, one blank between neighbours, gathered through the offset table."""
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - size), size)
        return self.text[take].tobytes()[:-1]


class _Memory(dict):
    """Encoded words by word; bounded."""

    def __init__(self, coder: WordBpe):
        super().__init__()
        self.coder = coder
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.coder.encode_word(word.encode())).tobytes() if LITTLE else np.array(self.coder.encode_word(word.encode()), "<u4").tobytes()
        if len(word) <= MEMORY_LENGTH:
            if len(self) >= MEMORY_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


_CODERS: dict[str, WordBpe] = {}


def coder(name: str) -> WordBpe:
    """The coder of a vocabulary file, given as its path or its name in the public collection; one per process."""
    path = name if "/" in name else public_tokenizers.path(name)
    if path not in _CODERS:
        _CODERS[path] = WordBpe(str(path))
    return _CODERS[path]


def encode_decode(df: DataFrame, vocabulary: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; returns key, n_tokens, ids_sha256, decoded_sha256 (and ids with `with_ids`).

    ids are those of the tokenizers library without special tokens added; special tokens spelt out in a text count
    as such, as they do there. Null and empty texts have no tokens and the digest of no bytes. One row per input
    row, repeated or not; other columns are left out; nothing is shuffled. A worker holds one batch of texts, the
    vocabulary and a bounded word memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for value in batch.column(1):
                raw = c.encode(value.as_py())
                ids = np.frombuffer(raw, "<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(raw).hexdigest())
                sha = hashlib.sha256()
                for k in range(0, len(ids), 1 << 16):
                    sha.update((b" " if k else b"") + c.decode(ids[k : k + (1 << 16)]))
                decoded.append(sha.hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return df.select(key, text).mapInArrow(run, schema)
