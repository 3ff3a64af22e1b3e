"""Byte-pair encoding and decoding with word-end vocabularies.

A text is normalised (NFC, lower case), split into words by the vocabulary
file's pattern, and every word becomes its ranked pieces.  A word's state is
one contiguous array of parts with the rank of every adjacent pair beside it:
the minimum is found by scanning, one boundary is deleted and the two
neighbouring ranks are refreshed.  The new words of a batch of texts are
scanned side by side, one column each (``_scan_all``); words over ``WIDTHS``
or few at a time are scanned alone.  Words over ``LONG_WORD`` symbols, for
which scanning would be quadratic, keep the same ranks in a heap instead; the
result is the same.  Words repeat, so each batch encodes a word once, and each
Python worker remembers a bounded number of encoded words.

The vocabulary is read on the driver and shipped as a broadcast of fixed size
(one entry per merge of the file), so executors need no copy of the file.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, fresh, once

LONG_WORD = 256
#: Encoded words that a worker remembers, and as many that it remembered before; all words of its last two batches, if they are more.
KNOWN = 25_000
#: Bytes of the words that are scanned side by side, by the columns' length; fewer words than ``FEW`` of one length are scanned alone.
WIDTHS, FEW = (8, 16, 32, 64), 32
#: Words scanned side by side at most.
ABREAST = 16_384
_NONE = 1 << 60
#: The rank of pairs that do not merge, in arrays.
_NO_PAIR = (1 << 31) - 1


class _Ranks:
    """Ranks of whole arrays of pairs: a table of keys with free slots, in which a key stands at its hash or in the next slots."""

    def __init__(self, rank: dict[int, int]):
        bits = max(4, (4 * len(rank)).bit_length())
        self.down, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NO_PAIR, np.int32)
        keys, values = np.fromiter(rank.keys(), np.int64, len(rank)), np.fromiter(rank.values(), np.int32, len(rank))
        slots = self._slots(keys)
        while keys.size:
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``_NO_PAIR`` for pairs that do not merge, as those with -1."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        there, found = self.keys[slots], self.values[slots]
        other = np.flatnonzero(there != keys)
        found[other] = _NO_PAIR
        other = other[there[other] != -1]
        while other.size:
            slots[other] = (slots[other] + 1) & self.mask
            there = self.keys[slots[other]]
            same = other[there == keys[other]]
            found[same] = self.values[slots[same]]
            other = other[(there != keys[other]) & (there != -1)]
        return found


@cache
def _byte_symbols() -> list[str]:
    """The printable character standing for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class _Words:
    """Packed ids of the words met lately: a full memory becomes the old one, from which words still met return."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int):
        self.make, self.most, self.last, self.old = make, most, {}, {}

    def __len__(self) -> int:
        return len(self.last)

    def all(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids by word, of these words and maybe of others; words over 64 characters are not remembered."""
        new = words.difference(self.last)
        if len(self.last) + len(new) > self.most:
            self.last, self.old, new = {}, self.last, words
        again = self.old.keys() & new
        self.last.update(zip(again, map(self.old.__getitem__, again)))
        new = list(new - again)
        made = zip(new, self.make(new))
        if max(map(len, new), default=0) <= 64:
            self.last.update(made)
            return self.last
        found = self.last | dict(made)
        self.last.update((word, found[word]) for word in new if len(word) <= 64)
        return found


class WordBpe:
    """Encoder and decoder of one vocabulary file (tokenizers JSON, BPE model with word ends)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a] << 32) | self.vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        symbols = _byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        import regex

        # The file's own pattern; white space as Unicode defines it.
        space = r"\t-\r \x85\xa0  -     　"
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{space}\p{{L}}\p{{N}}]+").findall
        # The same for lower-case ASCII; what begins with a letter or digit comes first, as no other branch takes it.
        self.ascii_words = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r a-z0-9]+").findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known = _Words(self._packed, KNOWN)
        self.ranks = _Ranks(self.rank)
        self.of_rank, self.of_inner, self.of_last = (np.array(a, np.int32) for a in (self.merged, self.inner, self.last))

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self._scan(parts) if len(parts) <= LONG_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get = self.rank.get
        ranks = [get((a << 32) | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = self.merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i] << 32) | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get((parts[i - 1] << 32) | parts[i], _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        get, n = self.rank.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        at = [(r, i) for i in range(n - 1) if (r := get((parts[i] << 32) | parts[i + 1])) is not None]
        heapq.heapify(at)
        while at:
            r, i = heapq.heappop(at)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or get((parts[i] << 32) | parts[j]) != r:
                continue  # one of the two parts has changed since
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := get((parts[i] << 32) | parts[after[j]])) is not None:
                    heapq.heappush(at, (q, i))
            if (h := before[i]) >= 0 and (q := get((parts[h] << 32) | parts[i])) is not None:
                heapq.heappush(at, (q, h))
        return [p for p in parts if p >= 0]

    def _scan_all(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of words of up to ``width`` bytes: ``_scan`` of all of them at once.

        A word is a column of parts, with -1 below its end and in the last
        row; the rank of a pair stands beside its first part.  A deleted
        boundary moves up what is below it, so a step takes a row from all.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.array(words, f"S{width}").view(np.uint8).reshape(-1, width).T
        row = np.arange(width + 1, dtype=np.int32)[:, None]
        parts = np.full((width + 1, len(words)), -1, np.int32)
        parts[:-1] = np.where(row[:-1] < n - 1, self.of_inner[raw], np.where(row[:-1] == n - 1, self.of_last[raw], -1))
        ranks = np.full(parts.shape, _NO_PAIR, np.int32)
        ranks[:-1] = self.ranks.of(parts[:-1].ravel(), parts[1:].ravel()).reshape(width, -1)
        word, packed = np.arange(len(words)), [b""] * len(words)
        while word.size:
            i, column = ranks.argmin(axis=0), np.arange(word.size)
            best = ranks[i, column]
            more = best != _NO_PAIR
            if not more.all():
                done = parts[:, ~more].T
                ids, ends = done[done >= 0].astype("<u4").tobytes(), np.cumsum((done >= 0).sum(axis=1) * 4).tolist()
                for w, a, b in zip(word[~more].tolist(), [0, *ends], ends):
                    packed[w] = ids[a:b]
                parts, ranks, word, i, best, column = parts[:, more], ranks[:, more], word[more], i[more], best[more], column[: np.count_nonzero(more)]
            kept = row[: len(parts) - 1] <= i.astype(np.int32)
            parts, ranks = np.where(kept, parts[:-1], parts[1:]), np.where(kept, ranks[:-1], ranks[1:])
            parts[i, column] = part = self.of_rank[best]
            ranks[i, column] = self.ranks.of(part, parts[i + 1, column])
            ranks[i - 1, column] = self.ranks.of(parts[i - 1, column], part)  # before the first part: the last row, which holds none
        return packed

    def _packed(self, words: list[str]) -> list[bytes]:
        """Packed ids of every word."""
        raw = list(map(str.encode, words))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        packed: list[bytes] = [b""] * len(words)
        alone = size > WIDTHS[-1]
        for least, width in zip((0, *WIDTHS), WIDTHS):
            chosen = (size > least) & (size <= width)
            if (n := np.count_nonzero(chosen)) < FEW:
                alone |= chosen
                continue
            at = np.flatnonzero(chosen).tolist()
            for k in range(0, n, ABREAST):
                for i, ids in zip(at[k : k + ABREAST], self._scan_all([raw[i] for i in at[k : k + ABREAST]], width)):
                    packed[i] = ids
        for i in np.flatnonzero(alone).tolist():
            packed[i] = struct.pack(f"<{len(ids := self.word(words[i]))}I", *ids)
        return packed

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.ascii_words(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter on its own: no final sigma
        return self.words(text.lower())

    def _pieces(self, text: str | None) -> list[list[str] | bytes]:
        """A text's special tokens, packed, and the words between them."""
        if not text:
            return []
        if self.cut is None or not any(t in text for t in self.special):
            return [self.split(text)]
        return [self.special[p].to_bytes(4, "little") if p in self.special else self.split(p) for p in self.cut.split(text) if p]

    def _joined(self, texts: list[list[list[str] | bytes]]) -> list[bytes]:
        of = self.known.all(set().union(*(p for pieces in texts for p in pieces if isinstance(p, list)))).__getitem__
        return [b"".join([b"".join(map(of, p)) if isinstance(p, list) else p for p in pieces]) for pieces in texts]

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        return self._joined([[self.split(text)]])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; null counts as empty."""
        return self._joined([self._pieces(t) for t in texts])

    def encode(self, text: str | None) -> bytes:
        """``encode_all`` of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The tokens of ``ids`` joined by spaces (the file names no decoder); unknown ids are left out."""
        get = self.tokens.get
        return " ".join([t for i in ids if (t := get(i)) is not None])


def load(path: str) -> dict:
    """The parsed vocabulary file (driver side)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _parsed(raw: bytes) -> WordBpe:
    return WordBpe(json.loads(raw))


class Coder:
    """Column functions of one vocabulary, whose file is broadcast once; workers keep no parsed copy of it beside their tables."""

    def __init__(self, spark: SparkSession, path: str):
        bounded_batches(spark)
        self.shared = spark.sparkContext.broadcast(Path(path).read_bytes())

    def encode(self, text: Column) -> Column:
        """Packed ids (binary, little-endian unsigned 32-bit) of whole texts."""
        shared = self.shared

        @arrow_udf("binary")
        def packed(texts: pa.Array) -> pa.Array:
            return pa.array(once(_parsed, shared.value).encode_all(t.as_py() for t in texts), pa.binary())

        return packed(text)

    def decode(self, ids: Column) -> Column:
        """Texts of packed ids."""
        shared = self.shared

        @arrow_udf("string")
        def texts(packed: pa.Array) -> pa.Array:
            of = once(_parsed, shared.value).decode
            return pa.array([of(np.frombuffer(b.as_py() or b"", dtype="<u4").tolist()) for b in packed], pa.string())

        return texts(ids)

    def round_trip(self, text: Column) -> Column:
        """struct(ids, decoded) of whole texts, by one Python worker instead of two."""
        shared = self.shared

        @arrow_udf("struct<ids:binary,decoded:string>")
        def both(texts: pa.Array) -> pa.Array:
            of = once(_parsed, shared.value)
            ids = of.encode_all(t.as_py() for t in texts)
            decoded = [of.decode(np.frombuffer(i, dtype="<u4").tolist()) for i in ids]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

        return both(text)


def unpack(packed: Column) -> Column:
    """Packed ids as array<int>."""
    digits = F.hex(packed)
    at = lambda i, k: F.substring(digits, i * 8 + 1 + 2 * k, F.lit(2))
    number = lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("int")
    n = (F.octet_length(packed) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<int>"))


def encode(df: DataFrame, coder: Coder, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the packed ids of every whole text.

    Null and empty texts give empty ids.  Repeated rows give repeated rows,
    other columns pass through; a column already named ``ids`` is replaced.
    """
    return df.withColumn(ids, coder.encode(F.col(text)))


def decode(df: DataFrame, coder: Coder, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the decoded text of packed ids; null and empty ids give an empty text."""
    return df.withColumn(text, coder.decode(F.col(ids)))


def round_trip(df: DataFrame, coder: Coder, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds the packed ids and the text decoded from them."""
    made = fresh("_coded", df.columns)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    coded = df.select(*kept, coder.round_trip(F.col(text)).alias(made))
    return coded.select(*kept, F.col(f"{made}.ids").alias(ids), F.col(f"{made}.decoded").alias(decoded))
