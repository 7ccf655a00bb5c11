"""Packing token sequences into windows by best-fit decreasing.

A document's ids are first cut into full windows and a rest. The rests, longest first, go to the open window in which the
least room stays; a segment tree over the remaining capacities finds it. Packing is done in groups of pieces that are
dealt by hash, so that no task sees more than a bounded number of pieces; the windows of a group are full but for a few.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import durable

from .common import process_cache, with_text_columns

#: Bytes that a worker remembers of pieces, with about so many for each entry besides its strings.
MEMO_BYTES, ENTRY_BYTES = 128 << 20, 200
#: White space as Unicode and the tokenizers define it; Python's own ``split`` has four control characters more.
EXTRA_SPACE = "\x1c\x1d\x1e\x1f"
#: Marks that the vocabulary's pattern parts from the letters before them.
MARKS = ".,;:"
#: The pattern by which the vocabulary parts normalized text, and the same for lower-cased Latin-1 text, where it is exact:
#: such text is in normal form C, and its letters, numbers and white space are these.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
_SUFFIX = "</w>"


class WordIds:
    """Ids of the pieces of texts as little-endian 32-bit numbers.

    The vocabulary drops white space and no token crosses it, so that a text's ids are those of its pieces in a row. Where
    the vocabulary has the known pattern, pieces of Latin-1 texts are its words, lower-cased, so that a word has one entry in
    whatever case and before whatever mark; other texts are cut at white space, and letters before a mark stand for themselves.
    New pieces of some texts are encoded together, each once. What is remembered is bounded in bytes and begun anew when it is full.
    """

    def __init__(self, vocabulary: str, most_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most_bytes = most_bytes
        self.ids: dict[str, bytes] = {}
        self.size = 0
        told = json.loads(self.tokenizer.to_str())
        steps = [n.get("type") for n in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = steps == ["NFC", "Replace", "Lowercase"] and cuts == [PATTERN, None] and told["model"].get("end_of_word_suffix") == _SUFFIX
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token ends a word, by its id; none where the vocabulary has another pattern.
        self.ends = np.zeros(max(names.values()) + 1, bool) if known else None
        if known:
            self.ends[[i for name, i in names.items() if name.endswith(_SUFFIX)]] = True
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _keep(self, piece: str, ids: bytes) -> None:
        self.ids[piece] = ids
        self.size += len(piece) + len(ids) + ENTRY_BYTES

    def _add_words(self, words: set[str]) -> None:
        """Encodes the words that are not known yet, many in one text; their last tokens tell where each ends."""
        new = sorted(words.difference(self.ids))
        for start in range(0, len(new), 4096):
            some = new[start : start + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            edges = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(edges) != len(some) or edges[-1] != ids.nbytes:
                raise ValueError("the words of the vocabulary's pattern are not those of its tokens")
            raw = ids.tobytes()
            self.ids.update(zip(some, map(raw.__getitem__, map(slice, [0, *edges[:-1]], edges)), strict=True))
            self.size += sum(map(len, some)) + len(raw) + ENTRY_BYTES * len(some)

    def _add_pieces(self, pieces: set[str]) -> None:
        """Encodes the pieces between white space that are not known yet."""
        parts: dict[str, tuple[str, str]] = {}
        for piece in pieces.difference(self.ids):
            body, mark = (piece[:-1], piece[-1]) if piece[-1] in MARKS and piece[:-1].lower().isalpha() else (piece, "")
            parts[piece] = (body.lower() if body.isascii() and body.isalpha() else body, mark)
        new = sorted({x for part in parts.values() for x in part if x}.difference(self.ids))
        for start in range(0, len(new), 4096):
            some = new[start : start + 4096]
            for piece, made in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = made.ids
                self._keep(piece, struct.pack(f"<{len(ids)}I", *ids))
        for piece, (body, mark) in parts.items():
            if piece != body:
                self._keep(piece, self.ids[body] + self.ids[mark] if mark else self.ids[body])

    def _words(self, text: str) -> list[str] | None:
        """The words of a Latin-1 text; none where it must be cut otherwise."""
        if self.ends is None:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = text.lower()
        return None if any(a in text for a in self.added) else _WORDS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        if self.size > self.most_bytes:
            self.ids, self.size = {}, 0
        odd = [any(c in t for c in EXTRA_SPACE) for t in texts]
        words = [None if o else self._words(t) for o, t in zip(odd, texts, strict=True)]
        pieces = [t.split() if w is None and not o else None for o, w, t in zip(odd, words, texts, strict=True)]
        self._add_words(set().union(*(w for w in words if w)))
        self._add_pieces(set().union(*(p for p in pieces if p)))
        found = self.ids.__getitem__
        cut = [p if w is None else w for w, p in zip(words, pieces, strict=True)]
        return [self._whole(t) if c is None else b"".join(map(found, c)) for t, c in zip(texts, cut, strict=True)]


def tokenized_pieces(df: DataFrame, vocabulary: str, text: str = "text", window: int = 4096, end_id: int = 2) -> DataFrame:
    """``df`` without its text, one row for each piece: ``start``, ``length``, ``ids_crc32``, ``doc_tokens``.

    ``vocabulary`` is the path of a tokenizer file that every executor has. ``end_id`` follows each document's ids, so
    that a null or empty text is one piece of one id. Every id lies in exactly one piece of at most ``window`` ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        cache = process_cache()
        words = cache.get(("ids", vocabulary)) or cache.setdefault(("ids", vocabulary), WordIds(vocabulary))

        def work(texts: list[str]):
            counts, sums = [], []
            for ids in words.encode(texts):
                ids += end
                counts.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[a : a + 4 * window]) for a in range(0, len(ids), 4 * window)])
            return [counts, sums]

        return work

    made = with_text_columns(df, text, {"doc_tokens": "bigint", "__sums": "array<bigint>"}, make).drop(text)
    kept = [F.col(f"`{c}`") for c in made.columns if c.lower() not in ("doc_tokens", "__sums", "start", "length", "ids_crc32")]
    rows = made.select(*kept, "doc_tokens", F.posexplode("__sums").alias("__at", "ids_crc32"))
    start = F.col("__at").cast("bigint") * window
    return rows.select(*kept, start.alias("start"), F.least(F.lit(window).cast("bigint"), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens")


class Capacities:
    """Segment tree of open windows by remaining capacity; finds the least capacity that is large enough."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A window with the least capacity of ``need`` or more, removed; None where there is none."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour has a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are taken longest first, equal ones in the given order."""
    own, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = Capacities(window), 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        found = tree.take(size)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, own[i] = found
        offset[i] = window - capacity
        if capacity > size:
            tree.add(capacity - size, int(own[i]))
    return own, offset


def pack(pieces: DataFrame, keys: list[str], window: int = 4096, group_pieces: int = 50_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every window is gapless from 0 and holds at most ``window`` ids.

    Pieces are dealt by a hash of ``keys`` to groups of about ``group_pieces``; a group packs on its own, and its number
    is in the upper half of the sequence id. Pieces with equal keys share a group, so ``keys`` should tell most of them
    apart. Pieces of no or null length are not packed (null id and offset). No piece gives no row. Columns of ``pieces``
    with the names of new ones are replaced.
    """
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset", "__group")))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(keys, kind="stable", ignore_index=True)
        lengths = frame["length"].fillna(0).to_numpy().astype(np.int64)
        some = lengths > 0
        own, offset = np.zeros((2, len(frame)), np.int64)
        own[some], offset[some] = best_fit_decreasing(lengths[some], window)
        frame["sequence_id"] = pd.array((int(frame["__group"].iloc[0]) << 32) + own, "Int64")
        frame["offset"] = pd.array(offset, "Int64")
        frame.loc[~some, ["sequence_id", "offset"]] = pd.NA
        return frame.drop(columns="__group")

    return dealt.groupBy("__group").applyInPandas(fill, f"{fields}, sequence_id bigint, offset bigint")


def packed_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece of every document: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts have one id. Rows that repeat a key are packed one by one; a null key is kept. Texts are
    tokenized once, and only the lengths of pieces are shuffled.
    """
    pieces = tokenized_pieces(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")), vocabulary, "__text", window, end_id)
    # Written once with the pieces: a number that tells rows of equal or null keys apart, the same however often a task runs.
    numbered = durable(pieces.withColumn("__row", F.monotonically_increasing_id()))
    return pack(numbered, ["__key", "start", "__row"], window).drop("__row").withColumnRenamed("__key", key)


def padding(packed: DataFrame, window: int = 4096) -> DataFrame:
    """One row: ``sequences``, ``tokens`` and ``padded``, the ids to add up to ``window``; a length that is a power of two needs none."""
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.log2("n") == F.floor(F.log2("n"))
    return full.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(exact, 0).otherwise(F.lit(window) - F.col("n"))).alias("padded"))
