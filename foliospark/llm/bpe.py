"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus and their ids are compiled into a minimal automaton: words share beginnings and endings, and
the numbers on the path of a word add up to its rank, which finds its ids. The compiled arrays are one block of bytes that
each worker maps into memory. A word that the automaton does not accept is merged exactly, rank by rank.

Whitespace rule of the vocabulary's word pattern: a single blank belongs to the word that follows; of a longer run the
last blank does, the rest is a word of its own. A text without such runs is cut at its blanks and line ends alone.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import durable

from .common import process_cache, with_text_columns

#: The word pattern of this vocabulary, and white space as Unicode defines it.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MEMO = 800_000
COUNTED = 50_000
EMPTY, SPREAD = 0xFFFFFFFF, 0x9E3779B1
MARKS = ".,;:"
NONE = 1 << 60


def _pattern(text: str):
    return regex.compile(text.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def byte_names() -> dict[str, int]:
    """The letters by which this kind of vocabulary writes the 256 bytes: printable ones by themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        names = byte_names()
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        model = told["model"]
        spell = lambda token: bytes(names[c] for c in token)
        self.ids = {spell(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(merges):
            left, right = spell(a), spell(b)
            self.ranks[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.pairs = {pair: rank << 20 | made for pair, (rank, made) in self.ranks.items()}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank is joined, leftmost first, until none is left."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > 64:
            return self._merge_long(parts)
        find = self.pairs.get
        costs = [find(p, NONE) for p in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) != NONE:
            at = costs.index(least)
            parts[at : at + 2] = [least & 0xFFFFF]
            del costs[at]
            if at:
                costs[at - 1] = find((parts[at - 1], parts[at]), NONE)
            if at < len(costs):
                costs[at] = find((parts[at], parts[at + 1]), NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j] = ranks[pair][1], False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (p := (parts[a], parts[after[a]])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], a, p))
        return [p for p, a in zip(parts, alive, strict=True) if a]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of sorted words with their ids as one block of bytes.

    Words are added in order; the states behind the common beginning with the next word are final for good and are
    replaced by an equal registered state, if there is one. Arcs carry the number of words before them, so that the sum
    over a path is the word's rank. Block: three lengths; the arcs as an open hash table (``state * 256 + byte``, target,
    sum); whether a state accepts; for each rank the start of its ids; the ids.
    """
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    accepts = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    previous = b""

    def settle(down_to: int) -> None:
        """Replaces the open states deeper than ``down_to`` by registered ones."""
        for depth in range(len(path) - 1, down_to, -1):
            state, byte = path[depth], previous[depth - 1]
            shape = (accepts[state], tuple(sorted(arcs[state].items())))
            known = register.setdefault(shape, state)
            arcs[path[depth - 1]][byte] = known
            path.pop()

    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            arcs.append({})
            accepts.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        accepts[path[-1]] = True
        previous = word
    settle(0)

    below: dict[int, int] = {}  # words from a state on

    def count(state: int) -> None:
        stack = [state]
        while stack:
            top = stack[-1]
            waiting = [t for t in arcs[top].values() if t not in below]
            if waiting:
                stack += waiting
            else:
                below[top] = accepts[top] + sum(below[t] for t in arcs[top].values())
                stack.pop()

    count(0)
    number: dict[int, int] = {0: 0}
    order = [0]
    found: list[tuple[int, int, int]] = []
    for state in order:
        before = int(accepts[state])
        for byte, target in sorted(arcs[state].items()):
            if target not in number:
                number[target] = len(order)
                order.append(target)
            found.append((number[state] << 8 | byte, number[target], before))
            before += below[target]
    size = 1 << max(4, (2 * len(found)).bit_length())
    keys, targets, sums = np.full(size, EMPTY, "<u4"), np.zeros(size, "<u4"), np.zeros(size, "<u4")
    for key, target, before in found:
        slot = key * SPREAD & size - 1
        while keys[slot] != EMPTY:
            slot = slot + 1 & size - 1
        keys[slot], targets[slot], sums[slot] = key, target, before
    starts = np.r_[0, np.cumsum([len(entries[w]) for w in words])].astype("<u4") if words else np.zeros(1, "<u4")
    ids = np.array([i for w in words for i in entries[w]], "<u4")
    final = np.array([accepts[state] for state in order], "<u4")
    return struct.pack("<3Q", size, len(final), len(starts)) + b"".join(x.tobytes() for x in (keys, targets, sums, final, starts, ids))


class Lexicon:
    """A compiled transducer, mapped from a file that is unlinked at once."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size, finals, starts = struct.unpack_from("<3Q", self.map)
        words = memoryview(self.map)[24:].cast("I")
        cuts = [0, size, 2 * size, 3 * size, 3 * size + finals, 3 * size + finals + starts, len(words)]
        self.keys, self.targets, self.sums, self.final, self.start, self.ids = (words[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.last = size - 1

    def get(self, word: bytes) -> list[int] | None:
        """Ids of a word, None if it is not in the lexicon."""
        keys, last = self.keys, self.last
        state = rank = 0
        for b in word:
            key = state << 8 | b
            slot = key * SPREAD & last
            while (seen := keys[slot]) != key:
                if seen == EMPTY:
                    return None
                slot = slot + 1 & last
            rank += self.sums[slot]
            state = self.targets[slot]
        return self.ids[self.start[rank] : self.start[rank + 1]].tolist() if self.final[state] else None


class _Odd(Exception):
    """The text has white space that needs the full pattern."""


class Encoder(dict):
    """Ids of pieces as little-endian 32-bit numbers.

    A piece is what stands between blanks; it begins with a line end if one came before it, else a blank belongs to it.
    At most MEMO pieces are remembered; the ids come from the lexicon or from merging.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words = _pattern(WORD).findall
        self.marks = {m: self._ids(m) for m in MARKS}
        self.space = regex.compile(f"[{SPACE}]").search
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def word_ids(self, word: str) -> list[int]:
        spelled = word.encode()
        found = self.lexicon.get(spelled) if self.lexicon else None
        return self.vocabulary.merge(spelled) if found is None else found

    def _ids(self, text: str) -> bytes:
        return np.array([i for w in self.words(text) for i in self.word_ids(w)], "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            word = self.word_ids(" " + piece)
            made = struct.pack(f"<{len(word)}I", *word)
        elif piece[-1:] in self.marks and piece[:-1].isalpha():  # the pattern parts letters from a mark
            return self[piece[:-1]] + self.marks[piece[-1]]
        else:
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or self.space(body):
                raise _Odd
            made = self._ids(piece if body is not piece else " " + piece)
        if len(self) < MEMO:
            self[piece] = made
        return made

    def _plain(self, text: str) -> bytes:
        pieces = text.replace("\n", " \n").split(" ")
        head = pieces[0]
        try:
            if not head or self.space(head):
                raise _Odd
            rest = b"".join(map(self.__getitem__, pieces[1:]))
        except _Odd:
            return self._ids(text)
        return self._ids(head) + rest

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; strings of special tokens become their ids."""
        if not text:
            return b""
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return self._plain(text)
        parts = self.specials.split(text)
        return b"".join(struct.pack("<I", special[p]) if p in special else self._plain(p) if p else b"" for p in parts)

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def frequent_words(df: DataFrame, text: str = "text", most: int = 50_000) -> list[str]:
    """The ``most`` most frequent pieces of all whole texts, each with the blank or line end before it.

    A task keeps COUNTED counters: when they are twice as many, the lowest count of those to be kept is taken from all
    (lossy counting), so that any piece more frequent than a COUNTED-th of the task's pieces has a counter. The choice
    only decides which words the lexicon holds; words that it does not hold are merged with the same result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.replace("\n", " \n").split(" "))
                if len(seen) > 2 * COUNTED:
                    kept = seen.most_common(COUNTED)
                    least = kept[-1][1]
                    seen = Counter({w: n - least for w, n in kept if n > least})
        for start in range(0, len(rows := list(seen.items())), 20_000):
            part = rows[start : start + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

    parts = df.select(F.col(f"`{text}`")).mapInArrow(count, "word string, n bigint")
    counted = durable(parts.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")))
    # The least power of two that fewer words reach bounds what the tasks send for the final order.
    sizes = {r["b"]: r["c"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    seen, bound = 0, 0
    for b in sorted(sizes, reverse=True):
        seen += sizes[b]
        if seen >= most:
            bound = b
            break
    top = counted.where(F.col("n") >= 2**bound).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in top.collect()]


def build_lexicon(words: list[str], vocabulary: Vocabulary) -> bytes:
    """Lexicon of the words that the pattern finds in the given pieces, with their exact ids."""
    find = _pattern(WORD).findall
    spelled = {w.encode() for piece in words for w in find(piece if piece[:1] == "\n" else " " + piece)}
    return compile_lexicon({w: vocabulary.merge(w) for w in spelled})


def encoded(df: DataFrame, path: str, block: bytes, text: str = "text", digests: bool = True) -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian 32-bit) of each whole text, or with digests of ids and decoded text.

    With ``digests``: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, the hash of what decoding the ids gives. A null
    or empty text has no ids. ``path`` is a tokenizer file that every executor has, ``block`` a compiled lexicon.
    """
    shared = df.sparkSession.sparkContext.broadcast(block)  # of bounded size: the lexicon has a fixed number of words

    def make():
        cache, name = process_cache(), ("bpe", path, hashlib.md5(shared.value).hexdigest())
        coder = cache.get(name) or cache.setdefault(name, Encoder(Vocabulary(path), Lexicon(shared.value)))

        def work(texts: list[str]):
            ids = [coder.encode(t) for t in texts]
            if not digests:
                return [ids]
            decoded = (hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids)
            return [[len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], list(decoded)]

        return work

    columns = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "binary"}
    return with_text_columns(df, text, columns, make)


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with the text of its binary ids; null ids give an empty text."""
    coder = None

    def run(column: pa.Array) -> pa.Array:
        nonlocal coder
        coder = coder or Encoder(Vocabulary(path), None)
        return pa.array([coder.decode(v or b"") for v in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(run, "string")(F.col(ids)))


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", most: int = 50_000) -> DataFrame:
    """``docs`` with digests of ids and decoded text; the lexicon is compiled from the frequent words of these documents."""
    return encoded(docs, path, build_lexicon(frequent_words(docs, text, most), Vocabulary(path)), text)
