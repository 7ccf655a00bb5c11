"""Phrase collocation mining by Toivonen's method: sample, negative border, exact counts, further passes until closed.

Every contiguous part of a frequent phrase is frequent. A bounded sample of the documents proposes a family of phrases that
is closed under taking parts; its negative border are the phrases outside of it all of whose parts are inside. A full pass
counts the family and its border. Where a border phrase turns out to be frequent, the family grows by it and the next full
pass counts what is newly on the border, until no border phrase is frequent. Single words are always in the family or on
its border, so the first pass counts them all.

A family is no list of phrases but a bit table of fixed size over 64-bit digests, which is all that is broadcast. A digest
that is found there by accident costs a needless count and changes no result. The passes count digests, the rows of which
are short, and keep those that reach the least frequency: no phrase is frequent unless its digest is. Tasks count their share
before anything is shuffled, so that no phrase, however frequent, fills one task.

Phrases are counted apart by 62 bits of their digest and 32 of the digest of their last word. Each count carries one task that
met its phrase, and one more pass has that task alone give the phrase's text, so that a phrase has one row and not one from
every task that holds it. Where a phrase stays without a text (tasks that hold other rows than in an earlier pass) or has two,
all phrases found are counted once more by their texts. What that cannot see are two phrases that agree in all these bits (of
one last word: in the 62 alone) of which the task that names them holds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import durable

from .common import lowest_keys

LONGEST = 4
#: Bytes of text that a task cuts into words at once, and words that it counts at once; a longer text is cut by itself.
SLICE_BYTES, COUNTED_WORDS = 4 << 20, 2_000_000
#: Counted phrases that a task holds to add up what its slices repeat.
HELD_PHRASES = 1 << 20
#: Bits of the number of cells, at most, that tell the tasks which name phrases; marks of tasks are 1 to TASKS.
CELL_BITS, TASKS, SEVERAL = 25, 65534, 65535
#: What parts pieces, what parts words; only A-Z are lower-cased.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + b".,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
_BLANK, _END = 32, 10
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def word_digests(raw: bytes, group: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest of each word of translated bytes, and the number of pieces that ended before it.

    A digest depends on the word and the group (language) alone: a polynomial of random values of its bytes.
    """
    return _words(raw, group)[:2]


def _words(raw: bytes, group: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_digests``, and the first and last byte (exclusive) of each word."""
    import xxhash

    data = np.frombuffer(raw, np.uint8)
    ends = data == _END
    gap = ends | (data == _BLANK)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(lengths.max(), _ODD))
    sums = np.add.reduceat(_LETTERS[data[~gap]] * powers[place], first)
    return _mixed(sums ^ np.uint64(xxhash.xxh64_intdigest(group))), np.cumsum(ends)[starts], starts, starts + lengths


def _level(digest: np.ndarray, k: int) -> np.ndarray:
    """The digest that is counted: its lowest bits tell the phrase's length."""
    return _mixed(digest) & ~np.uint64(3) | np.uint64(k - 1)


def _ending(own: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """What tells phrases of one counted digest apart: 32 bits of the digest of their last word."""
    return (own[at + k - 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def grown(own: np.ndarray, digest: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Digests of the phrases of ``k`` words at some positions, from those of one word less and of words."""
    return _mixed(digest[at]) * _ODD + own[at + k - 1]


class Grams:
    """Word sequence of some texts of one group: exact numbers of words, pieces, and digests."""

    def __init__(self, texts: list[bytes], group: str):
        numbers = _Numbers({b"\n": 0})
        joined = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
        told = np.fromiter(map(numbers.__getitem__, filter(None, joined.split(b" "))), np.int64)
        inside = told != 0
        self.ids, self.piece = told[inside] - 1, np.cumsum(~inside)[inside]
        del numbers[b"\n"]
        self.words = list(numbers)
        self.own = word_digests(b" ".join(self.words), group)[0][self.ids]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Family:
    """A set of digests as a bit table; ``None`` holds none."""

    def __init__(self, table: np.ndarray | None, bits: int):
        self.table, self.shift = table, np.uint64(64 - bits)

    def holds(self, digests: np.ndarray) -> np.ndarray:
        told = np.zeros(len(digests), bool)
        for start in range(0, 0 if self.table is None else len(digests), 1 << 17):  # some at a time, for the room that it takes
            at = digests[start : start + (1 << 17)] >> self.shift
            told[start : start + (1 << 17)] = self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
        return told


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Some texts of one group at a time."""
    held: dict[str, tuple[list[bytes], list[int]]] = {}
    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer()
            if raw is None or not raw.size:
                continue
            texts, size = held.setdefault(group, ([], [0]))
            if texts and size[0] + raw.size > SLICE_BYTES:
                yield group, texts
                texts, size = held[group] = ([], [0])
            texts.append(raw.to_pybytes())
            size[0] += raw.size
    for group, (texts, _) in held.items():
        yield group, texts


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word digests and piece numbers of many texts of one group at a time."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        shift = np.cumsum([0, *(int(p[-1]) + 1 if len(p) else 0 for _, p in parts)])
        return np.concatenate([d for d, _ in parts]), np.concatenate([p + n for (_, p), n in zip(parts, shift, strict=False)])

    for group, texts in _slices(batches):
        parts = held.setdefault(group, [])
        parts.append(word_digests(b"\n".join(texts).translate(_TABLE), group))
        if sum(len(d) for d, _ in parts) > COUNTED_WORDS:
            del parts
            yield told(held.pop(group))
    while held:
        yield told(held.popitem()[1])


def _pairs(frame: DataFrame, group: str, text: str) -> DataFrame:
    return frame.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("g"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))


def _count_digests(texts: DataFrame, least: int, known: np.ndarray | None, before: np.ndarray | None, bits: int, all_phrases: bool = False) -> DataFrame:
    """Digests (``h``, ``g`` by the last word) with ``least`` occurrences (``n``) or more among the phrases of the family ``known`` and its border.

    ``p`` is one task that met the phrase, the first in an order by its digest. Phrases that were in or on the border of
    ``before`` are left out; with ``all_phrases`` every phrase counts.
    """
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((known, before))  # two tables of 2^bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = (Family(t, bits) for t in shared.value)
        task = TaskContext.get().partitionId()
        for own, piece in _sequences(batches):
            digest = own.copy()
            at = np.arange(len(own))
            inner = inner_before = np.ones(len(own), bool)  # whether the phrase of one word less at a position is in the families
            for k in range(1, LONGEST + 1):
                if k > 1:
                    same = piece[: len(own) - k + 1] == piece[k - 1 :]
                    begins = same if all_phrases else same & inner[: len(same)] & inner[1 : len(same) + 1]
                    at = np.flatnonzero(begins)
                    digest[at] = grown(own, digest, at, k)
                told = _level(digest[at], k)
                done = np.full(len(at), then.table is not None) if k == 1 else inner_before[at] & inner_before[at + 1]  # counted before
                inner, inner_before = np.zeros((2, len(own) + 1), bool)
                inner[at], inner_before[at] = now.holds(told), done & then.holds(told)
                wanted = told[~done]
                del told
                order = np.argsort(wanted)
                wanted, ending = wanted[order], _ending(own, at[~done], k)[order]
                first = np.flatnonzero(np.append(True, (wanted[1:] != wanted[:-1]) | (ending[1:] != ending[:-1]))[: len(wanted)])
                found, ending, times = wanted[first], ending[first], np.diff(np.append(first, len(wanted)))
                del order, wanted, first
                for start in range(0, len(found), 1 << 17):
                    cut = slice(start, start + (1 << 17))
                    place = (found[cut] >> np.uint64(56)).astype(np.int32) ^ np.int32(task)  # another order of the tasks for other digests
                    columns = [found[cut].view(np.int64), ending[cut], times[cut].astype(np.int64), place]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h", "g", "n", "p"])
                del found, ending, times

    counted = texts.mapInArrow(run, "h bigint, g int, n bigint, p int").groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("p").alias("p"))
    task = F.col("p").bitwiseXOR(F.shiftrightunsigned("h", 56).cast("int"))
    return counted.where(F.col("n") >= least).select("h", "g", "n", task.alias("p"))


def _table_of(digests: DataFrame, bits: int) -> np.ndarray:
    """The bit table of some digests; what the driver gets is at most the table, 2^bits bits."""
    at = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    told = digests.select(F.shiftright(at, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[told.column("w").to_numpy()] = told.column("b").to_numpy().view(np.uint64)
    return table


def _missing(digests: DataFrame, known: np.ndarray, bits: int) -> bool:
    """Whether some phrase that can grow is not in the family yet."""
    shared = digests.sparkSession.sparkContext.broadcast(known)

    def run(column: pa.Array) -> pa.Array:
        return pa.array(~Family(shared.value, bits).holds(column.to_numpy(zero_copy_only=False).view(np.uint64)))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    short = digests.where(F.col("h").bitwiseAND(F.lit(3)) < LONGEST - 1)
    return not short.where(F.arrow_udf(run, "boolean")(F.col("h"))).isEmpty()


class Held:
    """Counts of phrases by group, added up over the slices of a task; at most about ``most`` rows are held."""

    def __init__(self, most: int):
        self.most, self.rows = most, 0
        self.parts: dict[str, list[pa.Table]] = {}

    def add(self, group: str, k: int, phrases: pa.Array, times: np.ndarray) -> None:
        told = [pa.array(np.full(len(phrases), k, np.int32)), phrases, pa.array(times.astype(np.int64))]
        self.parts.setdefault(group, []).append(pa.table(told, names=["k", "phrase", "f"]))
        self.rows += len(phrases)

    def merge(self) -> None:
        for group, parts in self.parts.items():
            if len(parts) > 1:
                whole = pa.concat_tables(parts).group_by(["k", "phrase"], use_threads=False).aggregate([("f", "sum")])
                self.parts[group] = [whole.select(["k", "phrase", "f_sum"]).rename_columns(["k", "phrase", "f"])]
        self.rows = sum(t.num_rows for parts in self.parts.values() for t in parts)

    def told(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What must be given away: all at the end, before that only where added-up counts still fill half of the room."""
        if not last and self.rows <= self.most:
            return
        self.merge()
        if not last and 2 * self.rows <= self.most:
            return
        for group, (whole,) in self.parts.items():
            for rows in whole.to_batches(max_chunksize=1 << 16):
                lang = pa.array([group]).take(pa.array(np.zeros(len(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([lang, *rows.columns], names=["lang", "k", "phrase", "f"])
        self.parts, self.rows = {}, 0


def _count_phrases(texts: DataFrame, survivors: np.ndarray, bits: int) -> DataFrame:
    """Exact counts (``lang``, ``k``, ``phrase``, ``f``) of all phrases whose digests are in the table; row ``k = 0`` counts all words."""
    shared = texts.sparkSession.sparkContext.broadcast(survivors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = Family(shared.value, bits), Held(HELD_PHRASES)
        for group, part in _slices(batches):
            grams = Grams(part, group)
            size = len(grams.ids)
            if not size:
                continue
            held.add(group, 0, pa.array([""]), np.array([size]))
            words = shorter = pa.array(grams.words, pa.binary()).cast(pa.string())
            digest = grams.own.copy()
            at, numbers = np.arange(size), np.zeros(size, np.int64)  # of the phrase of one word less at each position
            for k in range(1, LONGEST + 1):
                if k > 1:
                    same = grams.piece[: size - k + 1] == grams.piece[k - 1 :]
                    at = np.flatnonzero(same & (numbers[: len(same)] >= 0) & (numbers[1 : len(same) + 1] >= 0))
                    digest[at] = grown(grams.own, digest, at, k)
                at = at[family.holds(_level(digest[at], k))]
                last = grams.ids[at + k - 1]
                _, first, own, times = np.unique(numbers[at] * len(grams.words) + last, return_index=True, return_inverse=True, return_counts=True)
                ends = words.take(pa.array(last[first]))
                shorter = ends if k == 1 else pc.binary_join_element_wise(shorter.take(pa.array(numbers[at[first]])), ends, " ")
                numbers = np.full(size + 1, -1, np.int64)
                numbers[at] = own
                held.add(group, k, shorter, times)
            yield from held.told()
        yield from held.told(last=True)

    return texts.mapInArrow(run, "lang string, k int, phrase string, f bigint").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


class Owners:
    """The mark of the task that names a phrase, by cells over its digest; later tables tell what shares a cell of those before."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    @staticmethod
    def cell(digests: np.ndarray, depth: int, cells: int) -> np.ndarray:
        return (_mixed(digests + np.uint64(depth)) >> np.uint64(65 - cells.bit_length())).astype(np.int64)

    def of(self, digests: np.ndarray) -> np.ndarray:
        """Marks: 0 for no task, ``SEVERAL`` where cells are shared to the last."""
        told = np.full(len(digests), SEVERAL, np.uint16)
        for depth, table in enumerate(self.tables):
            at = np.flatnonzero(told == SEVERAL)
            told[at] = table[self.cell(digests[at], depth, len(table))]
        return told


def _owner_table(found: DataFrame, tables: list[np.ndarray], cells: int) -> np.ndarray:
    """The next table for ``Owners``, of the digests that ``tables`` leave open."""
    shared = found.sparkSession.sparkContext.broadcast(tables)

    def run(column: pa.Array) -> pa.Array:
        digests = column.to_numpy(zero_copy_only=False).view(np.uint64)
        open_ = Owners(shared.value).of(digests) == SEVERAL
        return pa.array(np.where(open_, Owners.cell(digests, len(shared.value), cells), -1))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    placed = found.select(F.arrow_udf(run, "bigint")(F.col("h")).alias("c"), (F.col("p") % TASKS + 1).cast("bigint").alias("v")).where("c >= 0")
    mark = F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.lit(SEVERAL).cast("bigint"))
    shift = (F.lit(16) * F.col("c").bitwiseAND(F.lit(3))).cast("int")
    marks = placed.groupBy("c").agg(mark.alias("v")).select(F.shiftright("c", 2).alias("w"), F.call_function("shiftleft", F.col("v"), shift).alias("v"))
    told = marks.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros(cells // 4, np.int64)
    table[told.column("w").to_numpy()] = told.column("v").to_numpy()
    return table.view(np.uint16)


def _owners(found: DataFrame) -> list[np.ndarray]:
    """Tables for ``Owners``, of 16 bits a cell and 2^``CELL_BITS`` cells at most; what the driver gets is no more than twice that."""
    rows, tables = found.count(), []
    for depth in range(2):
        tables.append(_owner_table(found, list(tables), 1 << min(max((8 * rows >> 2 * depth).bit_length(), 8), CELL_BITS)))
    return tables


def _name_phrases(texts: DataFrame, survivors: np.ndarray, owners: list[np.ndarray], bits: int) -> DataFrame:
    """Texts (``h``, ``g``, ``lang``, ``k``, ``phrase``) of phrases from the tasks that name them; rows ``k = 0`` count a task's words in ``f``."""
    shared = texts.sparkSession.sparkContext.broadcast((survivors, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, tasks, mark = Family(shared.value[0], bits), Owners(shared.value[1]), TaskContext.get().partitionId() % TASKS + 1
        given, totals = np.zeros(0, np.uint64), {}
        for group, part in _slices(batches):
            raw = b"\n".join(part).translate(_TABLE)
            own, piece, starts, ends = _words(raw, group)
            totals[group] = totals.get(group, 0) + len(own)
            digest, at, inner = own.copy(), np.arange(len(own)), np.ones(len(own), bool)
            for k in range(1, LONGEST + 1):
                if k > 1:
                    same = piece[: len(own) - k + 1] == piece[k - 1 :]
                    at = np.flatnonzero(same & inner[: len(same)] & inner[1 : len(same) + 1])
                    digest[at] = grown(own, digest, at, k)
                told = _level(digest[at], k)
                held = family.holds(told)
                inner = np.zeros(len(own) + 1, bool)
                inner[at] = held
                marks = tasks.of(told[held])
                mine = np.flatnonzero((marks == mark) | (marks == SEVERAL))
                here, told = at[held][mine], told[held][mine]
                ending = _ending(own, here, k)
                new, first = np.unique(told ^ _mixed(ending.view(np.uint32).astype(np.uint64)), return_index=True)
                unseen = ~np.isin(new, given, assume_unique=True)
                given, first = np.concatenate((given, new[unseen])), first[unseen]
                for start in range(0, len(first), 1 << 16):
                    cut = first[start : start + (1 << 16)]
                    names = [b" ".join(raw[starts[j] : ends[j]] for j in range(i, i + k)) for i in here[cut].tolist()]
                    zeros = np.zeros(len(cut), np.int32)
                    columns = [told[cut].view(np.int64), ending[cut], pa.array([group]).take(pa.array(zeros)), zeros + np.int32(k)]
                    columns += [pa.array(names, pa.binary()).cast(pa.string()), zeros.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h", "g", "lang", "k", "phrase", "f"])
        if totals:
            count = len(totals)
            columns = [np.zeros(count, np.int64), np.zeros(count, np.int32), list(totals), np.zeros(count, np.int32), [""] * count, np.array(list(totals.values()), np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h", "g", "lang", "k", "phrase", "f"])

    return texts.mapInArrow(run, "h bigint, g int, lang string, k int, phrase string, f bigint")


def frequent_phrases(
    docs: DataFrame, text: str = "text", group: str = "lang", key: str = "doc_id", least: int = 30, sample: int = 2500, lowered: float = 0.8, bits: int = 26
) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``f`` of all phrases of 1 to 4 words with ``least`` occurrences or more in a group, and rows ``k = 0`` with its words.

    ``sample`` documents, those of the lowest hashes of their keys, propose phrases that reach ``lowered`` of their share of
    ``least``, twice at least; whatever they propose, the result is exact. A null group is ``und``, a null text empty; null keys
    are counted but not sampled. The broadcast tables have 2^``bits`` bits: a table too small for its phrases only makes the
    passes count more. No document gives no row, a group without words none either. The rows are kept by a checkpoint.
    """
    texts = _pairs(docs, group, text)
    rows = docs.count()
    chosen = lowest_keys(docs, key, sample, rows)
    few = _pairs(docs.join(F.broadcast(chosen), key, "left_semi"), group, text)
    share = least * lowered * min(1.0, sample / max(rows, 1))
    known, before = _table_of(_count_digests(few, max(2, int(share)), None, None, bits, all_phrases=True), bits), None
    found = None
    while True:
        frequent = durable(_count_digests(texts, least, known, before, bits))
        found = frequent if found is None else found.unionByName(frequent)
        if not _missing(frequent, known, bits):
            break
        known, before = known | _table_of(frequent, bits), known
    survivors = _table_of(found, bits)
    rows = durable(_name_phrases(texts, survivors, _owners(found), bits))
    name = F.struct("lang", "k", "phrase")
    names = rows.where("k > 0").groupBy("h", "g").agg(F.min(name).alias("name"), F.max(name).alias("other"))
    told = durable(found.join(names, ["h", "g"], "left").select("name.*", F.col("n").alias("f"), F.coalesce(F.col("name") != F.col("other"), F.lit(True)).alias("open")))
    if not told.where("open").isEmpty():
        counted = _count_phrases(texts, survivors, bits)
        return durable(counted.where((F.col("k") == 0) | (F.col("f") >= least)))
    totals = rows.where("k = 0 and f > 0").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return told.drop("open").unionByName(totals)


def _inner(phrase: str, length: int) -> Column:
    """Phrases of so many words that lie in a longer one; none in one that is no longer."""
    words = F.split(phrase, " ")
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    inner = F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))
    return F.when(F.size(words) > length, inner).otherwise(F.array().cast("array<string>"))


def scored(frequent: DataFrame) -> DataFrame:
    """Phrases of 2 words or more with ``a``, ``l``, ``r``, ``n`` and ``score`` by their lowest-scoring cut, contained ones dropped.

    A cut after k words scores ``floor(2000000 a / (l + r))``, in decimals of 38 digits; ties go to the smallest k. A phrase
    is dropped if a longer one that holds its words in a row has 80 % of its occurrences or more.
    """
    several = frequent.where("k >= 2").withColumnRenamed("f", "a")
    counts = frequent.where("k between 1 and 3").select("lang", F.col("phrase").alias("part"), "f")
    longer = frequent.where("k >= 3")
    held = longer.select("lang", F.explode(F.array_distinct(F.concat(_inner("phrase", 2), _inner("phrase", 3)))).alias("phrase"), "f")
    most = held.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    open_ = several.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(80) * F.col("a"))).drop("most")
    cuts = open_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    words = F.split("phrase", " ")
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, F.col("cut")), " "), "rest": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ")})
    both = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    score = F.expr("cast(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0)) as decimal(38, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("c"))
    totals = frequent.where("k = 0").select("lang", F.col("f").alias("n"))
    return lowest.join(F.broadcast(totals), "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", F.col("c.score").alias("score"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", key: str = "doc_id", most: int = 2000, **mining) -> DataFrame:
    """The first ``most`` phrases of each group by score, occurrences (both descending) and text: ``lang, rank, phrase, a, l, r, n, score``.

    ``mining`` goes to ``frequent_phrases``. Only columns ``text``, ``group`` and ``key`` are read, others may have any name.
    """
    ranked = scored(frequent_phrases(docs, text, group, key, **mining))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
