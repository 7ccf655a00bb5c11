"""SentencePiece encoding and decoding by a table of distinct chunks.

The model writes white space as a marker, puts one before the text, and none of its pieces has a marker after another
character. No merge therefore crosses the place before a marker: a text's ids are those of its chunks, a run of markers
and the characters up to the next run, in a row. The texts of a slice are cut into chunks, each distinct chunk that the
table does not hold is segmented once, all in one batch, and the ids are joined back to the chunks' positions.

The table stays with a Python worker from slice to slice and is bounded in bytes: frequent chunks are segmented once for
a worker, rare ones once for a slice. A table for the whole corpus would have to meet every word of every text in a
shuffle, several times the size of the texts; this one needs none, and a lost executor only builds its own again.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache, with_text_columns

#: Fixed value: the character by which the model writes a blank.
MARK = "▁"
#: Bytes that a table may hold, with about so many for each entry besides its strings.
TABLE_BYTES, ENTRY_BYTES = 192 << 20, 180
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids and surfaces of distinct chunks; a chunk is named by what follows its first marker."""

    def __init__(self, path: str, most_bytes: int = TABLE_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a marker: its texts cannot be cut into chunks")
        self.most_bytes = most_bytes
        self._clear()

    def _clear(self) -> None:
        alone = self.model.piece_to_id(MARK)  # encoding an empty text gives no id, but a last marker has one
        self.ids: dict[str, bytes] = {"": b",%d" % alone}
        self.odd: dict[str, str] = {}  # surfaces that are not a blank and the name
        self.size = 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Names of a text's chunks by position; none for an empty text."""
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or MARK in text:
            return [c[1:] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        return parts

    def add(self, names: set[str]) -> None:
        """Segments the chunks that the table lacks, each once."""
        new = sorted(names.difference(self.ids))
        if not new:
            return
        ids = self.model.encode(new, num_threads=1)
        for name, own, surface in zip(new, ids, self.model.decode(ids), strict=True):
            told = ("," + ",".join(map(str, own))).encode()
            self.ids[name] = told
            self.size += len(name) + len(told) + ENTRY_BYTES
            if surface != name:
                self.odd[name] = " " + surface
                self.size += len(surface) + ENTRY_BYTES

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text its decimal ids joined by commas, and what decoding them gives."""
        if self.size > self.most_bytes:
            self._clear()
        cut = [self.chunks(t) for t in texts]
        self.add(set().union(*cut))
        found, odd, made = self.ids.__getitem__, self.odd, []
        for text, names in zip(texts, cut, strict=True):
            ids = b"".join(map(found, names))[1:]
            if MARK in text or (odd and not odd.keys().isdisjoint(names)):
                text = "".join([odd.get(n) or " " + n for n in names])[1:]
            made.append((ids, text))
        return made


def _table(path: str) -> ChunkTable:
    cache = process_cache()
    return cache.get(("chunks", path)) or cache.setdefault(("chunks", path), ChunkTable(path))


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) of each whole text, as the library gives them without begin and end ids.

    ``path`` is a model file that every executor has at that place. Null and empty texts have no ids. Rows that repeat a
    key or text are encoded as any other; an input column named ``ids`` is replaced, no row gives no row.
    """

    def make():
        table = _table(path)
        return lambda texts: [[ids.decode() for ids, _ in table.encode(texts)]]

    made = with_text_columns(df, text, {"ids": "string"}, make)
    numbers = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return made.withColumn("ids", numbers)


def decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with the text of its ids, as the library decodes them; null and empty ids give an empty text."""

    def run(column: pa.Array) -> pa.Array:
        model = _table(path).model
        return pa.array([model.decode(v) if v else "" for v in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(run, "string")(F.col(f"`{ids}`")))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and ``decoded_sha256`` in place of its text.

    The same pass as ``encoded``; decoding goes by the table as well, each distinct chunk's ids are decoded once. Null
    and empty texts have the digests of nothing.
    """

    def make():
        table = _table(path)

        def work(texts: list[str]):
            made = table.encode(texts)
            counts = [ids.count(b",") + 1 if ids else 0 for ids, _ in made]
            return [counts, [hashlib.sha256(ids).hexdigest() for ids, _ in made], [hashlib.sha256(t.encode()).hexdigest() for _, t in made]]

        return work

    return with_text_columns(df, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make).drop(text)
