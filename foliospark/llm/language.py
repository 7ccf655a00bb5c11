"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product (binding) of its letters' vectors, rotated
(permuted) by their place; a text is the sum (bundle) of its trigrams' vectors, a language the sum of its texts. The
language with the largest cosine to the text is predicted. Words are padded with a blank, so that a trigram never spans two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, with_text_columns

DIMENSIONS = 512
SLICE = 64


class Grams:
    """Trigram counts and vectors; keeps the vectors of at most ``most`` trigrams and recomputes others."""

    def __init__(self, dimensions: int = DIMENSIONS, most: int = 65536):
        self.dimensions, self.most = dimensions, most
        self.place = np.full(0x110000, -1, np.int32)  # code point to letter number; 0 is everything but letters
        self.letters = [np.ones(dimensions, np.int8)]
        self._vector_of(ord(" "))
        self.known = np.zeros(0, np.int64)
        self.rows = np.zeros((0, dimensions), np.int8)

    def _vector_of(self, code: int) -> np.ndarray:
        return np.random.default_rng(code).choice(np.array([-1, 1], np.int8), self.dimensions)

    def _numbers(self, points: np.ndarray) -> np.ndarray:
        found = self.place[points]
        if len(found) and found.min() < 0:
            for code in np.unique(points[found < 0]).tolist():
                if chr(code).isalpha():
                    self.place[code] = len(self.letters)
                    self.letters.append(self._vector_of(code))
                else:
                    self.place[code] = 0
            found = self.place[points]
        return found

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted trigram codes (three letter numbers of 21 bits)."""
        at = np.searchsorted(self.known, grams)
        new = grams[self.known[np.minimum(at, len(self.known) - 1)] != grams] if len(self.known) else grams
        if len(new):
            letters = np.stack(self.letters)
            low = (1 << 21) - 1
            made = np.roll(letters, 2, axis=1)[new >> 42] * np.roll(letters, 1, axis=1)[new >> 21 & low] * letters[new & low]
            if len(self.known) + len(new) > self.most:
                self.known, self.rows = np.zeros(0, np.int64), self.rows[:0]
                if len(new) < len(grams):
                    return self._vectors(grams)
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.known = np.concatenate([self.known, new])[order]
            self.rows = np.concatenate([self.rows, made])[order]
            at = np.searchsorted(self.known, grams)
        return self.rows[at]

    def bundle(self, texts: list[str], owner: np.ndarray, owners: int) -> np.ndarray:
        """Sums of trigram vectors, one row for each owner; ``owner`` gives the row of each text."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer((" " + " ".join(lowered) + "  ").encode("utf-32-le", "surrogatepass"), "<u4")
        own = np.repeat(owner, np.array([len(t) + 1 for t in lowered]))
        own = np.concatenate([own[:1], own, own[-1:]])[: len(points)]
        number = self._numbers(points).astype(np.int64)
        middle = np.flatnonzero(number[1:-1]) + 1
        if not len(middle):
            return np.zeros((owners, self.dimensions), np.float32)
        many = len(self.letters)
        dense = (number[middle - 1] * many + number[middle]) * many + number[middle + 1]
        if many**3 <= 1 << 22:
            used = np.flatnonzero(np.bincount(dense, minlength=many**3))
            to = np.zeros(many**3, np.int32)
            to[used] = np.arange(len(used))
            row = to[dense]
        else:
            used, row = np.unique(dense, return_inverse=True)
        grams = used // (many * many) << 42 | used // many % many << 21 | used % many
        order = np.argsort(grams)  # already sorted, as both codes order alike
        counts = np.bincount(own[middle] * len(used) + row, minlength=owners * len(used)).reshape(owners, -1)
        return counts.astype(np.float32)[:, order] @ self._vectors(grams[order]).astype(np.float32)


@dataclass
class Profiles:
    """Language prototypes: names in order and unit vectors."""

    names: list[str]
    vectors: np.ndarray


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, dimensions: int = DIMENSIONS
) -> Profiles:
    """Prototypes of every language from all rows with key, text and language outside fold ``held``.

    Tasks bundle their own texts; the sums of languages and dimensions are combined before the shuffle, and the driver
    gets ``dimensions`` numbers for each language. The number of different languages is taken to be at most a few thousand.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & (fold_of(F.col(key), folds) != held))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dimensions)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                number = {n: i for i, n in enumerate(names)}
                made = grams.bundle(part.column(1).to_pylist(), np.array([number[n] for n in langs]), len(names))
                for name, one in zip(names, made.astype(np.float64), strict=True):
                    sums[name] = sums.get(name, 0) + one
        for name, one in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(one.astype(np.int64))], names=["lang", "dim", "value"])

    parts = rows.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(bundle, "lang string, dim int, value bigint")
    found = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    names = sorted({r["lang"] for r in found})
    at = {n: i for i, n in enumerate(names)}
    vectors = np.zeros((len(names), dimensions))
    for r in found:
        vectors[at[r["lang"]], r["dim"]] = r["value"]
    return Profiles(names, _units(vectors))


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the language of each whole text and its cosine (0 to 1; negative ones count as 0).

    A text that is null or has no letter, and every text when no language was learned, has ``und`` and score 0. Equal
    cosines go to the language that is first in order.
    """

    def make():
        grams = Grams(profiles.vectors.shape[1] if len(profiles.names) else DIMENSIONS)

        def work(texts: list[str]):
            langs, scores = [], []
            for start in range(0, len(texts), SLICE):
                part = texts[start : start + SLICE]
                vectors = grams.bundle(part, np.arange(len(part)), len(part)).astype(np.float64)
                cosines = _units(vectors) @ profiles.vectors.T if profiles.names else np.zeros((len(part), 1))
                best = cosines.argmax(axis=1)
                empty = [not profiles.names or not any(map(str.isalpha, t)) for t in part]
                langs += ["und" if e else profiles.names[b] for e, b in zip(empty, best, strict=True)]
                scores += [0.0 if e else min(1.0, max(0.0, float(c[b]))) for e, c, b in zip(empty, cosines, best, strict=True)]
            return [langs, scores]

        return work

    return with_text_columns(df, text, {name: "string", score: "double"}, make)
