"""Fill-in-middle transformation: texts cut at two lines found in an indexable skip list.

A text's lines are the nodes of a skip list. Each link of a lane carries how many units (lines) and how many code points
it passes, so that going down from the sparsest lane by accumulated widths reaches any unit rank, and with it the exact
code point, in logarithmic steps. The cut points leave the tasks as numbers; texts are cut, put together and digested by
built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LINES = re.compile(r"[^\n]*\n|[^\n]+")


class SkipList:
    """Sequence of units of known widths, in lanes; the first node of every lane stands before the first unit.

    Lane 0 has a link for each unit. About a fourth of a lane's nodes, chosen by bits of a hash of their position, stand in
    the next lane too. ``units`` and ``points`` are the widths of links, ``below`` is a node's place in the lane under it.
    """

    def __init__(self, widths: Iterable[int] = ()):
        self.units: list[list[int]] = [[]]
        self.points: list[list[int]] = [[]]
        self.below: list[list[int]] = [[]]
        self.size = self.length = 0
        for width in widths:
            self.append(width)

    def append(self, width: int) -> None:
        """Adds a unit of so many code points at the end."""
        coin = (self.size * 0x9E3779B97F4A7C15 >> 29) & 0xFFFFFFFF
        units, points, below = self.units, self.points, self.below
        units[0].append(1)
        points[0].append(width)
        lane, stands = 1, coin & 3 == 0
        while lane < len(units):
            if stands:  # the new link's node stands here as well: a link of its own begins
                units[lane].append(1)
                points[lane].append(width)
                below[lane].append(len(units[lane - 1]) - 1)
            else:
                units[lane][-1] += 1
                points[lane][-1] += width
            coin >>= 2
            stands, lane = stands and coin & 3 == 0, lane + 1
        if stands and len(units[-1]) > 1:  # a new sparsest lane, from the first node over all units
            units.append([self.size + 1 - units[lane - 1][-1], units[lane - 1][-1]])
            points.append([self.length + width - points[lane - 1][-1], points[lane - 1][-1]])
            below.append([0, len(units[lane - 1]) - 1])
        self.size += 1
        self.length += width

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank (0: none; the number of units: all)."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = passed = 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, points = self.units[lane], self.points[lane]
            while rank and units[node] <= rank:
                rank -= units[node]
                passed += points[node]
                node += 1
                if not rank:
                    return passed
            node = self.below[lane][node] if lane else node
        return passed


def line_cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of lines n, and the code points before the lines of ranks ``first % (n + 1)`` and ``second % (n + 1)``, the smaller first."""
    lines = SkipList(map(len, _LINES.findall(text)))
    low, high = sorted((first % (lines.size + 1), second % (lines.size + 1)))
    return lines.size, lines.offset(low), lines.offset(high)


def _cuts(text: Column, first: Column, second: Column) -> Column:
    kind = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            rows = zip(texts, a.to_pylist(), b.to_pylist(), strict=True)  # texts are decoded one at a time
            yield pa.array([dict(zip(("n", "low", "high"), line_cuts(t.as_py(), x, y), strict=True)) for t, x, y in rows], kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<n:bigint,low:bigint,high:bigint>").asNondeterministic()(text, first, second)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a key: the first 8-digit groups of sha256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transformed(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50
) -> DataFrame:
    """``df`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the rearranged whole text.

    ``form`` is ``plain`` for empty and null texts, texts that hold a mark already, and all but ``rate`` of 100 others; the
    rest are ``spm`` (suffix first) in ``spm_rate`` of 100 cases, else ``psm``. Plain rows keep their text and have no cut
    lengths. Cuts and forms depend on the key and the text alone: rows that repeat both give equal rows. Input columns with
    the names of new ones are replaced.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    told = df.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"), h1.alias("__h1"), h2.alias("__h2"), h3.alias("__h3"), h4.alias("__h4"))
    cut = told.withColumn("__c", _cuts(F.col("__t"), F.col("__h1"), F.col("__h2")))
    t, low, high = F.col("__t"), F.col("__c.low").cast("int"), F.col("__c.high").cast("int")
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | (F.col("__h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < spm_rate, "spm").otherwise("psm")
    prefix, middle = F.substring(t, F.lit(1), low), F.substring(t, low + 1, high - low)
    suffix = F.substring(t, high + 1, F.length(t))
    formed = cut.withColumn("form", form)
    output = (
        F.when(F.col("form") == "plain", t)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    length = lambda c: F.when(F.col("form") != "plain", c)
    return formed.select(
        *kept, F.col("__c.n").alias("n"), "form", length(F.col("__c.low")).alias("prefix_chars"), length(F.col("__c.high") - F.col("__c.low")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form: marks occur where they were put only, as texts that hold one stay plain."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {name: F.concat(*(parts[i] for i in order)) for name, order in at.items()}
    return F.when(form == "psm", joined["psm"]).when(form == "spm", joined["spm"]).otherwise(output)
