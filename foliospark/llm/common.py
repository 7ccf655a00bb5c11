"""Helpers shared by the operators: batch functions over one text column, and row keys."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def with_text_columns(
    df: DataFrame, text: str, columns: dict[str, str], make: Callable[[], Callable[[list[str]], list[list]]]
) -> DataFrame:
    """``df`` with ``columns`` (name: type) computed from its text column in Arrow batches; a null text counts as empty.

    ``make`` is called once in each task and returns a function from texts to one list for each column. Input columns
    that have the name of a new one are replaced (case does not matter); all other columns stay in the JVM.
    """
    lower = {c.lower() for c in columns}
    names = list(columns)
    types = [_ARROW[t] for t in columns.values()]
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in columns.items()) + ">"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            made: list[list] = [[] for _ in names]
            for start in range(0, len(batch), 256):  # a slice at a time, so that long texts are not all decoded at once
                part = work([t or "" for t in batch.slice(start, 256).to_pylist()])
                for whole, new in zip(made, part, strict=True):
                    whole.extend(new)
            yield pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not deterministic only for the optimizer: a filter on a result must not evaluate the texts a second time.
    udf = F.arrow_udf(run, kind).asNondeterministic()
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lower]
    return df.select(*kept, udf(F.col(f"`{text}`")).alias("__made")).select(*kept, *(F.col(f"__made.{n}").alias(n) for n in names))


def fold_of(key: Column, folds: int) -> Column:
    """Fold of a row: crc32 of its key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def process_cache() -> dict:
    """What a Python worker keeps from task to task: loaded vocabularies and bounded memos."""
    return vars(sys).setdefault("_foliospark_cache", {})


def lowest_keys(df: DataFrame, key: str, most: int, rows: int, margin: int = 2) -> DataFrame:
    """At most ``most`` keys of ``df``, those of the lowest hashes; ``rows`` is how many rows to expect before any filter.

    Only keys below a hash bound that ``margin`` times as many rows can be expected to meet are sorted, so that the final
    order reads a bounded number of them, not some of every task. Null keys are left out, repeated ones count once.
    """
    found = df.select(F.col(f"`{key}`").alias(key)).where(F.col(key).isNotNull())
    if rows > 2 * margin * most:
        found = found.where(F.xxhash64(key) < F.lit(int(-(2**63) + 2**64 * (margin * most / rows))))
    return found.distinct().orderBy(F.xxhash64(key), key).limit(most)
