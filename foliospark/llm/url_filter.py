"""URL filters by a sort-merge range join.

The labels of a host in reverse order, joined with the path, are a canonical key under which a rule's host and all its
subdomains are one interval. Rules and urls are dealt to ranges of this key and sorted; a sweep keeps the rules whose
interval is open on a stack, outer hosts below inner ones, and looks up the url's path prefixes in each level.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RANGES = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _cuts(keys: DataFrame, rows_per_range: int) -> list[tuple[bytes, int]]:
    """Bounds of ranges of about equal size, from a sample of (key, salt) of at most some hundred thousand rows."""
    rows = keys.count()
    ranges = min(MOST_RANGES, -(-rows // rows_per_range))
    if ranges <= 1:
        return []
    found = keys.sample(min(1.0, 64 * ranges / rows), seed=1).limit(128 * MOST_RANGES).collect()
    order = sorted((r["key"].encode(), r["salt"]) for r in found)
    return sorted({order[len(order) * i // ranges] for i in range(1, ranges)}) if order else []


def _range_of(cuts: list[tuple[bytes, int]]):
    def run(key: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array([bisect_right(cuts, (k.encode(), s)) for k, s in zip(key.to_pylist(), salt.to_pylist(), strict=True)], pa.int32())

    run.__annotations__ = {"key": pa.Array, "salt": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")


class _Sweep:
    """Open rules along the key order."""

    def __init__(self) -> None:
        self.stack: list[tuple[bytes, str, dict[str, str], list[int]]] = []

    def open(self, low: bytes, high: bytes, host: str, path: str, verdict: str) -> None:
        self._close(low)
        if not self.stack or self.stack[-1][1] != host:
            self.stack.append((high, host, {}, []))
        _, _, paths, lengths = self.stack[-1]
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)
        if paths.get(path) != "block":  # of equal rules the blocking one counts
            paths[path] = verdict

    def _close(self, key: bytes) -> None:
        while self.stack and key >= self.stack[-1][0]:
            self.stack.pop()

    def judge(self, key: bytes, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict; of equally long ones that of the longer host."""
        self._close(key)
        best: tuple[int, int, str, str] | None = None
        for _, host, paths, lengths in self.stack:
            for n in lengths:
                if n <= len(path) and (verdict := paths.get(path[:n])) is not None:
                    found = (len(host) + n, len(host), host + path[:n], verdict)
                    best = max(best, found) if best else found
                    break
        return (best[2], best[3]) if best else (None, None)


def judge(
    urls: DataFrame, rules: DataFrame, keys: list[str], url: str = "url", default: str = "allow", rows_per_range: int = 200_000
) -> DataFrame:
    """``keys`` of every row of ``urls`` with ``host``, ``path``, ``rule`` (host and path, null if none fits) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains if the url's path starts with
    its path; the longest rule (host and path) wins, and ``default`` holds where none fits. Rules without host or verdict
    are ignored; a null path fits all paths; of rules with equal host and path a ``block`` wins. Null urls and those
    without ``://`` have empty host and path. Repeated rows each come back.

    Urls are dealt by key and a hash of ``keys``, so that one host, or one url, with a large share of the rows fills many
    ranges; a rule goes to every range that its interval meets. A task holds the open rules only.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    given = urls.select(F.struct(*(F.col(f"`{k}`") for k in keys)).alias("row"), host.alias("host"), path.alias("path"))
    given = given.withColumn("key", F.concat(_reversed(F.col("host")), F.lit("/"), F.col("path"))).withColumn("salt", F.xxhash64("row"))
    cuts = _cuts(given.select("key", "salt"), rows_per_range)
    range_of = _range_of(cuts)
    least = F.lit(-(2**63)).cast("bigint")
    known = rules.select(
        F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict")
    ).where("host is not null and host <> '' and verdict is not null")
    known = known.withColumn("low", F.concat(_reversed(F.col("host")), F.lit("."))).withColumn("high", F.concat(_reversed(F.col("host")), F.lit("0")))
    spans = known.withColumn("first", range_of("low", least)).withColumn("last", range_of("high", least))
    opened = spans.select(
        F.explode(F.sequence("first", "last")).alias("range"), F.col("low").alias("key"), F.lit(0).alias("kind"),
        F.lit(None).cast(given.schema["row"].dataType).alias("row"), "host", "path", "high", "verdict",
    )
    swept = given.select(
        range_of("key", "salt").alias("range"), "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast("string").alias("high"), F.lit(None).cast("string").alias("verdict")
    )
    flat = opened.unionByName(swept).select("range", "key", "kind", *(F.col("row")[k].alias(f"__k{i}") for i, k in enumerate(keys)), "host", "path", "high", "verdict")
    types = [given.schema["row"].dataType[k].dataType.simpleString() for k in keys]

    def sweep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = _Sweep(), None
        for frame in frames:
            columns = frame.to_pydict()
            found_rules, found_verdicts, chosen = [], [], []
            for i, (r, key, kind, host, path, high, verdict) in enumerate(zip(*(columns[c] for c in ("range", "key", "kind", "host", "path", "high", "verdict")), strict=True)):
                if r != at:
                    state, at = _Sweep(), r
                if kind == 0:
                    state.open(key.encode(), high.encode(), host, path, verdict)
                else:
                    rule, said = state.judge(key.encode(), path)
                    chosen.append(i)
                    found_rules.append(rule)
                    found_verdicts.append(said or default)
            kept = frame.take(pa.array(chosen, pa.int64()))
            own = [kept.column(f"__k{i}") for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*own, kept.column("host"), kept.column("path"), pa.array(found_rules, pa.string()), pa.array(found_verdicts, pa.string())],
                names=[*(f"__k{i}" for i in range(len(keys))), "host", "path", "rule", "verdict"],
            )

    dealt = flat.repartition(max(1, len(cuts) + 1), "range").sortWithinPartitions("range", "key", "kind", "host")
    schema = ", ".join([*(f"__k{i} {t}" for i, t in enumerate(types)), "host string", "path string", "rule string", "verdict string"])
    out = dealt.mapInArrow(sweep, schema)
    return out.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), "host", "path", "rule", "verdict")
