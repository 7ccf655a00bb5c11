"""Near-duplicates by 64-bit SimHash: fingerprints, pivot distance tables and components.

Two fingerprints link when at most ``radius`` bits differ. A pair is looked at through tables of Hamming distances to
pivots: by the triangle inequality the distances of a linked pair to any pivot differ by at most ``radius``, so a pair
with a larger difference in some coordinate is discarded, and only survivors are compared bit by bit.

Pivot tables alone would still walk over all pairs (random 64-bit fingerprints have distances of 32 +- 4 to any pivot, so
that a pivot discards only four pairs in ten). The fingerprints are therefore first cut into ``blocks`` blocks of bits:
a linked pair agrees on at least ``blocks - radius`` whole blocks, and meets in the bucket of those blocks. Buckets hold
distinct fingerprints only. A large bucket is cut again by the bits that its key leaves open, which is as exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import durable

from .common import with_text_columns
from .components import components

#: Buckets of at most SMALL fingerprints are handled together; those above LARGE are cut again.
SMALL, LARGE, LEADERS = 64, 65536, 64
PIVOTS = 16


def fingerprint_of(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text: bit set when over half of the shingle hashes have it; no word gives zero."""
    words = text.encode().lower().split()  # bytes: only A-Z, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, name: str = "fingerprint") -> DataFrame:
    """``df`` with the signed 64-bit fingerprint of each whole text. Null and wordless texts have fingerprint zero."""

    def make():
        def work(texts: list[str]):
            made = np.array([fingerprint_of(t, shingle, seed) for t in texts], np.uint64)
            return [made.view(np.int64).tolist()]

        return work

    return with_text_columns(df, text, {name: "bigint"}, make)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every task."""
    return np.random.default_rng(64).integers(0, 2**64, count, dtype=np.uint64)


def pivot_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference, one row for each reference."""
    return np.stack([np.bitwise_count(prints ^ p) for p in references]).astype(np.int8)


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set of each position; shortens the paths it walked."""
    found = parent[at]
    while (up := parent[found]).tobytes() != found.tobytes():
        found = up
    parent[at] = found
    return found


def _unite_all(parent: np.ndarray, one: int, others: np.ndarray) -> None:
    roots = _roots(parent, np.append(others, one))
    parent[roots] = roots.min()


def _scan(prints: np.ndarray, at: np.ndarray, parent: np.ndarray, radius: int, references: np.ndarray) -> None:
    """Unite all linked positions of ``at``: window on the sorted first pivot, discards on the others, verification.

    Positions that are known to be in one set already need no look.
    """
    table = pivot_table(prints[at], references)
    order = np.argsort(table[0], kind="stable")
    table, at = table[:, order], at[order]
    stops = np.searchsorted(table[0], table[0].astype(np.int16) + radius, side="right")
    own = prints[at]
    for i in range(len(at) - 1):
        near = i + 1 + np.flatnonzero(parent[at[i + 1 : stops[i]]] != parent[at[i]])
        for column in table[1:]:
            if len(near) <= SMALL:
                break
            near = near[np.abs(column[near] - column[i]) <= radius]
        near = near[np.bitwise_count(own[near] ^ own[i]) <= radius]
        if len(near):
            _unite_all(parent, at[i], at[near])


def _unite(prints: np.ndarray, at: np.ndarray, parent: np.ndarray, free: list[int], radius: int, references: np.ndarray) -> None:
    """Unite linked positions ``at``, which agree on all bits but ``free``.

    A large group first unites what a few leaders link; what is not yet one set is cut by blocks of its free bits.
    """
    parts = [free[i :: radius + 1] for i in range(radius + 1)]
    if len(at) <= LARGE or not all(parts):
        return _scan(prints, at, parent, radius, references)
    for i in np.linspace(0, len(at) - 1, LEADERS).astype(int):
        near = at[np.bitwise_count(prints[at] ^ prints[at[i]]) <= radius]
        _unite_all(parent, at[i], near)
    for part in parts:
        keys = prints[at] & np.uint64(sum(1 << b for b in part))
        order = np.argsort(keys, kind="stable")
        left = [b for b in free if b not in set(part)]
        for group in np.split(at[order], np.flatnonzero(np.diff(keys[order])) + 1):
            roots = _roots(parent, group)
            if (roots != roots[0]).any():
                _unite(prints, group, parent, left, radius, references)


def bucket_links(
    prints: np.ndarray, nodes: np.ndarray, bucket: np.ndarray, free: list[list[int]], radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the components within each bucket together: every node with the least one of its set.

    Rows are sorted by ``bucket`` (0, 1, ...) and then by node; ``free`` has the open bits of each bucket.
    """
    references = pivots()
    parent = np.arange(len(prints))
    sizes = np.bincount(bucket)
    small = sizes[bucket] <= SMALL
    table = pivot_table(prints, references)
    for step in range(1, SMALL):
        one = np.flatnonzero((bucket[:-step] == bucket[step:]) & small[:-step])
        if not len(one):
            break
        for column in table:
            one = one[np.abs(column[one] - column[one + step]) <= radius]
        for i in one[np.bitwise_count(prints[one] ^ prints[one + step]) <= radius].tolist():
            _unite_all(parent, i, np.array([i + step]))
    starts = np.cumsum(sizes) - sizes
    for b in np.flatnonzero(sizes > SMALL):
        _unite(prints, np.arange(starts[b], starts[b] + sizes[b]), parent, free[b], radius, references)
    roots = _roots(parent, np.arange(len(prints)))
    moved = roots != np.arange(len(prints))
    return nodes[moved], nodes[roots[moved]]


def block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` interleaved sets of the 64 bits."""
    return [sum(1 << b for b in range(i, 64, blocks)) for i in range(blocks)]


def blocks_for(distinct: int, radius: int) -> int:
    """Blocks such that a bucket key has about as many values as there are fingerprints: more rows, more key bits."""
    return next((b for b in range(radius + 1, radius + 5) if 64 * (b - radius) / b >= np.log2(max(2, distinct))), radius + 4)


def near_links(prints: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Links ``(u, v)`` between nodes of ``prints`` (``node`` bigint, ``fingerprint`` bigint, fingerprints distinct).

    Every bucket gives a spanning forest of its links and not all pairs, so no link is lost for reachability.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    masks = block_masks(blocks)
    key_masks = [sum(masks[b] for b in c) for c in chosen]
    open_bits = [[i for i in range(64) if not m >> i & 1] for m in key_masks]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in key_masks]
    keys = F.array(*(F.struct(F.lit(i).alias("way"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))
    spread = prints.select("node", "fingerprint", F.explode(keys).alias("key")).select("node", "fingerprint", "key.way", "key.bits")

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; only the open bucket is held."""
        held: list[pd.DataFrame] = []

        def close(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            way, bits = frame["way"].to_numpy(), frame["bits"].to_numpy()
            new = np.r_[True, (np.diff(way) != 0) | (np.diff(bits) != 0)]
            free = [open_bits[w] for w in way[new].tolist()]
            prints = frame["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
            u, v = bucket_links(prints, frame["node"].to_numpy(), np.cumsum(new) - 1, free, radius)
            yield pd.DataFrame({"u": u, "v": v})

        for frame in frames:
            if held:
                same = (frame["way"] == held[-1]["way"].iloc[-1]) & (frame["bits"] == held[-1]["bits"].iloc[-1])
                more = int(same.to_numpy().argmin()) if not same.all() else len(frame)
                held.append(frame.iloc[:more])
                if more == len(frame):
                    continue
                yield from close(pd.concat(held))
                frame, held = frame.iloc[more:], []
            last = (frame["way"] == frame["way"].iloc[-1]) & (frame["bits"] == frame["bits"].iloc[-1])
            cut = int(last.to_numpy().argmax())
            yield from close(frame.iloc[:cut]) if cut else ()
            held = [frame.iloc[cut:]]
        if held:
            yield from close(pd.concat(held))

    dealt = spread.repartition("way", "bits").sortWithinPartitions("way", "bits", "node")
    return dealt.mapInPandas(sweep, "u bigint, v bigint").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``fingerprint`` (bigint) and ``component_id``.

    ``component_id`` is the least key of the documents that can be reached over links of at most ``radius`` differing
    bits, the document itself included. Rows with a null key have a fingerprint, link nothing and have a null
    component. Rows that repeat a key each come back. Null and empty texts have fingerprint zero and link like any other.
    Only fingerprints and keys are shuffled; exact copies meet in a combined minimum before any pair is looked at.
    """
    marked = durable(fingerprints(df.select(F.col(f"`{key}`").cast("bigint").alias("node"), F.col(f"`{text}`").alias("text")), "text", shingle).drop("text"))
    distinct = durable(marked.groupBy("fingerprint").agg(F.min("node").alias("node")).where("node is not null"))
    found = components(near_links(distinct.select("node", "fingerprint"), radius))
    named = distinct.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    joined = marked.join(named, "fingerprint", "left")
    component = F.when(F.col("node").isNotNull(), F.col("component_id"))
    return joined.select(F.col("node").alias(key), "fingerprint", component.alias("component_id"))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``df`` whose key is the least of its component; of rows that repeat this key and text one stays.

    Rows with a null key are in no component and stay.
    """
    found = near_duplicates(df, key, text, radius)
    chosen = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__keep")).distinct()
    kept = df.join(chosen, df[key].cast("bigint") == F.col("__keep"), "left_semi").dropDuplicates([key, text])
    return kept.unionByName(df.where(F.col(key).isNull()))
