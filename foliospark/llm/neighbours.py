"""Approximate nearest neighbours by collision counting.

Vectors are projected on random directions, and each projection is a sorted array. Around a query's own projections
windows grow level by level (virtual rehashing: a wider window is the union of finer ones, nothing is hashed again), and
each vector's collisions, the windows that hold it, are counted from the newly covered flanks only. A vector whose
collisions reach the threshold is verified by its exact distance. A query ends when the k-th verified distance is so small
against the window that a nearer vector would have reached the threshold with high probability.

The sorted arrays are built for blocks of rows, and queries meet every block in blocks of their own, so no collision is
shuffled: a block gives its k best for each query, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = 64, share: float = 0.65, sure: float = 1.15, growth: float = 1.25, seed: int = 2):
        """A vector is verified at ``share`` of the ``projections``; ``sure`` is the window's half width over the distance
        up to which vectors are taken to have been verified; windows grow by ``growth``."""
        self.ids, self.vectors = ids, vectors
        self.need, self.sure, self.growth = int(np.ceil(share * projections)), sure, growth
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = vectors @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)  # one row for each projection
        self.sorted = np.take_along_axis(values.T, self.order.astype(np.int64), axis=1)
        spread = self.sorted[:, -1] - self.sorted[:, 0]
        self.seen = 0  # vectors verified so far, over all queries
        self.start = max(float(np.median(spread)) / 50, 1e-9)

    def search(self, query: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest vectors found whose id is not ``without``, ties to the smaller id."""
        n, centre = len(self.ids), query @ self.directions
        counts, verified = np.zeros(n, np.int32), np.zeros(n, bool)
        verified[self.ids == without] = True
        reach = max(float(np.abs(self.sorted[:, [0, -1]] - centre[:, None]).max()), self.start)
        halves = self.start * self.growth ** np.arange(int(np.ceil(np.log(reach / self.start) / np.log(self.growth))) + 2)
        low = np.stack([np.searchsorted(s, c - halves, "left") for s, c in zip(self.sorted, centre, strict=True)])
        high = np.stack([np.searchsorted(s, c + halves, "right") for s, c in zip(self.sorted, centre, strict=True)])
        ids, distances = np.zeros(0, np.int64), np.zeros(0)
        for level, half in enumerate(halves):
            a, b = low[:, level], high[:, level]
            if level:
                left, right = low[:, level - 1], high[:, level - 1]
                flanks = [o[i:j] for o, i, j in zip(self.order, a.tolist(), left.tolist(), strict=True)]
                flanks += [o[i:j] for o, i, j in zip(self.order, right.tolist(), b.tolist(), strict=True)]
            else:
                flanks = [o[i:j] for o, i, j in zip(self.order, a.tolist(), b.tolist(), strict=True)]
            counts += np.bincount(np.concatenate(flanks), minlength=n).astype(np.int32)
            new = np.flatnonzero((counts >= self.need) & ~verified)
            if len(new):
                verified[new] = True
                self.seen += len(new)
                gap = self.vectors[new] - query
                ids = np.concatenate([ids, self.ids[new]])
                distances = np.concatenate([distances, np.sqrt((gap * gap).sum(axis=1))])
                if len(ids) > 4 * k:
                    best = np.lexsort((ids, distances))[:k]
                    ids, distances = ids[best], distances[best]
            if level == len(halves) - 1 or verified.all() or len(ids) >= k and np.partition(distances, k - 1)[k - 1] * self.sure <= half:
                best = np.lexsort((ids, distances))[:k]
                break
        return ids[best], distances[best]


def usable(vector: Column) -> Column:
    """True for a vector of finite components that are not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block_rows: int = 8192, block_queries: int = 2048, **index
) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id``, ``rank`` (from 1), key, ``score`` (Euclidean distance, double).

    Candidates are all rows but those with the query's own key; ties go to the smaller key, and a query with fewer
    candidates returns them all. Rows and queries with a null key, or whose vector is null, empty, zero or has null or
    non-finite components, take no part; vectors of another length are never compared. Repeated rows are candidates each,
    a repeated query counts once. Every row is in the index.
    """
    own = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    clean = lambda df: df.select(F.col(f"`{key}`").cast("bigint").alias("id"), own.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("n", F.size("v"))
    data, asked = clean(rows), clean(queries).dropDuplicates(["id"])
    blocks, query_blocks = max(1, -(-data.count() // block_rows)), max(1, -(-asked.count() // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = data.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(query_blocks))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("block", every(blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            left = left.sort_values("id", kind="stable")
            made = CollisionIndex(left["id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.float64), **index)
            for query, v in zip(right["id"], right["v"], strict=True):
                out.append((query, *made.search(np.asarray(v, np.float64), k, query)))
        return pd.DataFrame(
            {
                "query_id": np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64),
                "id": np.concatenate([i for _, i, _ in out]) if out else np.zeros(0, np.int64),
                "score": np.concatenate([d for _, _, d in out]) if out else np.zeros(0),
            }
        )

    keys = ["block", "part", "n"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
