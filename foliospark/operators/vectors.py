"""Vector search by an inverted file: rows are stored by their nearest centre, and a question reads the cells that matter to it."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .ordered import first_rows

# Scores are rounded to six digits, so a cell is read if its bound reaches the score to be beaten up to this.
SLACK = 2e-6
# Rows and questions of one block, and scores that a task holds at once.
BLOCK_ROWS = 16_384
BLOCK_QUESTIONS = 8_192
SCORES_AT_ONCE = 1 << 21


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(vector: Column, size: int | None = None) -> Column:
    """True for a vector of finite numbers, of the given size if any, whose length is neither zero nor beyond a double."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = product(vector, vector)
    sized = F.size(vector) == size if size is not None else F.size(vector) > 0
    return F.coalesce(sized & finite & (squares > 0) & (squares < float("inf")), F.lit(False))


def as_doubles(df: DataFrame, key: str, vector: str, size: int | None, *names: str) -> DataFrame:
    """Key, vector of doubles and its length, of the rows that have a key and a usable vector, under ``names``."""
    rows = df.select(F.col(key).alias(names[0]), F.transform(F.col(vector), lambda x: x.cast("double")).alias(names[1]))
    kept = rows.where(F.col(names[0]).isNotNull() & usable(F.col(names[1]), size))
    return kept.withColumn(names[2], F.sqrt(product(F.col(names[1]), F.col(names[1]))))


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and column of the ``k`` greatest scores of each line, equal ones by column."""
    if scores.shape[1] <= k:
        return tuple(i.ravel() for i in np.indices(scores.shape))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    line, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((column, -scores[line, column], line))
    line, column = line[order], column[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    return line[rank < k], column[rank < k]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def cell_finder(cells: list[dict], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to questions (``question, asked, length``) all cells, nearest first, with the greatest cosine that a row in each can have."""
    cells = sorted(cells, key=lambda c: c["cell"])
    numbers = np.array([c["cell"] for c in cells], np.int32)
    centres = np.array([c["centre"] for c in cells])
    centres = centres / np.sqrt((centres * centres).sum(axis=1))[:, None]
    widest = np.arccos(np.clip([c["least"] for c in cells], -1.0, 1.0))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES_AT_ONCE // len(cells))
        for part in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            cosine = matrix(part.column(1), size) @ centres.T / part.column(2).to_numpy()[:, None]
            most = np.cos(np.maximum(0.0, np.arccos(np.clip(cosine, -1.0, 1.0)) - widest))
            order = np.argsort(-cosine, axis=1, kind="stable")
            listed = pa.StructArray.from_arrays([pa.array(numbers[order].ravel()), pa.array(np.take_along_axis(most, order, axis=1).ravel())], names=["cell", "most"])
            ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(cells))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, listed)], names=["question", "asked", "length", "near"])

    return find


def block_scorer(k: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores a block of questions (``question, asked, length, cells``) with one of rows (``id, vector, norm, cell``)."""

    def score(questions: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        asked, vectors = (matrix(c.combine_chunks(), size) for c in (questions["asked"], rows["vector"]))
        length, norm, cell = (c.to_numpy() for c in (questions["length"], rows["norm"], rows["cell"]))
        listed = questions["cells"].combine_chunks()
        of_pair = np.repeat(np.arange(len(questions)), listed.value_lengths().to_numpy())
        cell_of_pair = listed.flatten().to_numpy()
        found = []
        for c in np.unique(cell):
            inside, who = np.nonzero(cell == c)[0], of_pair[cell_of_pair == c]
            step = max(1, SCORES_AT_ONCE // len(inside))
            for part in (who[i : i + step] for i in range(0, len(who), step)):
                scores = (asked[part] @ vectors[inside].T) / (length[part][:, None] * norm[inside])
                scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5), scores) / 1e6 + 0.0
                line, column = best_of(scores, k)
                found.append((part[line], inside[column], scores[line, column]))
        line, row, value = (np.concatenate(x) if found else np.empty(0, int) for x in (zip(*found) if found else ((),) * 3))
        order = np.lexsort((row, -value, line))
        line, row, value = line[order], row[order], value[order]
        kept = np.arange(len(line)) - np.searchsorted(line, line) < k
        return pa.table({
            "question": questions["question"].take(pa.array(line[kept])), "id": rows["id"].take(pa.array(row[kept])), "score": pa.array(value[kept], pa.float64()),
        })

    return score


@dataclass
class Found:
    """``best``: the ranked rows. ``pairs``: the (question, cell) pairs whose rows were scored."""

    best: DataFrame
    pairs: DataFrame


@dataclass
class VectorTable:
    """Rows ``id, vector, norm`` in one folder a cell, and one row a cell: ``cell, centre, least`` (smallest cosine of its rows
    with the centre), ``rows``."""

    rows: DataFrame
    cells: list[dict]
    size: int

    @classmethod
    def write(
        cls, vectors: DataFrame, key: str, vector: str, path: str, size: int, cells: int | None = None, sample_rows: int = 50_000, most_cells: int = 4096,
    ) -> VectorTable:
        """Store the vectors of ``size`` numbers; others, and zero, null and non-finite ones, have no cosine and are left out.

        ``cells`` is the root of the row count if not given, at most ``most_cells``: cells are all that reaches the driver. Centres are
        fitted on about ``sample_rows`` rows, chosen by a hash of the key; every row is stored. Rows are dealt by ranges of cell and
        hash, so a cell that holds most rows is written by many tasks.
        """
        spark = vectors.sparkSession
        clean = as_doubles(vectors, key, vector, size, "id", "vector", "norm")
        count = clean.count()
        if not count:
            return cls(spark.createDataFrame([], clean.schema).withColumn("cell", F.lit(0)), [], size)
        wanted = max(1, min(most_cells, count, round(count**0.5) if cells is None else cells))
        sample = clean.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // sample_rows))) == 0)
        # Few rows may all fall out of the sample; then all are taken.
        sample = (sample if count > sample_rows else clean).select(array_to_vector("vector").alias("features"))
        model = KMeans(k=max(2, wanted), distanceMeasure="cosine", maxIter=10, seed=7, predictionCol="cell").fit(sample)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        placed = model.transform(clean.withColumn("features", array_to_vector("vector"))).drop("features")
        placed.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(path)
        rows = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in clean.dtypes)}, cell int").parquet(path)
        centre = F.element_at(cls._constant(centres, "array<array<double>>"), F.col("cell") + 1)
        cosine = product(F.col("vector"), centre) / (F.col("norm") * F.sqrt(product(centre, centre)))
        bounds = rows.groupBy("cell").agg(F.min(cosine).alias("least"), F.count(F.lit(1)).alias("rows")).collect()
        return cls(rows, [{"cell": b["cell"], "centre": centres[b["cell"]], "least": b["least"], "rows": b["rows"]} for b in bounds], size)

    @staticmethod
    def _constant(value: list, kind: str) -> Column:
        """A constant that the optimizer folds, given as one text instead of one expression a number."""
        return F.from_json(F.lit(json.dumps(value)), kind)

    def _asked(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        """Each question with all cells, nearest first: the cosine of its centre and the greatest that a row in it can have."""
        asked = as_doubles(queries, key, vector, self.size, "question", "asked", "length").dropDuplicates(["question"])
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        kinds = ", ".join(f"{n} {t}" for n, t in asked.dtypes)
        return asked.mapInArrow(cell_finder(self.cells, self.size), f"{kinds}, near array<struct<cell: int, most: double>>")

    def _blocks(self) -> list[tuple[int, int, int]]:
        """Cell, its first block and its number of blocks: cells side by side up to ``BLOCK_ROWS`` rows, a larger one cut."""
        placed, block, held = [], 0, 0
        for c in sorted(self.cells, key=lambda c: c["cell"]):
            if held and held + c["rows"] > BLOCK_ROWS:
                block, held = block + 1, 0
            parts = -(-c["rows"] // BLOCK_ROWS)
            placed.append((c["cell"], block, parts))
            block, held = (block + parts, 0) if parts > 1 else (block, held + c["rows"])
        return placed

    def _scored(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """The ``k`` best rows of each question (``question, asked, length``) among the cells it is paired with; other cells are not read.

        Blocks of rows meet blocks of questions, each pair of blocks is scored as products of matrices and leaves ``k`` rows a
        question. So a vector is sent once for each block on the other side and not once for each pair of question and row.
        """
        spark = pairs.sparkSession
        read = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most all cells
        # At most all cells as well.
        blocks = F.broadcast(spark.createDataFrame(self._blocks(), "cell int, block int, parts int"))
        groups = max(1, -(-asked.count() // BLOCK_QUESTIONS))
        rows = self.rows.where(F.col("cell").isin(read)).join(blocks, "cell")
        rows = rows.select(
            "id", "vector", "norm", "cell", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share"),
        )
        wanted = pairs.join(blocks, "cell").select("question", "cell", F.explode(F.sequence("block", F.col("block") + F.col("parts") - 1)).alias("block"))
        wanted = wanted.groupBy("question", "block").agg(F.collect_list("cell").alias("cells")).join(asked.select("question", "asked", "length"), "question")
        wanted = wanted.withColumn("share", F.pmod(F.xxhash64("question"), F.lit(groups)).cast("int"))
        kinds = dict(wanted.dtypes)["question"], dict(rows.dtypes)["id"]
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        met = wanted.groupBy("block", "share").cogroup(rows.groupBy("block", "share")).applyInArrow(
            block_scorer(k, self.size), f"question {kinds[0]}, id {kinds[1]}, score double"
        )
        return first_rows(met, ["question"], [F.desc("score"), F.col("id")], k)

    def nearest(self, queries: DataFrame, key: str, vector: str, k: int, probes: int = 8, exact: bool = True) -> Found:
        """The ``k`` rows of greatest cosine for each question: ``question, rank, id, score`` (six digits); ties go to the smaller id.

        The ``probes`` nearest cells of each question are read first. With ``exact`` all other cells follow in which a row can still
        reach the question's k-th score: by the triangle inequality a row is no nearer than its centre's angle less the widest
        angle of the cell. A question without a usable vector has no row, and one asked twice counts once.
        """
        if not self.cells:
            kind = f"question {dict(queries.dtypes)[key]}, id {dict(self.rows.dtypes)['id']}, score double, rank int"
            none = queries.sparkSession.createDataFrame([], kind)
            return Found(none, none.select("question", F.lit(0).alias("cell")))
        asked = durable(self._asked(queries, key, vector))
        first = asked.select("question", F.explode(F.slice("near", 1, probes)).alias("n")).select("question", "n.cell")
        best = self._scored(asked, first, k)
        if not exact:
            return Found(best, first)
        best = durable(best)
        # No score to reach yet where fewer than ``k`` rows were found.
        reach = best.groupBy("question").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reach"))
        later = F.slice("near", probes + 1, len(self.cells))
        open_cells = asked.join(reach, "question", "left").select("question", "reach", F.explode(later).alias("n"))
        more = durable(open_cells.where(F.col("reach").isNull() | (F.col("n.most") + SLACK >= F.col("reach"))).select("question", "n.cell"))
        both = best.drop("rank").unionByName(self._scored(asked, more, k).drop("rank"))
        ranked = first_rows(both, ["question"], [F.desc("score"), F.col("id")], k)
        return Found(ranked, first.unionByName(more))

    def rows_read(self, found: Found) -> int:
        """Number of (question, row) pairs that were scored."""
        sizes = {c["cell"]: c["rows"] for c in self.cells}
        return sum(sizes[r["cell"]] * r["count"] for r in found.pairs.groupBy("cell").count().collect())
