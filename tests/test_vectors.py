"""Inverted-file search: exact against brute force on odd vectors, recall of the nearest cells, cells that are not read."""

import math
import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from foliospark.operators.vectors import VectorTable
from foliospark.session import table

KIND = "id bigint, v array<double>"


def brute(rows, queries, k):
    def length(v):
        return math.sqrt(sum(x * x for x in v))

    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and length(v) > 0]
    out = set()
    for q, w in {q: w for q, w in queries if (q, w) in good}.items():
        scored = sorted((-round(sum(a * b for a, b in zip(v, w)) / length(v) / length(w), 6), i) for i, v in good)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


@pytest.fixture(scope="module")
def odd_rows():
    made = random.Random(3)
    near = lambda c: [x + made.gauss(0, 0.05) for x in c]
    rows = [(i, near(made.choice([(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, -1, 0)]))) for i in range(120)]
    rows += [(i, [0.0, 2.0, 0.0]) for i in range(200, 260)]  # one crowded cell of equal vectors, whose ties go to the smaller id
    return rows + [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 0.0]), (304, [float("nan"), 1.0, 0.0]), (305, [float("inf"), 1.0, 0.0]),
                   (306, [1.0, 0.0]), (None, [1.0, 0.0, 0.0])]


@pytest.mark.parametrize("cells", [1, 6, 30])
def test_exact_equals_brute_force(spark, tmp_path, odd_rows, cells):
    rows = spark.createDataFrame(odd_rows, KIND).withColumn("score", F.lit("clash")).withColumn("cell", F.lit(1))
    stored = VectorTable.write(rows, "id", "v", str(tmp_path / "t"), size=3, cells=cells)
    asked = rows.where("id % 7 = 0 or id >= 300")
    for k in (1, 5, 70):
        got = stored.nearest(asked.unionByName(asked), "id", "v", k, probes=2).best
        want = brute(odd_rows, [(i, v) for i, v in odd_rows if i is not None and (i % 7 == 0 or i >= 300)], k)
        rounded = lambda found: {(q, r, i, round(s, 5)) for q, r, i, s in found}
        assert rounded({tuple(r) for r in got.select("question", "rank", "id", "score").collect()}) == rounded(want)


def test_cells_that_cannot_reach_are_not_read(spark, tmp_path, odd_rows):
    rows = spark.createDataFrame(odd_rows, KIND)
    stored = VectorTable.write(rows, "id", "v", str(tmp_path / "t"), size=3, cells=12)
    asked = rows.where("id in (1, 2, 3, 4)")
    found = stored.nearest(asked, "id", "v", 3, probes=1)
    assert stored.rows_read(found) < 4 * 180 / 2
    near = stored.nearest(asked.where("id = 1"), "id", "v", 3, probes=1, exact=False)
    filters = re.findall(r"PartitionFilters: \[[^\]]*", plan_of(near.best))
    assert any(re.search(r"cell#\d+L? (=|IN) ", f) for f in filters) and near.pairs.count() == 1, filters


def test_empty_tables(spark, tmp_path, odd_rows):
    rows = spark.createDataFrame(odd_rows, KIND)
    none = VectorTable.write(rows.limit(0), "id", "v", str(tmp_path / "a"), size=3)
    assert none.nearest(rows, "id", "v", 3).best.count() == 0
    stored = VectorTable.write(rows, "id", "v", str(tmp_path / "b"), size=3)
    assert stored.nearest(rows.limit(0), "id", "v", 3).best.count() == 0


def test_recall_of_the_nearest_cells(spark, folder, tmp_path):
    """The given vectors are spread evenly over all directions, the worst case: it takes 15 of 22 cells for nine in ten."""
    rows = table(spark, folder, "embeddings")
    stored = VectorTable.write(rows, "vec_id", "embedding", str(tmp_path / "t"), size=64)
    asked = rows.where("vec_id % 20 = 0")
    exact = {(r["question"], r["id"]) for r in stored.nearest(asked, "vec_id", "embedding", 10).best.collect()}
    found = {(r["question"], r["id"]) for r in stored.nearest(asked, "vec_id", "embedding", 10, probes=15, exact=False).best.collect()}
    assert len(exact) == 250 and len(found & exact) >= 225


def test_blocks_meet_as_matrices(spark, folder, tmp_path, monkeypatch):
    """Small blocks cut crowded cells and questions; a question's vector is sent once a block and not once a row or cell."""
    from foliospark.operators import vectors

    rows = table(spark, folder, "embeddings").union(table(spark, folder, "embeddings").selectExpr("vec_id + 100000", "embedding", "label"))
    stored = VectorTable.write(rows, "vec_id", "embedding", str(tmp_path / "t"), size=64, cells=5)
    asked = rows.where("vec_id % 20 = 0")
    whole = stored.nearest(asked, "vec_id", "embedding", 10).best
    want = {tuple(r) for r in whole.select("question", "rank", "id", "score").collect()}
    for name, value in (("BLOCK_ROWS", 60), ("BLOCK_QUESTIONS", 7), ("SCORES_AT_ONCE", 100)):
        monkeypatch.setattr(vectors, name, value)
    assert max(b + n for _, b, n in stored._blocks()) > 10
    best = stored.nearest(asked, "vec_id", "embedding", 10).best
    assert {tuple(r) for r in best.select("question", "rank", "id", "score").collect()} == want
    assert "FlatMapCoGroupsInArrow" in plan_of(best) and len(want) == asked.count() * 10
