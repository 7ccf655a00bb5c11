import numpy as np

from foliospark.llm import neighbours


def exact(vectors, query, k):
    own = np.array(vectors[query], float)
    found = sorted((float(np.sqrt(((np.array(v, float) - own) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return found[:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(1500)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(rows, rows.where("vec_id % 100 = 0"), block_rows=400, block_queries=8).collect()
    hits = 0
    for q in range(0, 1500, 100):
        want = exact(vectors, q, 10)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((np.array(vectors[i]) - np.array(vectors[q])) ** 2).sum())) < 1e-9 for _, i, s in mine)
        hits += len({m[1] for m in mine} & {i for _, i in want})
    assert hits >= 0.9 * 150


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []), (10, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, table).collect()
    mine = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert mine == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, np.sqrt(2.0))]
    assert {r["query_id"] for r in got} == {0, 1, 2, 3}  # 8 has no candidate of its length
    assert neighbours.nearest(table.limit(0), table).count() == 0
    assert neighbours.nearest(table, table.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    table = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(300)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id = 100"), block_rows=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10))
