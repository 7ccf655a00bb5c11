"""Operators with a very frequent key, cut into many pieces, against brute force."""

import random
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from foliospark.operators import joins, ordered, search, splitting
from foliospark.sources import sinks

ROWS = 3000


@pytest.fixture(scope="module")
def pages():
    """Bundle 0 holds most rows, with runs that cross every range, equal order values and rows without type."""
    rnd = random.Random(5)
    rows, kinds = [], ["pay", "bank", None]
    kind = "pay"
    for i in range(ROWS):
        if rnd.random() < (0.02 if i < ROWS // 2 else 0.5):
            kind = rnd.choice(kinds)
        bundle = 0 if rnd.random() < 0.9 else rnd.randint(1, 20)
        rows.append((bundle, i // 3, i, kind))
    return rows


@pytest.fixture(scope="module")
def frame(spark, pages):
    return spark.createDataFrame(pages, "bundle int, page int, id int, doc_type string").repartition(8)


@pytest.mark.parametrize("rows_per_task", [10, 100, 10**6])
def test_row_index(frame, pages, rows_per_task):
    got = ordered.row_index(frame, ["bundle"], ["page", "id"], F.col("page"), "i", rows_per_task).collect()
    seen = Counter()
    want = {}
    for bundle, _, i, _ in sorted(pages, key=lambda r: (r[1], r[2])):
        want[i] = seen[bundle]
        seen[bundle] += 1
    assert {r["id"]: r["i"] for r in got} == want and len(got) == len(pages)


def brute_runs(pages):
    want, state = {}, {}
    for bundle, _, i, kind in sorted(pages, key=lambda r: (r[1], r[2])):
        last, run = state.get(bundle, (None, 0))
        if kind is not None and kind != last:
            run += 1
        state[bundle] = (kind, run)
        if kind is not None:
            want[i] = run
    return want


@pytest.mark.parametrize("rows_per_task", [7, 100, 10**6])
def test_run_numbers(frame, pages, rows_per_task):
    got = ordered.run_numbers(frame, ["bundle"], ["page", "id"], F.col("page"), "doc_type", "run", rows_per_task).collect()
    assert {r["id"]: r["run"] for r in got} == brute_runs(pages)
    assert len(got) == len(brute_runs(pages))


def test_null_order_values(spark):
    rows = [(1, None if i % 5 == 0 else i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    got = ordered.row_index(df, ["g"], ["o", "id"], F.col("o"), "i", 20).collect()
    want = {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {r["id"]: r["i"] for r in got} == want


def test_joined_text_parts_hold_everything(frame, pages):
    runs = splitting.page_runs(frame.withColumn("page", F.col("id")), ["bundle"], ["page"], F.col("page"), rows_per_task=50)
    parts = splitting.split_markdown(runs.withColumn("t", F.col("id").cast("string")), ["bundle"], "page", "t", rows_per_part=40).collect()
    assert max(p["markdown"].count("\n\n") for p in parts) < 40
    words = [w for p in parts for w in p["markdown"].split("\n\n")]
    assert sorted(map(int, words)) == sorted(i for _, _, i, k in pages if k is not None)
    whole = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        whole.setdefault((p["bundle"], p["run"]), []).extend(map(int, p["markdown"].split("\n\n")))
    assert all(v == sorted(v) for v in whole.values())


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_spread_join(spark, how):
    left = spark.range(2000).select(F.when(F.col("id") < 1200, 1).otherwise(F.col("id") % 50).cast("int").alias("k"), "id")
    left = left.union(spark.createDataFrame([(None, 9999)], "k int, id bigint"))
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40)] + [(1, "again"), (None, "null")], "k int, name string")
    got = joins.spread_join(left, right, ["k"], how, spread_by=["id"], rows_per_task=100)
    want = left.join(right, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_every_heavy_key_is_salted(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"))
    found = joins.heavy_keys(df, ["k"], 3).collect()
    assert len(found) == 5000 <= 20_000 / 3 and {r["__salts"] for r in found} == {2}


def test_sized_join_falls_back(spark):
    left = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = joins.sized_join(left, right, ["k"], most_rows=10, spread_by=["id"])
    large = joins.sized_join(left, right, ["k"], most_rows=3, spread_by=["id"], rows_per_task=5)
    assert sorted(small.collect()) == sorted(large.select(*small.columns).collect())
    assert "BroadcastHashJoin" in plan_of(small)


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 1).alias("g"), F.col("id").alias("v"))
    top = ordered.first_rows(df, ["g"], [F.desc("v")], 3)
    assert plan_of(top).count("WindowGroupLimit") == 2
    assert [r["v"] for r in top.orderBy("rank").collect()] == [999, 998, 997]


def test_envelopes_are_cut_into_parts(spark):
    docs = spark.range(95).select(F.lit("b").alias("batch"), "id", F.col("id").cast("string").alias("text"))
    parts = sinks.envelopes(docs, ["batch"], "id", F.col("id"), rows_per_part=20).collect()
    assert [len(p["documents"]) for p in sorted(parts, key=lambda p: p["part"])] == [20, 20, 20, 20, 15]
    assert {p["parsed_count"] for p in parts} == {95}
    assert sorted(d["id"] for p in parts for d in p["documents"]) == list(range(95))


def test_bm25_is_the_formula(spark):
    import math

    texts = {"a": "red fox and red hen", "b": "blue fox", "c": "green", "d": ""}
    docs = spark.createDataFrame(list(texts.items()), "chunk string, body string")
    index = search.postings(docs, "chunk", "body")
    size, mean = search.corpus_size(index, "chunk")
    assert (size, mean) == (3, 8 / 3)
    queries = spark.createDataFrame([(1, "Red fox"), (2, "nothing here")], "q int, text string")
    got = {(r["q"], r["chunk"]): r["score"] for r in search.search(index, size, mean, queries, "q", "text", "chunk").collect()}

    def score(terms, words):
        total = 0.0
        for t in terms:
            df = sum(t in w.split() for w in texts.values())
            tf = words.count(t)
            if tf:
                total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        return round(total, 6)

    assert got == {(1, k): score(["red", "fox"], texts[k].split()) for k in "ab"}


def test_term_counts(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "c", "c", "c"],), ([],), (["z"],)], "w array<string>")
    got = [[(e["term"], e["tf"]) for e in r[0]] for r in rows.select(search.term_counts(F.col("w"))).collect()]
    assert got == [[("a", 2), ("b", 1), ("c", 3)], [], [("z", 1)]]


def test_rendered_answer(spark):
    hits = spark.createDataFrame([(2, "b.pdf", 1.005, "x" * 600), (1, None, 2.0, "y")], "rank int, source string, score double, content string")
    answer = search.rendered(hits, "q").first()[0].split("\n\n---\n\n")
    assert answer[0] == "**Source:** Unknown source (Relevance: 2.00)\ny..."
    assert answer[1].startswith("**Source:** b.pdf (Relevance: 1.0") and answer[1].endswith("x" * 500 + "...")
    assert search.rendered(hits.where("rank > 5"), "q").first()[0].startswith("No documents found for query: 'q'.")
