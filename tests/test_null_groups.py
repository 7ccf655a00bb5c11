"""Null groups, repeated runs and odd values: nothing is lost above a size, and one odd row fails no query."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import filings, flatten, invoices, ordered, search
from foliospark.operators.joins import left_join_spreading_nulls
from foliospark.sources import sinks


@pytest.fixture
def rows(spark):
    made = [(None if i % 4 == 0 else f"g{i % 3}", None if i % 5 == 0 else i % 2, i, "a" if i // 7 % 2 else "b") for i in range(200)]
    return spark.createDataFrame(made, "g string, h int, i int, v string")


@pytest.mark.parametrize("group", [["g"], ["g", "h"]])
def test_both_sizes_give_the_same(rows, group):
    small = ordered.row_index(rows, group, ["i"], F.col("i"))
    large = ordered.row_index(rows, group, ["i"], F.col("i"), rows_per_task=7)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and large.count() == 200
    small = ordered.run_numbers(rows, group, ["i"], F.col("i"), "v")
    large = ordered.run_numbers(rows, group, ["i"], F.col("i"), "v", rows_per_task=7)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(small.columns).collect())) and large.count() == 200


def test_envelopes_with_null_batch_columns(spark):
    docs = spark.createDataFrame([("t", None, f"f{i % 2}", i) for i in range(10)] + [("t", "p/", None, i) for i in range(10, 15)], "trigger string, prefix string, specific_file string, id int")
    got = sinks.envelopes(docs, ["trigger", "prefix", "specific_file"], "id", F.col("id"), rows_per_part=3).collect()
    assert sorted(d["id"] for r in got for d in r["documents"]) == list(range(15))
    assert {(r["prefix"], r["specific_file"], r["parsed_count"]) for r in got} == {(None, "f0", 5), (None, "f1", 5), ("p/", None, 5)}


def test_short_document_is_one_part(spark):
    pages = spark.createDataFrame([("d", i, f"t{i}") for i in range(990, 1010)] + [(None, 5, "x")], "doc string, page int, text string")
    got = {r["doc"]: (r["part"], r["markdown"]) for r in ordered.joined_text(pages, ["doc"], "page", "text").collect()}
    assert got == {"d": (0, "\n\n".join(f"t{i}" for i in range(990, 1010))), None: (0, "x")}
    parts = ordered.joined_text(pages, ["doc"], "page", "text", rows_per_part=8).where("doc = 'd'").orderBy("part").collect()
    assert "\n\n".join(r["markdown"] for r in parts) == got["d"][1] and [r["part"] for r in parts] == [0, 1, 2]


def test_parts_are_cut_by_bytes(spark):
    texts = [("d", i, "x" * (1000 * (i % 7))) for i in range(200)] + [("d", None, "first"), ("e", 1, "y" * 50_000), ("e", 2, None), ("e", 3, "z")]
    pages = spark.createDataFrame(texts, "doc string, page int, text string")
    for rows_per_task in (10**6, 9):
        got = ordered.joined_text(pages, ["doc"], "page", "text", bytes_per_part=10_000, rows_per_task=rows_per_task).orderBy("part").collect()
        d, e = [r for r in got if r["doc"] == "d"], [r for r in got if r["doc"] == "e"]
        assert "\n\n".join(r["markdown"] for r in d) == "\n\n".join(t for k, _, t in sorted(texts[:201], key=lambda r: (r[1] is not None, r[1] or 0)))
        assert max(len(r["markdown"]) for r in d) < 10_000 + 6002 and len(d) > 50
        assert [(r["part"], r["markdown"][:1]) for r in e] == [(0, "y"), (5, "z")]


def test_ties_of_the_order_value_fill_several_ranges(spark):
    rows = spark.range(4000).select(F.lit("g").alias("g"), F.lit(1).alias("o"), "id")
    cut = ordered.in_ranges(rows, ["g"], ["o", "id"], F.col("o"))
    sizes = [r["count"] for r in cut.groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    placed = ordered.row_index(rows, ["g"], ["o", "id"], F.col("o"), "i", rows_per_task=10)
    assert placed.where("i <> id").count() == 0


def test_zero_vectors_have_no_cosine(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    scores = search.cosine_scores(vectors, "id", "v", [1.0, 0.0])
    assert {r["id"]: r["score"] for r in scores.collect()} == {1: 1.0, 2: None, 3: 0.707107}
    assert [r["id"] for r in search.best_rows(scores, "id", 5).orderBy("rank").collect()] == [1, 3]
    assert {r["score"] for r in search.cosine_scores(vectors, "id", "v", [0.0, 0.0]).collect()} == {None}


def test_requested_entities_without_filings(spark):
    made = spark.createDataFrame([("a", "10-K", 2020, 1)], "cik string, form_type string, year int, quarter int")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "cik string")
    got = sorted((r["cik"] or "", r["year"]) for r in filings.missing_periods(made, ["cik"], "10-K", [2020, 2021], requested=asked).collect())
    assert got == [("", 2020), ("", 2021), ("a", 2021), ("b", 2020), ("b", 2021)]


SCHEMA = {
    "type": "object",
    "properties": {
        "a": {"type": "string"},
        "d": {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]},
        "lines": {"type": "array", "items": {"type": "object", "properties": {"q": {"type": "number"}}, "required": ["q"], "additionalProperties": False}},
        "tags": {"type": "array", "items": {"type": "string"}},
        "grid": {"type": "array", "items": {"type": "array", "items": {"type": "string"}}},
        "x.y": {"type": "integer"},
        "maybe": {"type": ["string", "null"]},
        "e": {"type": "array", "items": {"type": "string", "enum": ["p"]}},
        "deep": {"type": "array", "items": {"type": "array", "items": {"type": "object", "properties": {"q": {"type": "number"}}, "required": ["q"]}}},
    },
    "required": ["a"],
}


@pytest.mark.parametrize(
    "document, broken",
    [
        ('{"a":"x"}', []),
        ('{"a":"x","d":{}}', ["d.k: required"]),
        ('{"a":"x","d":5}', ["d: type"]),
        ('{"a":"x","lines":[{"q":1},{"q":"bad","z":1},{}]}', ["lines[].q: required", "lines[].q: type", "lines[].z: not allowed"]),
        ('{"a":"x","lines":[3]}', ["lines[]: type"]),
        ('{"a":"x","lines":[],"tags":["t",1]}', ["tags[]: type"]),
        ('{"tags":3}', ["a: required", "tags: type"]),
        ('{"a":"x","grid":[["s"],[1],"t",null]}', ["grid[]: type", "grid[][]: type"]),
        ('{"a":"x","grid":[["s"],[]],"x.y":1.0,"e":["p","q"]}', ["e[]: enum"]),
        ('{"a":"x","x.y":1.5,"maybe":null}', ["x.y: type"]),
        ('{"a":"x","x.y":null,"maybe":3}', ["maybe: type", "x.y: type"]),
        ('{"a":"x","deep":[[{"q":"t"}],[{}]]}', ["deep[][].q: required", "deep[][].q: type"]),
    ],
)
def test_schema_rules(spark, document, broken):
    rows = spark.createDataFrame([(document,)], "j string").select(F.parse_json("j").alias("doc"))
    assert sorted(rows.select(flatten.violations(F.col("doc"), SCHEMA).alias("v")).first()["v"]) == broken


def test_fields_of_two_types_become_text(spark):
    rows = spark.createDataFrame([(1, "A", '{"x":"one"}'), (2, "B", '{"x":2,"y":3}'), (3, "C", "{}")], "id int, kind string, j string")
    got = flatten.read_by_type(rows, "j", "kind", {"A": "x string", "B": "x bigint, y bigint"}).orderBy("id").collect()
    assert [(r["x"], r["y"], r["known_type"]) for r in got] == [("one", None, True), ("2", 3, True), (None, None, False)]


def test_left_join_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(None if i % 2 else f"k{i % 4}", i) for i in range(100)], "k string, i int")
    right = spark.createDataFrame([("k0", "zero"), (None, "never")], "k string, r string")
    got = left_join_spreading_nulls(left, right, "k").collect()
    assert sorted((r["i"], r["r"]) for r in got) == [(i, "zero" if i % 4 == 0 else None) for i in range(100)]


def test_unnamed_documents_do_not_share_keys(spark):
    parsed = "struct<filename: string, version: string>"
    docs = spark.createDataFrame([(i, (None, "v")) for i in range(3)], f"doc_id int, metadata {parsed}")
    keyed = invoices.stamp_keys(docs, "r", F.lit("unknown"), F.lit("v"), F.coalesce("metadata.filename", F.concat_ws("/", F.lit("r"), F.col("doc_id"))))
    assert keyed.select("INVOICE_UUID").distinct().count() == 3
