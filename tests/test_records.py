"""Responses, schemas, conformance, provenance and files, on small hand-written inputs."""

import json
from datetime import date

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark import schemas
from foliospark.operators import chunks, filings, flatten, invoices, provenance, splitting, summaries
from foliospark.plans import derive, record_plans
from foliospark.sources import listings, responses, sinks


@pytest.fixture
def parse_files(tmp_path):
    box = {"left": 0.1, "top": 0.2, "right": 0.9, "bottom": 0.4}
    first = {
        "chunks": [
            {"id": "u1", "type": "text", "markdown": "<a id='u1'></a>\n\nTotal due 10", "grounding": {"page": 0, "box": box}},
            {"id": "u2", "type": "table", "markdown": "<a id='u2'></a>\n\n<table></table>", "grounding": {"page": 2, "box": box}},
        ],
        "markdown": "Total due 10", "metadata": {"filename": "one.pdf", "page_count": 3, "version": "v1", "duration_ms": 5000, "credit_usage": 3},
        "splits": [], "grounding": {"u1": {"page": 0, "type": "chunkText", "box": box}, "0-3": {"page": 1, "type": "tableCell", "box": box}},
    }
    second = {"chunks": [], "markdown": "", "metadata": {"filename": "two.pdf"}, "splits": [], "grounding": {}}
    (tmp_path / "parse_one.json").write_text(json.dumps(first, indent=2))
    (tmp_path / "parse_two.json").write_text(json.dumps(second, indent=2))
    (tmp_path / "notes.md").write_text("# kept\nwhole")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "P1.PDF").write_bytes(b"x" * 2048)
    return tmp_path


def test_parse_files(spark, parse_files):
    rows = responses.read_responses(spark, str(parse_files), pattern="parse_*.json")
    assert rows.count() == 2
    stats = {r["metadata"]["filename"]: r for r in chunks.document_statistics(rows, "metadata").collect()}
    assert stats["one.pdf"]["total_pages"] == 3 and stats["one.pdf"]["chunk_types"] == {"text": 1, "table": 1}
    assert stats["two.pdf"]["total_pages"] == 1 and stats["two.pdf"]["total_chunks"] == 0
    table = chunks.chunk_rows(rows.withColumn("d", F.col("metadata.filename")), "d", "t", "v", "m").orderBy("chunk_sequence_number").collect()
    assert [(r["chunk_id"], r["prev_chunk_id"], r["next_chunk_id"]) for r in table] == [("u1", None, "u2"), ("u2", "u1", None)]
    assert table[0]["chunk_content"] == "Total due 10" and table[0]["chunk_word_count"] == 3 and table[0]["chunk_image_path"] is None
    assert provenance.grounding_rows(rows.withColumn("doc", F.col("metadata.filename")), "doc").count() == 2


def test_listing_and_whole_files(spark, parse_files):
    root = f"file:{parse_files}"
    files = listings.list_files(spark, str(parse_files))
    assert files.count() == 4 and files.columns == ["path", "length", "modificationTime"]
    assert [r["path"] for r in listings.with_endings(files, ("pdf",)).collect()] == [f"{root}/sub/P1.PDF"]
    assert listings.with_endings(files, ("pdf",), in_folder=root).count() == 0
    assert [r["Size"] for r in listings.object_table(files, f"{root}/sub").collect()] == ["2.0 KB"]
    assert [tuple(r) for r in listings.read_markdown(spark, str(parse_files)).collect()] == [("notes.md", "# kept\nwhole")]
    assert tuple(listings.folder_state(files, f"{root}/sub", 5).first()) == (1, 4)


def test_latest_csv(spark, tmp_path):
    import os

    for i, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / name).write_text(f"x,y\n{i},z\n")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    files = listings.list_files(spark, str(tmp_path))
    rows = listings.read_latest_csv(spark, files, f"file:{tmp_path}", "x bigint, y string")
    assert [tuple(r) for r in rows.collect()] == [(1, "z")]
    both = listings.read_latest_csv(spark, files, f"file:{tmp_path}", "x bigint, y string", whole_folder=True)
    assert sorted(tuple(r) for r in both.collect()) == [(0, "z"), (1, "z")]
    assert listings.read_latest_csv(spark, files, "file:/nowhere", "x bigint, y string").count() == 0


def test_json_schema_types():
    got = schemas.spark_type({
        "type": "object",
        "properties": {
            "s": {"type": "string"}, "d": {"type": "string", "format": "date"}, "n": {"type": ["number", "null"]},
            "i": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "b": {"type": "boolean"},
            "l": {"type": "array", "items": {"$ref": "#/$defs/item"}},
        },
        "$defs": {"item": {"type": "object", "properties": {"q": {"type": "number"}}}},
    })
    assert got.simpleString() == "struct<s:string,d:date,n:double,i:bigint,b:boolean,l:array<struct<q:double>>>"


def test_bad_leaves_become_null(spark):
    df = spark.createDataFrame([('{"d":"2024-13-01","n":3}',), ("junk",), ('{"d":"2024-01-02"}',)], "j string")
    rows = flatten.read_as(df, "j", "d date, n double", "e").select("e.d", "e.n").collect()
    assert [tuple(r) for r in rows] == [(None, 3.0), (None, None), (date(2024, 1, 2), None)]


def test_violations(spark):
    schema = {
        "type": "object",
        "properties": {"a": {"type": "string"}, "e": {"type": "string", "enum": ["x", "y"]}, "n": {"type": "integer"}},
        "required": ["a", "e"], "additionalProperties": False,
    }
    docs = ['{"a":"1","e":"x","n":1}', '{"a":null,"e":"z"}', '{"e":"y","n":"1","q":1,"b":2}', '{"a":5,"e":"x","n":null}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").select(F.parse_json("j").alias("v"))
    got = [r[0] for r in df.select(flatten.violations(F.col("v"), schema)).collect()]
    assert got == [[], ["a: required", "e: enum"], ["a: required", "n: type", "b,q: not allowed"], ["a: type", "n: type"]]


def test_dispatch_keeps_unknown_types(spark):
    rows = [("Invoice", '{"total": 3, "name": "n"}'), ("RECEIPT", '{"total": 4}'), ("letter", "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "kind string, body string")
    registry = {"invoice": "total double, name string", "receipt": "total double"}
    got = flatten.read_by_type(df, "body", "kind", registry)
    assert got.columns == ["kind", "known_type", "total", "name"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("Invoice", True, 3.0, "n"), ("RECEIPT", True, 4.0, None), ("letter", False, None, None), (None, False, None, None)], key=str
    )


def test_flatten_names_and_arrays(spark):
    df = spark.createDataFrame([("d", ((1, "x"), [1, 2]))], "name string, e struct<a struct<b int, c string>, l array<int>>")
    row = flatten.summary_rows(df, "name", "e").first()
    assert row.asDict() == {"document_name": "d", "a_b": 1, "a_c": "x", "l": "[1,2]"}


def test_first_and_all_references(spark):
    box = "struct<left double, top double, right double, bottom double>"
    schema = f"doc string, meta struct<f struct<references array<string>>, g struct<references array<string>>>, grounding map<string, struct<page int, type string, box {box}>>"
    ground = {"u1": (0, "chunkText", (0.1, 0.2, 0.3, 0.4)), "u2": (1, "chunkText", (0.1, 0.2, 0.3, 0.4))}
    df = spark.createDataFrame([("d", ((["u1", "gone"],), (["u2"],)), ground), ("e", (([],), (None,)), {})], schema)
    boxes = provenance.first_reference_boxes(df, "doc", "meta", ["f", "g"]).collect()
    assert [(r["field"], r["ground_id"], r["box_left"]) for r in boxes] == [("f", "u1", 0.1)]
    refs = provenance.all_references(df, "doc", "meta", ["f", "g"]).collect()
    assert sorted((r["field"], r["ground_id"], r["page"]) for r in refs if r["page"] is not None) == [("f", "u1", 0), ("g", "u2", 1)]
    assert [(r["field"], r["ground_id"]) for r in refs if r["page"] is None] == [("f", "gone")]


def test_product_summary_is_strict(spark):
    record = {f: "x" for f in schemas.PRODUCT_TEXT} | {f: 1 for f in schemas.PRODUCT_NUMBERS} | {f: None for f in schemas.PRODUCT_FLAGS}
    meta = {"product_name": {"references": ["a"]}}
    make = lambda r: spark.createDataFrame([("p", json.dumps(r), json.dumps(meta))], "n string, d string, m string").select(
        "n", F.parse_json("d").alias("d"), F.parse_json("m").alias("m")
    )
    row = invoices.product_summary(make(record), "n", "d", "m").first()
    assert len(row) == 32 and row["product_name_chunks"] == "['a']" and row["brand_chunks"] == "[]" and row["is_kosher"] is None
    del record["is_kosher"]
    with pytest.raises(Exception, match="record has no field is_kosher"):
        invoices.product_summary(make(record), "n", "d", "m").collect()


def test_product_records_are_read_once(spark, folder):
    """Not once for every column, and wrong kinds are null as they are for a getter of one field."""
    plan = plan_of(record_plans.product_summary(spark, folder))
    assert plan.count("variant_get(") == 3
    record = {f: 7 for f in schemas.PRODUCT_TEXT} | {f: "1.5" for f in schemas.PRODUCT_NUMBERS} | {f: {"a": 1} for f in schemas.PRODUCT_FLAGS}
    df = spark.createDataFrame([(json.dumps(record), '{"brand": {"references": [1, null, "it\'s"]}, "product_name": 3}')], "d string, m string")
    docs = df.select(F.lit("p").alias("n"), F.parse_json("d").alias("d"), F.parse_json("m").alias("m"))
    row = invoices.product_summary(docs, "n", "d", "m").first().asDict()
    one = lambda field, kind: docs.select(F.try_variant_get("d", f"$.{field}", kind)).first()[0]
    assert [row[f] for f in ("flavor", "net_weight_oz", "servings_per_container", "is_kosher")] == [
        one("flavor", "string"), one("net_weight_oz", "double"), one("servings_per_container", "bigint"), one("is_kosher", "boolean")
    ]
    assert row["brand_chunks"] == """['1', None, "it's"]""" and row["product_name_chunks"] == "[]"
    odd = docs.select("n", F.parse_json(F.lit("[1]")).alias("d"), "m")
    with pytest.raises(Exception, match="record has no field product_name"):
        invoices.product_summary(odd, "n", "d", "m").collect()


def test_totals_skip_nulls_and_empty_names(spark):
    df = spark.createDataFrame([(1.1, "a", ""), (None, "a", "s"), (2.2, "b", None)], "t double, c string, s string")
    row = invoices.totals(df, "t", "c", "s").first()
    assert (row["total_invoices"], str(row["total_value"]), row["unique_customers"], row["unique_suppliers"]) == (3, "3.30", 2, 1)
    assert invoices.totals(df, "t", "c", "s", drop_empty_names=False).first()["unique_suppliers"] == 2


def test_filing_filter(spark):
    rows = [("10-K", "2023-05-01"), ("10-K", "2022-05-01"), ("8-K", "2023-02-01"), ("8-K", "2023-08-01"), ("10-Q", "2020-01-01"), ("4", "2023-01-01")]
    df = filings.with_period(spark.createDataFrame(rows, "form_type string, filing_date string"))
    pick = lambda **k: sorted(tuple(r)[:2] for r in df.where(filings.wanted(["10-K", "8-K", "10-Q"], **k)).collect())
    assert pick(years=[2023], quarters=[1]) == [("10-K", "2023-05-01"), ("10-Q", "2020-01-01"), ("8-K", "2023-02-01")]
    assert len(pick()) == 5 and len(pick(years=[], quarters=[])) == 5
    assert pick(start="2023-05-01", end="2023-05-01") == [("10-K", "2023-05-01")]


def test_missing_periods_agree_with_anti_join(spark):
    rows = [("c1", "8-K", 2023, 1), ("c1", "10-K", 2023, 2), ("c2", "8-K", 2022, 4)]
    df = spark.createDataFrame(rows, "cik string, form_type string, year int, quarter int")
    got = filings.missing_periods(df, ["cik"], "8-K", [2022, 2023], [1, 4])
    grid = filings.period_grid(spark, [2022, 2023], [1, 4]).collect()
    want = {(c, y, q) for c in ("c1", "c2") for y, q in grid} - {(r[0], r[2], r[3]) for r in rows if r[1] == "8-K"}
    assert {tuple(r) for r in got.collect()} == want


def test_company_lookup(spark):
    tickers = spark.createDataFrame([("AAPL", "0000320193"), ("GONE", "0000000009")], "ticker string, cik string")
    companies = spark.createDataFrame([("0000320193", "Apple"), ("0000000077", "Direct")], "cik string, company_name string")
    asked = spark.createDataFrame([("aapl",), ("77",), ("nope",), ("GONE",)], "ticker string")
    got = {r["ticker"]: (r["cik"], r["company_name"], r["error"]) for r in filings.find_companies(asked, tickers, companies).collect()}
    assert got["aapl"] == ("0000320193", "Apple", None) and got["77"] == ("0000000077", "Direct", None)
    assert got["nope"][2] == "Could not find company info for ticker nope" and got["GONE"][0] is None


def test_columnar_index_without_optional_arrays(spark):
    recent = (["10-K"], ["2023-05-01"], ["1-2"], ["a.htm"], None, None)
    df = spark.createDataFrame([("c", recent)], f"cik string, recent {schemas.FILING_INDEX}")
    row = filings.filing_rows(df, "recent", "cik").first()
    assert (row["form_type"], row["file_number"], row["description"], row["year"], row["quarter"]) == ("10-K", None, "", 2023, 2)


def test_best_class_ties_and_default(spark):
    rules = {"a": {"x": 1}, "b": {"y": 1}}
    df = spark.createDataFrame([("x",), ("y y",), ("x y",), ("z",)], "t string")
    scores = splitting.class_scores(F.col("t"), rules)
    assert [r[0] for r in df.select(splitting.best_class(scores)).collect()] == ["a", "b", "a", "unknown"]


def test_log_markers(spark):
    lines = [
        "🎉 Completed pipeline for a - b.pdf → output/a.md (clean name: a.md)", "🤖 Starting parsing for a.pdf (model=m)",
        "⏭️ Skipping c - d.pdf - already processed (output exists: o)", "❌ Error processing e.pdf: boom: bad", "REPORT x",
    ]
    rows = summaries.classified(spark.createDataFrame([(m,) for m in lines], "message string")).collect()
    assert [(r["status"], r["file"]) for r in rows] == [
        ("processed", "a - b.pdf"), ("processing", "a.pdf"), ("skipped", "c - d.pdf"), ("error", "e.pdf"),
    ]


def test_log_lines_are_put_together_once(spark, folder):
    """The text of a line is not copied into every marker's test, nor below the filter on its status."""
    plan = plan_of(summaries.first_seen(summaries.classified(derive.log_lines(spark, folder)), "ts"))
    assert plan.count("REPORT RequestId") == 1
    odd = spark.createDataFrame([(1, None, "x"), (2, "Completed pipeline for  → z", "y")], "id int, message string, status string")
    assert [tuple(r) for r in summaries.classified(odd).collect()] == [(2, "Completed pipeline for  → z", "processed", "")]


def test_envelope_shapes_and_extractions(spark):
    bodies = ['{"documents":[{"extraction":{"k":1}},{"extraction":null},3,null]}', '[{"extraction_output":{"k":2}}]', '{"invoice_info":{"n":1}}', "junk"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    rows = responses.envelope_documents(df, "body").withColumn("e", responses.extraction_of(F.col("document")))
    got = [(r[0], r[1]) for r in rows.select("position", F.to_json("e")).collect()]
    assert got == [(0, '{"k":1}'), (1, None), (0, '{"k":2}'), (0, '{"invoice_info":{"n":1}}')]


def test_per_document_files(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one\ntwo"), ("b", "three")], "stem string, markdown string")
    path = sinks.write_text(docs, str(tmp_path / "md"), "markdown", by="stem")
    assert {(r["stem"], r["content"]) for r in listings.read_markdown(spark, path, "*.txt").collect()} == {("a", "one\ntwo\n"), ("b", "three\n")}
    back = spark.read.json(sinks.write_json(docs, str(tmp_path / "js"), by="stem"))
    assert sorted(map(tuple, back.select("stem", "markdown").collect())) == sorted(map(tuple, docs.collect()))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], f"doc_id bigint, chunks array<{schemas.CHUNK}>, grounding map<string, {schemas.GROUND}>")
    assert chunks.flatten_chunks(empty).count() == 0
    assert provenance.grounding_rows(empty, "doc_id").count() == 0
    assert isinstance(empty.schema["chunks"].dataType, T.ArrayType)
