"""Blank texts and lines, and values with white space at their ends: they come back as they were."""

import pytest
from verify import compare, open_tables

from foliospark.plans import QUERIES, SQL
from foliospark.sources import responses, sinks

TEXTS = ["", "\n", "a\n\nb", "a\n", "  lead", "trail \t", " ", "\x01control\x01", "x\r\ny", 'a "q", b', '"', "long " * 500, " " * 2100 + "\n"]


@pytest.fixture
def blank(spark, folder, tmp_path):
    """The smallest tables, with documents that are blank or have blank lines, each text in each language and without one."""
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    for file in Path(folder).iterdir():
        if file.name != "documents.parquet":
            (tmp_path / file.name).symlink_to(file)
    rows = [(t, lang) for t in TEXTS for lang in ("en", "fr", "de", "es", None)]
    columns = {"doc_id": list(range(len(rows))), "text": [t for t, _ in rows], "lang": [x for _, x in rows], "source": ["s"] * len(rows), "n_chars": [len(t) for t, _ in rows]}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["k3_chunk_csv_combined", "st5_resolved_results"])
def test_blank_texts_match_sql(spark, blank, name):
    assert compare(QUERIES[name](spark, blank), open_tables(blank), SQL[name]) is None


def test_csv_keeps_every_value(spark, tmp_path):
    values = ["", None, " ", " lead", "trail ", "\t", "\n", "a\n\nb", "\r", "x\r\ny", "\x00", "\x01c\x01", '"', '""', 'say "x"', "a,b", "\\", "#c", "﻿b", "null"]
    rows = [(i, v, v) for i, v in enumerate(values)]
    path = sinks.write_csv(spark.createDataFrame(rows, "i int, a string, b string").coalesce(1), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in sinks.csv_reader(spark, "i int, a string, b string").csv(path).collect()) == rows


def test_empty_results_fail_on_request_only(spark):
    jobs = spark.createDataFrame(
        [(1, "completed", ("",), None), (2, "completed", None, "a"), (3, "completed", None, "b"), (4, "completed", None, None), (5, "processing", ("x",), None), (6, "completed", ("x",), None)],
        "id int, status string, data struct<markdown string>, output_url string",
    )
    linked = spark.createDataFrame([("a", "")], "output_url string, linked_markdown string")
    told = lambda **by: {r["id"]: (r["result"], r["markdown"]) for r in responses.resolved_results(jobs, linked, **by).collect()}
    rest = {3: ("failed", None), 4: ("no_output", None), 5: ("not_completed", None), 6: ("success", "x")}
    assert told() == {1: ("failed", None), 2: ("failed", None), **rest}
    assert told(empty_fails=False) == {1: ("success", ""), 2: ("success", ""), **rest}
