"""Plans have the shape they need at scale."""

from conftest import plan_of
from pyspark.sql import functions as F

from foliospark.operators import chunks
from foliospark.plans import QUERIES, derive
from foliospark.session import table


def test_chunk_rows_need_no_shuffle(spark, folder):
    docs = table(spark, folder, "documents")
    parsed = chunks.parse_documents(docs, "doc_id", "text", derive.filename(), "v").withColumn("d", F.col("metadata.filename"))
    plan = plan_of(chunks.chunk_rows(parsed, "d", "t", "v", "m"))
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_filing_filter_reaches_the_scan(spark, folder):
    plan = plan_of(derive.filings(spark, folder).where(F.col("downloaded")))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan


def test_unneeded_columns_are_not_read(spark, folder):
    plan = plan_of(QUERIES["a11_folder_counts"](spark, folder))
    assert "ReadSchema: struct<url:string>" in plan and "html" not in plan


def test_no_python_and_no_cross_join_in_any_plan(spark, folder):
    slow = ("st", "k", "s6", "u8", "j6")
    for name, q in QUERIES.items():
        if name.startswith(slow):
            continue
        plan = plan_of(q(spark, folder))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
            assert word not in plan, (name, word)


def test_invoices_are_not_moved_with_their_items(spark, folder, monkeypatch):
    """Customers are joined to thin orders, and both results of an invoice are paired in its row."""
    from foliospark.operators import invoices
    from foliospark.plans import derive, record_plans

    monkeypatch.setattr(invoices, "pair_results", None)
    pairs = record_plans.stored_pairs(spark, folder)
    assert pairs.columns == ["doc_id", "chunks", "markdown", "metadata", "extraction"]
    assert pairs.count() == table(spark, folder, "orders").count()
    counted = []
    monkeypatch.setattr(derive, "sized_join", lambda left, *rest, **more: counted.append(left.columns) or derive.table(spark, folder, "orders").join(
        derive.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")))
    derive.invoice_documents(spark, folder)
    assert "items" not in counted[0]


def test_line_items_are_moved_before_they_are_collected(spark, folder):
    """A task that meets each order once has nothing to collect before the shuffle, and only what invoices show is moved."""
    from foliospark.plans import derive

    plan = plan_of(derive.invoice_documents(spark, folder))
    assert "l_shipdate" not in plan and "l_linestatus" not in plan
    assert plan.count("hashpartitioning(l_orderkey") == 1
    moved = plan.split("hashpartitioning(l_orderkey")
    assert "collect_list" in moved[0] and "collect_list" not in moved[1]


def test_four_table_export_keeps_little_beside_its_tables(spark, folder, tmp_path, monkeypatch):
    """The parent holds no chunks and goes when the tables are there, the tables are packed, and the session keeps its setting."""
    import pyarrow.parquet as pq

    from foliospark.plans import record_plans, sink_plans

    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(sink_plans, "fresh_path", lambda _, label: str(tmp_path / label))
    parent = record_plans.stored_pairs(spark, folder, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).columns == ["doc_id", "markdown", "metadata", "extraction"]
    assert parent.where("size(chunks) = 1 + size(extraction.line_items)").count() == parent.count() > 0
    rows = sink_plans.four_table_export(spark, folder).count()
    assert spark.conf.get(freed) == "false"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["kept", "tables"]
    files = list(tmp_path.glob("tables/*/*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    assert rows == sum(pq.ParquetFile(f).metadata.num_rows for f in files)


def test_an_invoice_table_reads_only_its_part_of_the_record(spark, folder):
    read = lambda q: plan_of(QUERIES[q](spark, folder)).split("from_json(")[1].split("invoke(")[0]
    items, main = read("w6_invoice_line_items"), read("p4_invoice_main")
    assert "line_items" in items and "totals_summary" not in items
    assert "totals_summary" in main and "line_items" not in main


def test_words_are_sorted_and_counted_without_comparators(spark):
    """Words are put in the built-in order, and the starts of their runs are found once a row."""
    from foliospark.operators import search

    rows = spark.createDataFrame([(0, "b a b Z z"), (1, ""), (2, None)], "i int, t string")
    index = search.postings(rows, "i", "t")
    plan = plan_of(index)
    assert "array_sort(" not in plan and plan.count("sequence(0") == 1
    assert sorted(map(tuple, index.collect())) == [(0, 5, "a", 1), (0, 5, "b", 2), (0, 5, "z", 2)]
