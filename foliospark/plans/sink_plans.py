"""Results written to the shared folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import chunks, filings, flatten, invoices
from ..session import drop_path, fresh_path, table
from ..sources import listings, named_files, responses, sinks
from . import derive
from .record_plans import FOUR_TABLES_SQL, four_table_rows, nested_orders, stored_pairs
from .registry import query


def stem():
    """Name of a document's own result files."""
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem")


def _named(spark, folder, rows, label, name, content):
    """The rows' files, one for each document, written and read back as ``name, content``."""
    folders = named_files.folders_for(table(spark, folder, "documents").count())
    return named_files.read_named(spark, named_files.write_named(rows, fresh_path(spark, label), name, content, folders))


@query(
    "k1_json_results",
    f"""WITH {derive.LINES} SELECT 'doc_' || doc_id AS stem, 'parse_doc_' || doc_id || '.json' AS file, any_value(filename) AS filename,
      CAST(count(*) AS BIGINT) AS chunks, sha256(string_agg(line, chr(10) ORDER BY pos)) AS markdown FROM lines GROUP BY doc_id""",
)
def json_results(spark, folder):
    rows = derive.parsed(spark, folder).select(stem(), F.to_json(F.struct("chunks", "markdown", "metadata", "grounding")).alias("json"))
    files = _named(spark, folder, rows, "json-results", F.concat(F.lit("parse_"), "stem", F.lit(".json")), F.col("json"))
    return responses.parsed_responses(files).select(
        F.regexp_extract("name", "^parse_(.*)[.]json$", 1).alias("stem"), F.col("name").alias("file"), F.col("metadata.filename").alias("filename"),
        F.size("chunks").cast("bigint").alias("chunks"), F.sha2("markdown", 256).alias("markdown"),
    )


@query(
    "k2_markdown_files",
    f"WITH {derive.LINES} SELECT 'doc_' || doc_id AS stem, line, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1, 2",
)
def markdown_files(spark, folder):
    rows = table(spark, folder, "documents").select(stem(), "text")
    files = _named(spark, folder, rows, "markdown", F.concat("stem", F.lit(".md")), F.col("text"))
    # Files without a last line break, so an empty last line is not read as one.
    back = files.select(F.regexp_replace("name", "[.]md$", "").alias("stem"), F.explode(F.split("content", "\n")).alias("line"))
    return back.groupBy("stem", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_markdown_scan",
    "SELECT 'doc_' || doc_id AS stem, sha256(text || chr(10)) AS content FROM documents",
)
def markdown_scan(spark, folder):
    # One document in each file, read as a whole.
    rows = table(spark, folder, "documents").select(stem(), F.concat("text", F.lit("\n")).alias("text"))
    files = _named(spark, folder, rows, "markdown", F.concat("stem", F.lit(".md")), F.col("text"))
    return files.select(F.regexp_replace("name", "[.]md$", "").alias("stem"), F.sha2("content", 256).alias("content"))


CHUNK_CSV = f"""WITH {derive.LINES} SELECT filename AS document, chunk_id, clean AS content, CAST(length(clean) AS BIGINT) AS length FROM lines"""


def _chunk_csv_rows(spark, folder):
    named = derive.parsed(spark, folder).withColumn("document", F.col("metadata.filename"))
    rows = chunks.chunk_rows(named, "document", "t", derive.VERSION, "lines")
    return rows.select(
        F.col("DOCUMENT_NAME").alias("document"), "chunk_id", F.col("chunk_content").alias("content"), F.col("chunk_text_length").alias("length")
    )


@query("k3_chunk_csv_combined", CHUNK_CSV)
def chunk_csv_combined(spark, folder):
    path = sinks.write_csv(_chunk_csv_rows(spark, folder), fresh_path(spark, "chunk-csv"))
    return sinks.csv_reader(spark, "document string, chunk_id string, content string, length bigint").csv(path)


@query(
    "k3_chunk_csv_separate",
    f"""WITH {derive.LINES} SELECT 'doc_' || doc_id || '_chunks.csv' AS file, filename AS document, chunk_id, clean AS content,
      CAST(length(clean) AS BIGINT) AS length FROM lines""",
)
def chunk_csv_separate(spark, folder):
    # One table for each document, built inside its row.
    body = sinks.csv_text(F.col("chunks"), lambda c: {
        "document": F.col("metadata.filename"), "chunk_id": c["id"], "content": text.clean_chunk(c["markdown"]),
        "length": F.length(text.clean_chunk(c["markdown"])),
    })
    rows = derive.parsed(spark, folder).select(stem(), body.alias("csv"))
    files = _named(spark, folder, rows, "chunk-csv", F.concat("stem", F.lit("_chunks.csv")), F.col("csv"))
    back = files.select(F.col("name").alias("file"), F.explode(sinks.csv_records(F.col("content"), "document string, chunk_id string, content string, length bigint")).alias("r"))
    return back.select("file", "r.document", "r.chunk_id", F.coalesce("r.content", F.lit("")).alias("content"), "r.length")


@query(
    "s10_latest_csv",
    "SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_orderkey % 2 = 1",
)
def latest_csv(spark, folder):
    # Two batches are written one after the other; the rows of the later one come back, from all its files.
    root = fresh_path(spark, "batches")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")
    )
    for batch in (0, 1):
        sinks.write_csv(orders.where(F.col("order_key") % 2 == batch), f"{root}/batch_{batch}")
    files = listings.list_files(spark, root, "*.csv")
    kinds = dict(orders.dtypes)
    return listings.read_latest_csv(spark, files, "", ", ".join(f"{c} {kinds[c]}" for c in orders.columns), whole_folder=True)


@query("k4_four_table_export", FOUR_TABLES_SQL)
def four_table_export(spark, folder):
    # The four writes read one written parent instead of parsing four times; the rows are read back from the files. The parent goes before.
    parent = fresh_path(spark, "paired")
    written = sinks.write_tables(invoices.invoice_tables(stored_pairs(spark, folder, parent), "run-1", "doc_id"), fresh_path(spark, "tables"))
    drop_path(spark, parent)
    return four_table_rows({name: spark.read.parquet(path) for name, path in written.items()})


# Small, so that the larger batches are cut.
ENVELOPE_BYTES = 1 << 18


@query(
    "k5_s7_a18_envelopes",
    f"""WITH docs AS (SELECT '20240131_000000' AS processed_at, CASE WHEN lang = 'fr' THEN 's3_event' ELSE 'batch' END AS trigger_type,
      'landing' AS bucket, CASE WHEN lang = 'fr' THEN NULL ELSE source || '/' END AS prefix,
      CASE WHEN lang = 'fr' THEN source || '/P' || doc_id || '.pdf' END AS specific_file, doc_id, text FROM documents),
    placed AS (SELECT *, count(*) OVER w AS n, coalesce(sum(greatest(strlen(text), {-(-ENVELOPE_BYTES // 1000)})) OVER (PARTITION BY trigger_type, prefix,
      specific_file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before
      FROM docs WINDOW w AS (PARTITION BY trigger_type, prefix, specific_file)),
    parts AS (SELECT *, CAST(floor(bytes_before / {ENVELOPE_BYTES}) AS BIGINT) AS part FROM placed)
    SELECT processed_at, trigger_type, bucket, prefix, specific_file, CAST(n AS BIGINT) AS parsed_count, part,
      CAST(row_number() OVER (PARTITION BY trigger_type, prefix, specific_file, part ORDER BY doc_id) - 1 AS BIGINT) AS position, doc_id, text FROM parts""",
)
def envelopes(spark, folder):
    # French documents arrive one by one, each by an event of its own; the others by a batch for each folder.
    single = F.col("lang") == "fr"
    docs = table(spark, folder, "documents").select(
        F.lit("20240131_000000").alias("processed_at"), F.when(single, "s3_event").otherwise("batch").alias("trigger_type"),
        F.lit("landing").alias("bucket"), F.when(~single, F.concat("source", F.lit("/"))).alias("prefix"),
        F.when(single, F.concat("source", F.lit("/P"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("specific_file"), "doc_id", "text",
    )
    head = ["processed_at", "trigger_type", "bucket", "prefix", "specific_file"]
    path = fresh_path(spark, "envelopes")
    parts = sinks.envelopes(docs, head, "doc_id", F.col("doc_id"), bytes_per_part=ENVELOPE_BYTES, size=F.octet_length("text"))
    sinks.write_json(parts, path)
    rows = responses.read_envelopes(spark, path, "struct<doc_id bigint, text string>")
    return rows.select(
        *head, "parsed_count", "part", F.col("position").cast("bigint").alias("position"), "document.doc_id", "document.text"
    )


@query(
    "k5_result_keys",
    f"""WITH {derive.LISTING} SELECT path, regexp_replace(regexp_extract(path, '[^/]+$'), '[.][^.]*$', '') || '_' ||
      CASE WHEN length > 2000 THEN 'extracted' ELSE 'parsed' END || '_20240131_000000' AS result FROM listing""",
)
def result_keys(spark, folder):
    key = sinks.result_key(F.col("path"), F.col("length") > 2000, F.lit("20240131_000000"))
    return derive.listing(spark, folder).select("path", key.alias("result"))


@query(
    "k6_fixed_csv_file",
    "SELECT 'order_' || o_orderkey AS source_file, o_orderstatus AS status, o_totalprice AS total FROM orders",
)
def fixed_csv_file(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("source_file"), F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"),
    )
    path = sinks.write_fixed_csv(rows, fresh_path(spark, "fixed-csv"), schemas.FLAT_INVOICE_COLUMNS)
    schema = ", ".join(f"{c} string" for c in schemas.FLAT_INVOICE_COLUMNS)
    back = sinks.csv_reader(spark, schema).csv(path)
    return back.select("source_file", "status", F.col("total").cast("double").alias("total"))


@query("k7_replaced_table", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def replaced_table(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()
    sinks.replace_table(rows, "folio_segments", fresh_path(spark, "table"))
    return spark.table("folio_segments")


@query(
    "k8_summary_csv",
    f"""WITH {derive.HEADERS} SELECT 'order_' || o_orderkey AS document_name, o_totalprice AS order_info_total,
      '[''' || c_mktsegment || ''', ''' || o_orderpriority || ''']' AS tags FROM headers""",
)
def summary_csv(spark, folder):
    rows = flatten.summary_rows(nested_orders(spark, folder), "name", "extraction")
    path = sinks.write_csv(rows, fresh_path(spark, "summary-csv"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return sinks.csv_reader(spark, schema).csv(path).select("document_name", "order_info_total", "tags")


@query(
    "k9_filing_results",
    f"""WITH {derive.FILINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number) AS rank FROM filings),
    asked AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer)
    SELECT cik || ': filings ' || count(*) || ', downloaded ' || count(*) FILTER (downloaded) || ' (' ||
      format('{{:.1f}}', round(count(*) FILTER (downloaded)::DOUBLE / count(*)::DOUBLE * 100, 6)) || '%)' AS line FROM filings GROUP BY cik
    UNION ALL SELECT cik || ': recent ' || string_agg(form_type || ' - ' || filing_date || ' (Year: ' || year || ', Q' || quarter || ')', '; ' ORDER BY rank)
      AS line FROM ranked WHERE rank <= 3 GROUP BY cik
    UNION ALL SELECT 'error: no filings for ' || cik AS line FROM asked WHERE cik NOT IN (SELECT cik FROM filings)""",
)
def filing_results(spark, folder):
    report = filings.entity_report(derive.filings(spark, folder), ["cik"], "downloaded")
    data = fresh_path(spark, "filing-results")
    sinks.write_json(report, f"{data}/json")
    stored = spark.read.schema(report.schema).json(f"{data}/json")
    asked = table(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))
    absent = filings.absent_from(asked, stored, ["cik"]).select(F.concat(F.lit("no filings for "), F.col("cik")).alias("error"))
    sinks.report_lines(stored, "cik", absent).write.text(f"{data}/report")
    return spark.read.text(f"{data}/report").select(F.col("value").alias("line"))
