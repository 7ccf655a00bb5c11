"""Document-service records derived from the given tables, and the same derivations as SQL for the checks.

Every derivation works inside one row or on a one-to-one join; no group is collected to build an input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks
from ..operators.joins import sized_join
from ..session import spread_scan, table

VERSION = "rules-1"


def filename():
    return F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))


def parsed(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    docs = spread_scan(table(spark, folder, "documents"), "doc_id")
    return chunks.parse_documents(docs, "doc_id", "text", filename(), VERSION, *keep)


# Lines of each document with clean text, word count and chunk type.
LINES = r"""
raw_lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos
  FROM documents),
clean_lines AS (
  SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS clean FROM raw_lines),
counted_lines AS (
  SELECT *, CASE WHEN clean = '' THEN 0 ELSE len(string_split_regex(clean, '\s+')) END AS words FROM clean_lines),
lines AS (
  SELECT *, doc_id || '-' || pos AS chunk_id, source || '/doc_' || doc_id || '.pdf' AS filename,
    CAST(floor(pos / 40) AS BIGINT) AS page, (pos % 40) / 40.0::DOUBLE AS top, (pos % 40 + 1) / 40.0::DOUBLE AS bottom,
    CASE WHEN regexp_matches(line, '[|\t]') THEN 'table' WHEN regexp_matches(line, '[0-9]{4,}') THEN 'scan_code'
         WHEN regexp_matches(line, '(?i)licen|copyright|permission') THEN 'attestation'
         WHEN regexp_matches(line, '[(][^()]*[)]') THEN 'figure' WHEN words <= 3 THEN 'marginalia' ELSE 'text' END AS type
  FROM counted_lines)
"""

# Visible pieces of each page with chunk type. The tags of blocks become line marks that the page is cut at.
ELEMENTS = r"""
visible AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS body FROM pages),
cut AS (
  SELECT page_id, string_split(regexp_replace(body,
    '(?i)<(/?)(address|article|aside|blockquote|body|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/][^>]*)?>',
    chr(1) || '\1\2' || chr(2), 'g'), chr(1)) AS parts FROM visible),
pieces AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
read AS (
  SELECT page_id, i, lower(CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 1) ELSE '' END) AS tag,
    regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 2) ELSE part END,
      '(?i)<br\s*/?>', chr(10), 'g'), '(?s)<[a-zA-Z/!?][^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS raw
  FROM pieces),
elements AS (
  SELECT page_id, pos, page_id || '-' || pos AS chunk_id, type, content FROM (
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos,
      CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'title' WHEN tag = 'title' THEN 'logo'
           WHEN tag IN ('li', 'footer', 'nav', 'aside') THEN 'marginalia' WHEN tag IN ('td', 'th') THEN 'table'
           WHEN tag = 'figcaption' THEN 'figure' ELSE 'text' END AS type,
      replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS content
    FROM read WHERE raw <> ''))
"""


def page_parsed(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread_scan(table(spark, folder, "pages"), "page_id")
    return pages.select("page_id", "url", chunks.page_chunks(F.col("html"), F.col("page_id").cast("string")).alias("chunks"))


#: Order of an invoice's items; rows that agree in all of it are equal.
ITEM_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def invoice_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON invoice and its text per order: header from the order and its customer, items from its line items.

    ``doc_id`` is the order's number. The items of one order are one array: an invoice is one record. An order without
    items has an empty array, no supplier and a text of one line.
    """
    # Line items are moved before they are collected: arrays of a task that meets each order once save nothing, and sorting them for it spills.
    # What is not shown orders nothing: items that agree in all that is shown give the same entries.
    shown = ITEM_ORDER[:ITEM_ORDER.index("l_linestatus")]
    moved = table(spark, folder, "lineitem").select("l_orderkey", *shown).repartition("l_orderkey")
    items = moved.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("items"))
    # Orders meet their customers while they are thin; counting and moving them with their items costs several times the items.
    placed = sized_join(
        table(spark, folder, "orders").withColumn("key", F.col("o_custkey")), table(spark, folder, "customer").withColumn("key", F.col("c_custkey")),
        ["key"], spread_by=["o_orderkey"],
    )
    joined = placed.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    def text_of(i):
        return F.concat(F.lit("Part "), i["l_partkey"].cast("string"), F.lit(" from supplier "), i["l_suppkey"].cast("string"), F.lit(", "), i["l_returnflag"])

    def item(i):
        return F.struct(
            i["l_linenumber"].cast("string").alias("line_number"), F.concat(F.lit("SKU-"), i["l_partkey"].cast("string")).alias("sku"),
            text_of(i).alias("description"), i["l_quantity"].alias("quantity"), F.try_divide(i["l_extendedprice"], i["l_quantity"]).alias("unit_price"),
            i["l_extendedprice"].alias("amount"), (i["l_extendedprice"] * (1 - i["l_discount"]) * (1 + i["l_tax"])).alias("total"),
        )

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    number = F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))
    supplier = F.array_min(F.transform("items", lambda i: i["l_suppkey"])).cast("string")
    record = F.struct(
        F.struct(
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("invoice_date_raw"), day.alias("invoice_date"), number.alias("invoice_number"),
            day.alias("order_date"), F.col("o_orderstatus").alias("status"),
        ).alias("invoice_info"),
        F.struct(F.col("c_name").alias("sold_to_name"), F.col("c_mktsegment").alias("sold_to_address")).alias("customer_info"),
        F.struct(
            F.concat(F.lit("Supplier "), supplier).alias("supplier_name"), F.concat(F.lit("desk "), F.col("c_nationkey").cast("string")).alias("representative")
        ).alias("company_info"),
        F.struct(F.col("o_orderpriority").alias("payment_terms")).alias("order_details"),
        F.struct(
            F.when(F.col("o_orderstatus") == "F", "EUR").alias("currency"),
            F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("total_due_raw"),
            F.col("o_totalprice").alias("total_due"), F.col("c_acctbal").alias("subtotal"),
        ).alias("totals_summary"),
        F.coalesce(F.transform("items", item), F.array()).alias("line_items"),
    )
    lines = F.concat(F.array(F.concat(F.lit("Invoice "), number)), F.coalesce(F.transform("items", text_of), F.array().cast("array<string>")))
    return joined.select(
        F.col("o_orderkey").alias("doc_id"), F.array_join(lines, "\n").alias("text"),
        F.concat(F.lit("orders/inv_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"), F.to_json(record).alias("extraction_json"),
    )


INVOICES = f"""
items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ITEM_ORDER)}) - 1 AS pos,
    'Part ' || l_partkey || ' from supplier ' || l_suppkey || ', ' || l_returnflag AS description FROM lineitem),
of_order AS (SELECT l_orderkey, count(*) AS n_items, min(l_suppkey) AS first_supplier, string_agg(description, chr(10) ORDER BY pos) AS described FROM items GROUP BY 1),
invoices AS (
  SELECT o.*, c.*, coalesce(n_items, 0) AS n_items, 'Supplier ' || first_supplier AS supplier, 'desk ' || c_nationkey AS representative,
    'orders/inv_' || o_orderkey || '.pdf' AS filename, strftime(o_orderdate, '%Y-%m-%d') AS day,
    'Invoice INV-' || o_orderkey || coalesce(chr(10) || described, '') AS text
  FROM orders o JOIN customer c ON o_custkey = c_custkey LEFT JOIN of_order ON o_orderkey = l_orderkey)
"""


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One nested header record per order, with its customer, nation and region."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    placed = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return sized_join(
        orders.withColumn("key", F.col("o_custkey")), placed.withColumn("key", F.col("c_custkey")), ["key"], spread_by=["o_orderkey"]
    ).drop("key")


HEADERS = """
headers AS (
  SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)
"""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Listing of one stored file per document; the ending follows the language."""
    docs = table(spark, folder, "documents")
    ending = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".PNG").when(F.col("lang") == "de", ".docx").otherwise(".md")
    return docs.select(
        F.concat("source", F.lit("/P"), F.col("doc_id").cast("string"), ending).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("modificationTime"),
    )


LISTING = """
listing AS (
  SELECT source || '/P' || doc_id || CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PNG' WHEN 'de' THEN '.docx'
         ELSE '.md' END AS path, CAST(octet_length(encode(text)) AS BIGINT) AS length,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(60 * doc_id) AS modified
  FROM documents)
"""


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return as_log(table(spark, folder, "events"))


def as_log(events: DataFrame) -> DataFrame:
    """Log lines of the event rows: one marker per event type, the file name from the user and the payload."""
    name = F.concat(F.lit("doc_"), F.col("user_id").cast("string"), F.lit("_"), F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    message = (
        F.when(kind == "purchase", F.concat(F.lit("Completed pipeline for "), name, F.lit(".pdf → output/"), name, F.lit(".md")))
        .when(kind == "view", F.concat(F.lit("Starting parsing for "), name, F.lit(".pdf (model=m)")))
        .when(kind == "signup", F.concat(F.lit("Skipping "), name, F.lit(".pdf - already processed (output exists)")))
        .when(kind == "error", F.concat(F.lit("ERROR Error processing "), name, F.lit(".pdf: value "), F.col("value").cast("string")))
        .otherwise(F.concat(F.lit("REPORT RequestId: "), F.col("event_id").cast("string")))
    )
    return events.select("event_id", "ts", "user_id", "event_type", message.alias("message"))


LOG = """
log AS (
  SELECT event_id, ts, event_type, 'doc_' || user_id || '_' || json_extract_string(props, '$.k') || '.pdf' AS file,
    CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'skipped'
      WHEN 'error' THEN 'error' END AS status
  FROM events)
"""


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings from orders: company from the customer, form from the priority, date from the order date."""
    form = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "8-K")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "10-Q").otherwise("4")
    )
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), form.alias("form_type"),
        day.cast("string").alias("filing_date"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0").alias("accession_number"),
        F.year(day).alias("year"), F.quarter(day).alias("quarter"), (F.col("o_orderstatus") != "P").alias("downloaded"),
    )


FILINGS = """
filings AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
    CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '8-K' WHEN '3-MEDIUM' THEN '10-Q' ELSE '4' END AS form_type,
    strftime(o_orderdate, '%Y-%m-%d') AS filing_date, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS accession_number,
    CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter, o_orderstatus <> 'P' AS downloaded
  FROM orders)
"""
