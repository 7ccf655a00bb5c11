"""Filing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings, joins, ordered
from ..session import table
from . import derive
from .registry import query

YEARS, QUARTERS = [1996, 1998, 2001], [1, 3]
TYPES = ["10-K", "8-K", "10-Q"]
START, END = "1995-06-01", "2000-12-31"


def filing_index(spark, folder):
    """Filing index per document: one array entry per line; French documents lack the optional arrays."""
    lines = F.split("text", "\n")
    each = lambda fn: F.transform(lines, fn)
    optional = lambda fn: F.when(F.col("lang") != "fr", each(fn))
    recent = F.struct(
        each(lambda x, i: F.when(F.length(x) > 200, "10-K").when(F.length(x) > 100, "8-K").otherwise("10-Q")).alias("form"),
        each(lambda x, i: F.date_add(F.lit("1995-01-01").cast("date"), i * 37).cast("string")).alias("filingDate"),
        each(lambda x, i: F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 10, "0"), i.cast("string"))).alias("accessionNumber"),
        each(lambda x, i: F.concat(F.lit("d"), i.cast("string"), F.lit(".htm"))).alias("primaryDocument"),
        optional(lambda x, i: F.concat(F.lit("001-"), i.cast("string"))).alias("fileNumber"),
        optional(lambda x, i: F.left(x, F.lit(8))).alias("description"),
    )
    return derive.spread_scan(table(spark, folder, "documents"), "doc_id").select("doc_id", recent.alias("recent"))


@query(
    "s12_columnar_filings",
    f"""WITH {derive.LINES}
    SELECT doc_id, CASE WHEN length(line) > 200 THEN '10-K' WHEN length(line) > 100 THEN '8-K' ELSE '10-Q' END AS form_type,
      strftime(DATE '1995-01-01' + CAST(pos * 37 AS INTEGER), '%Y-%m-%d') AS filing_date, lpad(CAST(doc_id AS VARCHAR), 10, '0') || '-' || pos AS accession_number,
      'd' || pos || '.htm' AS primary_document, CASE WHEN lang <> 'fr' THEN '001-' || pos END AS file_number,
      CASE WHEN lang <> 'fr' THEN left(line, 8) ELSE '' END AS description,
      CAST(year(DATE '1995-01-01' + CAST(pos * 37 AS INTEGER)) AS BIGINT) AS year, CAST(quarter(DATE '1995-01-01' + CAST(pos * 37 AS INTEGER)) AS BIGINT) AS quarter
    FROM lines""",
)
def columnar_filings(spark, folder):
    rows = filings.filing_rows(filing_index(spark, folder), "recent", "doc_id")
    return rows.withColumn("year", F.col("year").cast("bigint")).withColumn("quarter", F.col("quarter").cast("bigint"))


@query(
    "f1_filing_filter",
    f"""WITH {derive.FILINGS} SELECT accession_number, form_type, filing_date FROM filings WHERE form_type IN ('10-K', '8-K', '10-Q')
      AND (form_type NOT IN ('10-K', '8-K') OR year IN (1996, 1998, 2001)) AND (form_type <> '8-K' OR quarter IN (1, 3))
      AND filing_date >= '{START}' AND filing_date <= '{END}'""",
)
def filing_filter(spark, folder):
    rows = derive.filings(spark, folder).where(filings.wanted(TYPES, START, END, YEARS, QUARTERS))
    return rows.select("accession_number", "form_type", "filing_date")


MISSING_8K = """grid AS (SELECT y.year, q.quarter FROM (SELECT unnest([1996, 1998, 2001]) AS year) y CROSS JOIN (SELECT unnest([1, 3]) AS quarter) q)"""


@query(
    "x1_j10_missing_periods",
    f"""WITH {derive.FILINGS}, {MISSING_8K}, c AS (SELECT DISTINCT cik FROM filings)
    SELECT '8-K for ' || c.cik || ' in ' || g.year || ' Q' || g.quarter || ' not available' AS message FROM c CROSS JOIN grid g
    WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.cik = c.cik AND f.form_type = '8-K' AND f.year = g.year AND f.quarter = g.quarter)
    UNION ALL SELECT '10-K for year ' || y.year || ' not available for ' || c.cik FROM c CROSS JOIN (SELECT DISTINCT year FROM grid) y
    WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.cik = c.cik AND f.form_type = '10-K' AND f.year = y.year)""",
)
def missing_periods(spark, folder):
    rows = derive.filings(spark, folder)
    current = filings.missing_periods(rows, ["cik"], "8-K", YEARS, QUARTERS)
    annual = filings.missing_periods(rows, ["cik"], "10-K", YEARS)
    return current.select(filings.missing_message("8-K", F.col("cik")).alias("message")).union(
        annual.select(filings.missing_message("10-K", F.col("cik")).alias("message"))
    )


@query(
    "x1_requested_companies",
    f"""WITH {derive.FILINGS}, c AS (SELECT DISTINCT cik FROM filings UNION SELECT 'asked-' || n_nationkey FROM nation), y AS (SELECT unnest({YEARS}) AS year)
    SELECT '10-K for year ' || y.year || ' not available for ' || c.cik AS message FROM c CROSS JOIN y
    WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.cik = c.cik AND f.form_type = '10-K' AND f.year = y.year)""",
)
def requested_companies(spark, folder):
    # The asked companies have no filing at all.
    rows = derive.filings(spark, folder)
    asked = table(spark, folder, "nation").select(F.concat(F.lit("asked-"), F.col("n_nationkey").cast("string")).alias("cik"))
    missing = filings.missing_periods(rows, ["cik"], "10-K", YEARS, requested=rows.select("cik").union(asked))
    return missing.select(filings.missing_message("10-K", F.col("cik")).alias("message"))


@query(
    "x1_absent_companies",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000)",
)
def absent_companies(spark, folder):
    found = table(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 450000")
    return filings.absent_from(
        table(spark, folder, "customer").select("c_custkey"), found.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]
    )


@query(
    "s13_ticker_rows",
    "SELECT 'C' || c_custkey AS ticker, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 10 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer",
)
def ticker_rows(spark, folder):
    return filings.ticker_rows(_ticker_json(spark, folder), "j")


def _ticker_json(spark, folder):
    number = F.col("c_custkey").cast("string")
    entry = F.struct(number.alias("cik_str"), F.concat(F.lit("c"), number).alias("ticker"), F.col("c_name").alias("title"))
    return table(spark, folder, "customer").select(F.to_json(F.create_map(number, entry)).alias("j"))


@query(
    "j3_company_lookup",
    """WITH asked AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'c' || o_custkey WHEN 'O' THEN CAST(o_custkey AS VARCHAR) ELSE 'x' || o_custkey END AS ticker,
        o_orderkey, o_orderstatus AS s, o_custkey FROM orders)
    SELECT o_orderkey, ticker, CASE WHEN s <> 'P' THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS cik, CASE WHEN s <> 'P' THEN c_name END AS company_name,
      CASE WHEN s = 'P' THEN 'Could not find company info for ticker ' || ticker END AS error FROM asked JOIN customer ON o_custkey = c_custkey""",
)
def company_lookup(spark, folder):
    # Requests repeat: each distinct ticker is looked up once, then the answers go back to the requests.
    status, number = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    ticker = F.when(status == "F", F.concat(F.lit("c"), number)).when(status == "O", number).otherwise(F.concat(F.lit("x"), number))
    asked = table(spark, folder, "orders").select("o_orderkey", ticker.alias("ticker"))
    companies = table(spark, folder, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("company_name")
    )
    found = filings.find_companies(asked.select("ticker").distinct(), filings.ticker_rows(_ticker_json(spark, folder), "j"), companies)
    return joins.sized_join(asked, found, ["ticker"], spread_by=["o_orderkey"]).select("o_orderkey", "ticker", "cik", "company_name", "error")


@query(
    "a9_w3_company_report",
    f"""WITH {derive.FILINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number) AS rank FROM filings)
    SELECT cik, CAST(count(*) AS BIGINT) AS filing_count, CAST(count(*) FILTER (downloaded) AS BIGINT) AS download_count,
      string_agg(form_type || ' - ' || filing_date || ' (Year: ' || year || ', Q' || quarter || ')', '; ' ORDER BY rank) FILTER (rank <= 3) AS recent_filings,
      count(*) FILTER (downloaded)::DOUBLE / count(*)::DOUBLE * 100 AS success_rate FROM ranked GROUP BY cik""",
)
def company_report(spark, folder):
    return filings.entity_report(derive.filings(spark, folder), ["cik"], "downloaded")


@query(
    "a8_run_summary",
    f"""WITH {derive.FILINGS}, per AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer), f AS (SELECT cik, count(*) AS n,
        count(*) FILTER (downloaded) AS d FROM filings WHERE form_type = '10-K' GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS total_tickers, CAST(count(f.cik) AS BIGINT) AS processed_tickers, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_filings,
      CAST(sum(coalesce(d, 0)) AS BIGINT) AS downloaded_filings, CAST(count(*) - count(f.cik) AS BIGINT) AS errors FROM per LEFT JOIN f ON per.cik = f.cik""",
)
def run_summary(spark, folder):
    per = derive.filings(spark, folder).where(F.col("form_type") == "10-K").groupBy("cik").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("downloaded").alias("d")
    )
    asked = table(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))
    status = asked.join(per, "cik", "left").select(
        F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("filings"), F.coalesce("d", F.lit(0)).alias("downloads"),
        F.col("n").isNull().cast("bigint").alias("errors"),
    )
    return filings.run_summary(status)


@query(
    "a10_types_with_samples",
    f"""WITH {derive.FILINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY form_type ORDER BY filing_date DESC, accession_number) AS rank,
        count(*) OVER (PARTITION BY form_type) AS n FROM filings)
    SELECT form_type, CAST(rank AS BIGINT) AS rank, filing_date, accession_number, CAST(n AS BIGINT) AS filings FROM ranked WHERE rank <= 3""",
)
def types_with_samples(spark, folder):
    rows = filings.types_with_samples(derive.filings(spark, folder))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "w3_first_per_group",
    """SELECT user_id, event_id, CAST(rank AS BIGINT) AS rank FROM (SELECT user_id, event_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events WHERE event_type = 'error') WHERE rank <= 5""",
)
def first_per_group(spark, folder):
    errors = table(spark, folder, "events").where(F.col("event_type") == "error")
    rows = ordered.first_rows(errors.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 5)
    return rows.select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "w4_latest_per_group",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def latest_per_group(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.latest_row(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "t1_most_recent",
    "SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS approval_date FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders) ORDER BY d DESC NULLS LAST, o_orderkey LIMIT 1",
)
def most_recent(spark, folder):
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    rows = table(spark, folder, "orders").select("o_orderkey", day.alias("d"))
    return rows.orderBy(F.col("d").desc_nulls_last(), "o_orderkey").limit(1).select("o_orderkey", F.col("d").cast("string").alias("approval_date"))
