"""Scalar functions over the given tables: money, dates, masks, boxes, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, values
from ..session import table
from . import derive
from .registry import query


@query(
    "p1_variant_paths",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
      event_type AS kind, value AS amount FROM events""",
)
def variant_paths(spark, folder):
    outer = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("value").alias("amount")).alias("detail"))
    rows = table(spark, folder, "events").select(
        "event_id", F.parse_json("props").alias("v"), F.parse_json(F.to_json(outer)).alias("o")
    )
    return rows.select(
        "event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), values.variant_text(F.col("v"), "$.k").alias("k_text"),
        F.variant_get("o", "$.kind", "string").alias("kind"), F.variant_get("o", "$.detail.amount", "double").alias("amount"),
    )


@query(
    "p2_lenient_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS either,
      CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""",
)
def lenient_dates(spark, folder):
    status = F.col("o_orderstatus")
    shown = (
        F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(status == "O", F.date_format("o_orderdate", "MM-dd-yyyy"))
        .otherwise("not stated")
    )
    rows = table(spark, folder, "orders").select("o_orderkey", shown.alias("d"))
    return rows.select(
        "o_orderkey", values.lenient_date(F.col("d"), "yyyy-MM-dd", "MM-dd-yyyy").cast("string").alias("either"),
        values.lenient_date(F.col("d")).cast("string").alias("iso"),
    )


@query(
    "p3_nested_get",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority,
      CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders""",
)
def nested_get(spark, folder):
    # A null at any level gives null further down, never an error.
    inner = F.when(F.col("o_orderstatus") == "F", F.struct(F.col("o_orderpriority").alias("priority")))
    outer = F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderstatus").alias("status"), inner.alias("inner")))
    return table(spark, folder, "orders").select("o_orderkey", outer.alias("r")).select(
        "o_orderkey", F.col("r.inner.priority").alias("priority"), F.col("r.status").alias("status")
    )


@query(
    "p19_p20_money",
    """SELECT c_custkey, CASE WHEN c_acctbal = 0 OR c_mktsegment = 'BUILDING' THEN '-' ELSE '$' || format('{:,.2f}', c_acctbal) END AS shown,
      CASE WHEN c_acctbal = 0 OR c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM customer""",
)
def money(spark, folder):
    amount = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    rows = table(spark, folder, "customer").select("c_custkey", values.money_text(amount).alias("shown"))
    return rows.select("c_custkey", "shown", values.money_value(F.col("shown")).cast("double").alias("amount"))


@query(
    "p21_absent_defaults",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'USD' WHEN 'view' THEN NULL ELSE event_type END AS currency,
      CASE WHEN event_type = 'click' THEN 0 ELSE value END AS total FROM events""",
)
def absent_defaults(spark, folder):
    # Clicks lack both keys, views carry a JSON null: only the absent key takes the default.
    kind = F.col("event_type")
    doc = F.when(kind == "click", F.lit("{}")).when(
        kind == "view", F.concat(F.lit('{"currency":null,"total":'), F.col("value").cast("string"), F.lit("}"))
    ).otherwise(F.to_json(F.struct(kind.alias("currency"), F.col("value").alias("total"))))
    rows = table(spark, folder, "events").select("event_id", F.parse_json(doc).alias("v"))
    return rows.select(
        "event_id", values.variant_default(F.col("v"), "$.currency", "string", "USD").alias("currency"),
        values.variant_default(F.col("v"), "$.total", "double", 0.0).alias("total"),
    )


@query(
    "p23_masked_account",
    """SELECT c_custkey, CASE WHEN length(a) > 8 THEN left(a, 4) || repeat('X', length(a) - 8) || right(a, 4) ELSE repeat('X', 12) END AS account
    FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS a FROM customer)""",
)
def masked_account(spark, folder):
    number = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", values.mask_account(number).alias("account"))


@query(
    "p14_padded_ids",
    """SELECT p_partkey, CASE WHEN length(n) >= 10 THEN n ELSE lpad(n, 10, '0') END AS id, upper(p_name) AS name,
      replace(p_name || '-' || p_brand, '-', '') AS plain
    FROM (SELECT *, p_partkey || CASE WHEN p_size > 25 THEN '7000000001' ELSE '' END AS n FROM part)""",
)
def padded_ids(spark, folder):
    number = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, "7000000001").otherwise(""))
    return table(spark, folder, "part").select(
        "p_partkey", values.zero_pad(number).alias("id"), F.upper("p_name").alias("name"),
        F.replace(F.concat_ws("-", "p_name", "p_brand"), F.lit("-"), F.lit("")).alias("plain"),
    )


@query(
    "p15_p16_filing_links",
    f"""WITH {derive.FILINGS}, n AS (SELECT accession_number AS plain, left(accession_number, 10) || '-' || substr(accession_number, 11, 2)
        || '-' || substr(accession_number, 13) AS a, cik, form_type || CASE WHEN form_type = '4' THEN '.html' ELSE '.htm' END AS d FROM filings)
    SELECT a AS accession_number, 'https://www.sec.gov/Archives/edgar/data/' || left(plain, 10) || '/' || plain || '/' || d AS url,
      'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || plain || '/' || d AS company_url,
      a || '_' || replace(d, '.htm', '.pdf') AS pdf FROM n""",
)
def filing_links(spark, folder):
    a = F.col("accession_number")
    dashed = F.concat_ws("-", F.left(a, F.lit(10)), F.substring(a, 11, 2), F.substring(a, 13, 6))
    doc = F.concat("form_type", F.when(F.col("form_type") == "4", ".html").otherwise(".htm"))
    rows = derive.filings(spark, folder).select("cik", dashed.alias("accession_number"), doc.alias("d"))
    return rows.select(
        "accession_number", values.document_url(a, F.col("d")).alias("url"),
        values.document_url(a, F.col("d"), F.col("cik")).alias("company_url"), values.filing_pdf_name(a, F.col("d")).alias("pdf"),
    )


@query(
    "p24_year_quarter",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST((month(o_orderdate) - 1) // 3 + 1 AS BIGINT) AS quarter FROM orders""",
)
def year_quarter(spark, folder):
    from ..operators.filings import with_period

    rows = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"))
    return with_period(rows).select("o_orderkey", F.col("year").cast("bigint").alias("year"), F.col("quarter").cast("bigint").alias("quarter"))


@query(
    "p25_p26_pixel_boxes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS l, l_tax AS t, l_discount + 0.5 AS r, l_tax + 0.9 AS bt,
        l_quantity, l_extendedprice FROM lineitem),
      p AS (SELECT *, CAST(trunc(l * 1700) AS BIGINT) AS x1, CAST(trunc(t * 2200) AS BIGINT) AS y1, CAST(trunc(r * 1700) AS BIGINT) AS x2,
        CAST(trunc(bt * 2200) AS BIGINT) AS y2 FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, x1, y1, x2, y2, greatest(0, x1 - 10) AS crop_x1,
      greatest(0, y1 - 10) AS crop_y1, least(1700, x2 + 10) AS crop_x2, least(2200, y2 + 10) AS crop_y2 FROM p""",
)
def pixel_boxes(spark, folder):
    box = {"left": F.col("l_discount"), "top": F.col("l_tax"), "right": F.col("l_discount") + 0.5, "bottom": F.col("l_tax") + 0.9}
    width, height = F.lit(1700), F.lit(2200)
    px = boxes.pixel_box(box, width, height)
    keys = ["l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, folder, "lineitem").select(*keys, *[c.alias(n) for n, c in px.items()])
    crop = boxes.padded_box({n: F.col(n) for n in px}, width, height)
    ints = lambda cols, prefix: [c.cast("bigint").alias(prefix + n) for n, c in cols.items()]
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        *ints({n: F.col(n) for n in px}, ""), *ints(crop, "crop_"),
    )


@query(
    "p29_ratios",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN
        count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) FILTER (o_orderstatus <> 'P')::DOUBLE * 100 ELSE 0 END AS rate,
      count(*) FILTER (o_orderstatus = 'F')::DOUBLE / nullif(count(*) FILTER (o_orderstatus = 'O'), 0)::DOUBLE AS per_open
    FROM orders GROUP BY o_custkey""",
)
def ratios(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "P").alias("all"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
    )
    return counts.select(
        "o_custkey", values.percent(F.col("done"), F.col("all")).alias("rate"), F.try_divide("done", "open").alias("per_open")
    )


@query(
    "p32_truthy_text",
    "SELECT event_id, event_type IN ('view', 'click', 'signup') AS flag FROM events",
)
def truthy_text(spark, folder):
    kind = F.col("event_type")
    raw = F.when(kind == "view", "TRUE").when(kind == "click", "1").when(kind == "signup", "Yes").when(kind == "error", "no")
    return table(spark, folder, "events").select("event_id", values.is_truthy(raw).alias("flag"))
