"""Reports: counts, totals, logs, views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import summaries
from ..session import table
from . import derive
from .registry import query

NOW = datetime(2024, 1, 30, 12)
WINDOW_SQL = "ts BETWEEN TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 240 HOUR AND TIMESTAMP '2024-01-30 12:00:00'"


@query("a1_count_by_group", "SELECT c_mktsegment AS applicant, CAST(count(*) AS BIGINT) AS device_count FROM customer GROUP BY 1")
def count_by_group(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("applicant"))
    return summaries.count_by(rows, "applicant", name="device_count")


@query(
    "s14_log_scan",
    f"""WITH {derive.LOG} SELECT event_id, CASE event_type WHEN 'click' THEN 'REPORT' ELSE 'ERROR' END AS pattern FROM log
    WHERE event_type IN ('click', 'error') AND {WINDOW_SQL}""",
)
def log_scan(spark, folder):
    lines = derive.log_lines(spark, folder)
    return summaries.matches(lines, "ts", NOW, ["REPORT", "ERROR"], hours=240).select("event_id", "pattern")


@query(
    "a6_files_per_status",
    f"WITH {derive.LOG} SELECT status, CAST(count(DISTINCT file) AS BIGINT) AS files FROM log WHERE status IS NOT NULL GROUP BY 1",
)
def files_per_status(spark, folder):
    return summaries.files_per_status(summaries.classified(derive.log_lines(spark, folder)))


@query("a6_file_lists", f"WITH {derive.LOG} SELECT DISTINCT status, file FROM log WHERE status IS NOT NULL")
def file_lists(spark, folder):
    return summaries.file_lists(summaries.classified(derive.log_lines(spark, folder)))


@query(
    "x3_first_seen",
    f"WITH {derive.LOG} SELECT status, file, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM log WHERE status IS NOT NULL GROUP BY 1, 2",
)
def first_seen(spark, folder):
    rows = summaries.first_seen(summaries.classified(derive.log_lines(spark, folder)), "ts")
    return rows.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


TOTALS = """CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS succeeded,
      CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed,
      count(*) FILTER (event_type <> 'error')::DOUBLE / count(*)::DOUBLE * 100 AS success_rate"""


@query("a7_batch_totals", f"SELECT user_id, {TOTALS} FROM events GROUP BY user_id")
def batch_totals(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type")
    return summaries.success_totals(rows, F.col("event_type") != "error", "user_id")


@query("a17_invocation_statistics", f"SELECT {TOTALS} FROM events WHERE event_type IN ('click', 'error') AND {WINDOW_SQL}")
def invocation_statistics(spark, folder):
    lines = derive.log_lines(spark, folder)
    runs = lines.where(F.col("message").startswith("REPORT") | F.col("message").startswith("ERROR"))
    return summaries.success_totals(summaries.recent(runs, "ts", NOW, hours=240), ~F.col("message").startswith("ERROR"))


@query("a14_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def distinct_rows(spark, folder):
    return summaries.distinct_rows(table(spark, folder, "documents").select("text", "lang"))


@query(
    "a14_distinct_json_rows",
    "SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k",
)
def distinct_json_rows(spark, folder):
    # Rows are made distinct on the JSON text; only then it is parsed (VARIANT values cannot be compared).
    rows = summaries.distinct_rows(table(spark, folder, "events").select("user_id", "props"))
    parsed = rows.select(F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
    return parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# Dimension: synonyms and comment.
DIMENSIONS = {
    "c_name": (["customer_name", "company_name"], "Name of the customer."),
    "c_mktsegment": (["segment", "market"], "Market segment of the customer."),
    "c_acctbal": (["balance"], "Account balance."),
}


@query("p36_synonym_view", "SELECT c_name AS company_name, c_mktsegment AS Market, c_acctbal AS balance FROM customer")
def synonym_view(spark, folder):
    view = summaries.named_view(table(spark, folder, "customer"), DIMENSIONS)
    return summaries.pick(view, "company_name", "Market", "balance")


@query(
    "t1_most_recent_per_view",
    "SELECT o_orderkey AS device, strftime(o_orderdate, '%Y-%m-%d') AS approved FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
)
def most_recent_per_view(spark, folder):
    dimensions = {"o_orderkey": (["device"], "Number."), "o_orderdate": (["approved"], "Date of approval.")}
    view = summaries.named_view(table(spark, folder, "orders"), dimensions)
    rows = summaries.pick(view, "device", "approved").orderBy(F.desc("approved"), "device").limit(10)
    return rows.withColumn("approved", F.date_format("approved", "yyyy-MM-dd"))
