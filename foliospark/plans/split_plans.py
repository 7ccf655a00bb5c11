"""Splitting page sequences into documents and classifying texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, splitting
from ..session import table
from . import derive
from .registry import query

# Small, so that runs of a few pages are cut.
PART_BYTES = 24


def page_classifications(spark, folder):
    """Pages of a bundle: the events of a user in time order, the event type as page type, the payload as text."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("bundle"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("event_type").alias("doc_type"),
        F.struct(F.col("props").alias("markdown")).alias("split"),
    )
    placed = ordered.row_index(rows, ["bundle"], ["at", "event_id"], F.col("at"), "page")
    return splitting.clean_classifications(placed)


def split_pages(spark, folder):
    pages = page_classifications(spark, folder)
    return splitting.page_runs(pages, ["bundle"], ["page"], F.col("page"))


RUNS = """
pages_in AS (SELECT user_id AS bundle, event_type AS doc_type, props, row_number() OVER w - 1 AS page, lag(event_type) OVER w AS prev
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR prev <> doc_type THEN 1 ELSE 0 END) OVER (PARTITION BY bundle ORDER BY page) AS BIGINT) AS run
  FROM pages_in)"""


@query(
    "w2_a12_split_documents",
    f"""WITH {RUNS} SELECT bundle, run, doc_type || '_' || run AS doc_name, doc_type, CAST(min(page) + 1 AS BIGINT) AS first_page,
      CAST(max(page) + 1 AS BIGINT) AS last_page, CAST(count(*) AS BIGINT) AS page_count FROM runs GROUP BY bundle, run, doc_type""",
)
def split_documents(spark, folder):
    rows = splitting.split_summary(split_pages(spark, folder), ["bundle"], "page")
    return rows.withColumn("first_page", F.col("first_page").cast("bigint")).withColumn("last_page", F.col("last_page").cast("bigint"))


@query(
    "a13_split_markdown",
    f"""WITH {RUNS}, sized AS (SELECT *, coalesce(sum(strlen(props) + 2) OVER (PARTITION BY bundle, run ORDER BY page
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM runs)
    SELECT bundle, run, doc_type || '_' || run AS doc_name, CAST(floor(bytes_before / {PART_BYTES}) AS BIGINT) AS part,
      string_agg(props, chr(10) || chr(10) ORDER BY page) AS markdown FROM sized GROUP BY 1, 2, 3, 4""",
)
def split_markdown(spark, folder):
    runs = split_pages(spark, folder).withColumn("text", F.col("split.markdown"))
    return splitting.split_markdown(runs, ["bundle"], "page", "text", bytes_per_part=PART_BYTES)


@query(
    "p37_page_classifications",
    f"WITH {RUNS} SELECT bundle, CAST(page AS BIGINT) AS page, doc_type, CASE WHEN doc_type <> 'error' THEN props END AS markdown FROM runs",
)
def page_classification_rows(spark, folder):
    pages = page_classifications(spark, folder)
    damaged = pages.withColumn("split", F.when(F.col("doc_type") != "error", F.col("split")))
    rows = splitting.clean_classifications(damaged)
    return rows.select("bundle", F.col("page").cast("bigint").alias("page"), "doc_type", F.col("split.markdown").alias("markdown"))


# Weighted patterns per class; a class is the one with the highest score over the whole text.
CLASS_RULES = {
    "statement": {r"\|": 2, "[0-9]{4,}": 3},
    "notice": {"Licen[sc]ed|Copyright": 25, "https?://": 5},
    "letter": {r"(?:^|[^\p{L}\p{N}_])the(?:$|[^\p{L}\p{N}_])": 1},
}

CLASS_SQL = r"""
scored AS (SELECT doc_id, 2 * len(regexp_extract_all(text, '[|]')) + 3 * len(regexp_extract_all(text, '[0-9]{4,}')) AS statement,
    25 * len(regexp_extract_all(text, 'Licen[sc]ed|Copyright')) + 5 * len(regexp_extract_all(text, 'https?://')) AS notice,
    len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])the(?:$|[^\p{L}\p{N}_])')) AS letter FROM documents),
classed AS (SELECT *, CASE WHEN greatest(statement, notice, letter) <= 0 THEN 'unknown' WHEN statement = greatest(statement, notice, letter) THEN 'statement'
    WHEN notice = greatest(statement, notice, letter) THEN 'notice' ELSE 'letter' END AS class FROM scored)"""


def classified(spark, folder):
    docs = derive.spread_scan(table(spark, folder, "documents"), "doc_id")
    scores = splitting.class_scores(F.col("text"), CLASS_RULES)
    rows = docs.select("doc_id", *[s.alias(n) for n, s in scores.items()])
    return rows.withColumn("class", splitting.best_class({n: F.col(n) for n in scores}))


@query(
    "u7_page_classes",
    f"""WITH {CLASS_SQL} SELECT doc_id, CAST(statement AS BIGINT) AS statement, CAST(notice AS BIGINT) AS notice,
      CAST(letter AS BIGINT) AS letter, class FROM classed""",
)
def page_classes(spark, folder):
    rows = classified(spark, folder)
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("statement", "notice", "letter")], "class")


@query(
    "u7_class_agreement",
    f"""WITH {CLASS_SQL} SELECT class, CAST(quality AS BIGINT) AS quality, CAST(count(*) AS BIGINT) AS documents
    FROM classed JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def class_agreement(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return classified(spark, folder).join(labels, "doc_id").groupBy("class", "quality").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "j9_positional_pairs",
    """WITH a AS (SELECT source AS batch, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
    b AS (SELECT source AS batch, source || '/P' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS i FROM documents)
    SELECT a.batch, doc_id, path FROM a JOIN b ON a.batch = b.batch AND a.i = b.i""",
)
def positional_pairs(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("source").alias("batch"), "doc_id")
    results = ordered.row_index(docs, ["batch"], ["doc_id"], F.col("doc_id"), "i")
    files = docs.select("batch", F.concat("batch", F.lit("/P"), F.col("doc_id").cast("string")).alias("path"), (-F.col("doc_id")).alias("place"))
    listed = ordered.row_index(files, ["batch"], ["place"], F.col("place"), "i")
    return results.join(listed, ["batch", "i"]).select("batch", "doc_id", "path")


@query(
    "w6_order_line_index",
    """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS line_index, l_extendedprice AS price FROM lineitem""",
)
def order_line_index(spark, folder):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    rows = table(spark, folder, "lineitem").select("l_orderkey", *order)
    placed = ordered.row_index(rows, ["l_orderkey"], order, F.unix_seconds(F.col("l_shipdate").cast("timestamp")), "line_index")
    return placed.select("l_orderkey", F.col("line_index").cast("bigint").alias("line_index"), F.col("l_extendedprice").alias("price"))
