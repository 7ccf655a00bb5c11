"""Listings, keys, object events and work routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, values
from ..operators import joins, summaries
from ..session import table
from ..sources import listings, responses
from . import derive
from .registry import query


@query(
    "s1_stage_scan",
    f"WITH {derive.LISTING} SELECT path FROM listing WHERE length < 1000000 AND path LIKE 'src1%/P%.pdf' ORDER BY path LIMIT 10",
)
def stage_scan(spark, folder):
    return listings.staged(derive.listing(spark, folder), "src1%/P%.pdf", 1_000_000, 10)


@query(
    "s2_folder_scan",
    f"""WITH {derive.LISTING} SELECT path, length FROM listing
    WHERE lower(regexp_extract(path, '[.]([^.]+)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg')""",
)
def folder_scan(spark, folder):
    return listings.with_endings(derive.listing(spark, folder), paths.DOCUMENT_ENDINGS).select("path", "length").orderBy("path")


@query(
    "s3_object_table",
    f"""WITH {derive.LISTING} SELECT path AS "File", format('{{:.1f}} KB', length / 1024.0) AS "Size",
      strftime(modified, '%Y-%m-%d %H:%M') AS "Modified" FROM listing WHERE starts_with(path, 'src') ORDER BY path LIMIT 100""",
)
def object_table(spark, folder):
    return listings.object_table(derive.listing(spark, folder), "src")


@query(
    "s4_glob_keys",
    f"""WITH {derive.LISTING} SELECT path, 'glob' AS rule FROM listing WHERE path LIKE 'src%' AND path GLOB '*P?[0-5]*.PNG'
    UNION ALL SELECT path, 'ending' FROM listing WHERE path LIKE 'src%' AND regexp_matches(path, '[.](pdf|png|jpg|jpeg|tiff|docx)$')""",
)
def glob_keys(spark, folder):
    files = derive.listing(spark, folder)
    by_glob = listings.batch_keys(files, "src", "*P?[0-5]*.PNG").select("path", F.lit("glob").alias("rule"))
    return by_glob.union(listings.batch_keys(files, "src").select("path", F.lit("ending").alias("rule")))


@query(
    "s5_folder_state",
    """SELECT CAST(count(*) AS BIGINT) AS files, CAST(greatest(100000 - count(*), 0) AS BIGINT) AS missing FROM pages
    WHERE url LIKE 'https://%' AND url NOT LIKE '%/'""",
)
def folder_state(spark, folder):
    keys = table(spark, folder, "pages").select(F.col("url").alias("path"))
    return listings.folder_state(keys, "https://", 100_000)


@query(
    "s10_latest_file",
    f"""WITH {derive.LISTING} SELECT path FROM listing WHERE path LIKE 'src%' AND path LIKE '%.md'
    ORDER BY modified DESC, path DESC LIMIT 1""",
)
def latest_file(spark, folder):
    return listings.latest_file(derive.listing(spark, folder), "src", ".md")


EVENT_KEYS = """
keys AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS bucket,
    CASE WHEN url LIKE 'http:%' THEN 'other/' ELSE 'input/' END || regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS key FROM pages)
"""


def trigger_events(spark, folder):
    """Trigger event with two records per page: the page's file and the marker of its folder."""
    url = F.col("url")
    root = F.when(url.startswith("http:"), "other/").otherwise("input/")
    key = F.concat(root, F.regexp_extract(url, r"^https?://[^/]+/(.*)$", 1))
    bucket = F.regexp_extract(url, r"^https?://([^/]+)/", 1)

    def record(k):
        return F.struct(F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(F.url_encode(k).alias("key")).alias("object")).alias("s3"))

    event = F.to_json(F.struct(F.array(record(key), record(F.concat(key, F.lit("/")))).alias("Records")))
    return table(spark, folder, "pages").select("page_id", event.alias("event"))


@query(
    "s11_event_records",
    f"""WITH {EVENT_KEYS} SELECT page_id, CAST(0 AS BIGINT) AS record, bucket, key FROM keys
    UNION ALL SELECT page_id, 1, bucket, key || '/' FROM keys""",
)
def event_records(spark, folder):
    rows = responses.event_rows(trigger_events(spark, folder), "event")
    return rows.select("page_id", F.col("record").cast("bigint").alias("record"), "bucket", "key")


@query(
    "f2_k10_work_items",
    f"""WITH {EVENT_KEYS} SELECT page_id, key, 'output/' || regexp_extract(substr(key, 7), '^(.*/)[^/]*$', 1)
      || regexp_replace(regexp_extract(key, '[^/]+$'), '(.)[.][^.]*$', '\\1') || '.md' AS output
    FROM keys WHERE key LIKE 'input/%' AND key NOT LIKE '%/'""",
)
def work_items(spark, folder):
    rows = responses.work_items(responses.event_rows(trigger_events(spark, folder), "event"))
    return rows.select("page_id", "key", "output")


@query(
    "f6_upload_candidates",
    "SELECT page_id FROM pages WHERE regexp_matches(url, '[^/][.](html|htm)$')",
)
def upload_candidates(spark, folder):
    keys = table(spark, folder, "pages").select("page_id", F.col("url").alias("path"))
    return listings.upload_candidates(keys, ("html", "htm")).select("page_id")


@query(
    "f7_created_objects",
    f"""WITH {derive.LISTING} SELECT path FROM listing WHERE length >= 1000 AND path LIKE 'src2%' AND path LIKE '%.pdf'""",
)
def created_objects(spark, folder):
    events = derive.listing(spark, folder).withColumn(
        "event", F.when(F.col("length") >= 1000, "s3:ObjectCreated:Put").otherwise("s3:ObjectRemoved:Delete")
    )
    return listings.new_objects(events, F.col("event"), F.col("path"), "src2", ".pdf").select("path")


@query(
    "p10_p11_names",
    """SELECT page_id, nullif(regexp_extract(url, '[^/]+$'), '') AS basename,
      regexp_extract(url, '[^/]*$') AS last_segment,
      regexp_replace(regexp_extract(url, '[^/]*$'), '(.)[.][^.]*$', '\\1') AS stem FROM pages""",
)
def names(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", paths.basename(url).alias("basename"), paths.last_segment(url).alias("last_segment"),
        paths.stem(paths.last_segment(url)).alias("stem"),
    )


@query(
    "p31_uri_parts",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/(.*)$', 1) AS bucket,
      regexp_extract(url, '^[a-z]+://([^/]+)/(.*)$', 2) AS key FROM pages""",
)
def uri_parts(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", paths.uri_bucket(url).alias("bucket"), paths.uri_key(url).alias("key"))


@query(
    "p33_trigger_route",
    f"""WITH {derive.LISTING} SELECT path, CASE WHEN path LIKE 'src1%' THEN 's3_event' ELSE 'manual' END AS trigger_type,
      CASE WHEN path LIKE 'src1%' OR regexp_matches(path, '[.](pdf|png|jpg|jpeg|tiff|docx)$') THEN path END AS specific_file,
      CASE WHEN path NOT LIKE 'src1%' AND NOT regexp_matches(path, '[.](pdf|png|jpg|jpeg|tiff|docx)$') THEN path END AS prefix
    FROM listing""",
)
def trigger_route(spark, folder):
    record = F.array(F.struct(F.struct(F.struct(F.col("path").alias("key")).alias("object")).alias("s3")))
    body = F.when(F.col("path").startswith("src1"), F.to_json(F.struct(record.alias("Records")))).otherwise(
        F.to_json(F.struct(F.col("path").alias("prefix")))
    )
    rows = derive.listing(spark, folder).select("path", F.parse_json(body).alias("event"))
    return rows.select("path", *[c.alias(n) for n, c in responses.route(F.col("event")).items()])


@query(
    "a11_folder_counts",
    """SELECT folder, CAST(count(*) AS BIGINT) AS files FROM (
      SELECT CASE WHEN len(string_split(k, '/')) > 2 THEN string_split(k, '/')[2] WHEN len(string_split(k, '/')) = 2 THEN 'root' END AS folder
      FROM (SELECT regexp_extract(url, '^https?://(.*)$', 1) AS k FROM pages) WHERE k NOT LIKE '%/')
    WHERE folder IS NOT NULL GROUP BY folder""",
)
def folder_counts(spark, folder):
    keys = table(spark, folder, "pages").select(F.regexp_extract("url", r"^https?://(.*)$", 1).alias("key"))
    return summaries.files_per_folder(keys, "key")


@query(
    "j1_file_map_join",
    """WITH files AS (SELECT url, regexp_replace(regexp_extract(url, '[^/]+$'), '[.?#].*$', '') AS basename FROM pages)
    SELECT doc_id, url AS path FROM documents JOIN files ON CAST(doc_id AS VARCHAR) = basename""",
)
def file_map_join(spark, folder):
    clean = F.regexp_replace(paths.basename(F.col("url")), r"[.?#].*$", "")
    files = table(spark, folder, "pages").select(F.col("url").alias("path"), clean.alias("basename"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("basename"))
    return joins.spread_join(files, docs, ["basename"], spread_by=["path"]).select("doc_id", "path")


DONE = "done AS (SELECT DISTINCT source || '/doc_' || d.doc_id || '.pdf' AS filename FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def done_outputs(spark, folder):
    """Outputs that exist already: those of the labelled documents."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id"), "doc_id")
    return docs.select(derive.filename().alias("filename"))


@query(
    "j8_skip_existing",
    f"""WITH {DONE} SELECT filename, CASE WHEN filename IN (SELECT filename FROM done) THEN 'skipped' ELSE 'pending' END AS status
    FROM (SELECT source || '/doc_' || doc_id || '.pdf' AS filename FROM documents)""",
)
def skip_existing(spark, folder):
    work = table(spark, folder, "documents").select(derive.filename().alias("filename"), "doc_id")
    return joins.with_status(work, done_outputs(spark, folder), ["filename"]).select("filename", "status")


@query(
    "j8_not_yet_done",
    f"""WITH {DONE} SELECT filename FROM (SELECT source || '/doc_' || doc_id || '.pdf' AS filename FROM documents)
    WHERE filename NOT IN (SELECT filename FROM done)""",
)
def not_yet_done(spark, folder):
    work = table(spark, folder, "documents").select(derive.filename().alias("filename"), "doc_id")
    return joins.not_yet_done(work, done_outputs(spark, folder), ["filename"]).select("filename")


@query(
    "t2_t3_sorted_preview",
    f"WITH {derive.LISTING} SELECT path, length FROM listing ORDER BY path LIMIT 10",
)
def sorted_preview(spark, folder):
    return derive.listing(spark, folder).select("path", "length").orderBy("path").limit(10)


@query(
    "p35_failure_status",
    """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 400 WHEN 'view' THEN 500 WHEN 'error' THEN 401 ELSE 500 END AS BIGINT) AS status_code,
      CASE event_type WHEN 'click' THEN 'configuration_error' WHEN 'view' THEN 'import_error' WHEN 'error' THEN 'authentication_error'
        ELSE 'unexpected_error' END AS error_type,
      CASE event_type WHEN 'purchase' THEN 'quota' WHEN 'signup' THEN 'page_limit' END AS hint FROM events""",
)
def failure_status(spark, folder):
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", "ValueError: No bucket_name provided").when(kind == "view", "No module named 'x'")
        .when(kind == "error", F.concat(F.lit("missing API_KEY for user "), F.col("user_id").cast("string")))
        .when(kind == "purchase", "402 Payment Required").otherwise("document exceeds the maximum of 50 pages")
    )
    rows = table(spark, folder, "events").select("event_id", message.alias("m"))
    code, error = values.failure_status(F.col("m"))
    return rows.select("event_id", code.alias("status_code"), error.alias("error_type"), values.failure_hint(F.col("m")).alias("hint"))
