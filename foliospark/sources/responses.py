"""JSON responses, batch envelopes, object events and job results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths
from ..operators.arrays import unnest
from ..operators.joins import left_join_spreading_nulls


def read_responses(spark: SparkSession, folder: str, schema: str = schemas.PARSE_RESPONSE, pattern: str = "*.json") -> DataFrame:
    """One pretty-printed JSON object per file, under a declared schema."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern)
    return reader.json(folder).withColumn("file_name", F.col("_metadata.file_name"))


def parsed_responses(files: DataFrame, content: str = "content", schema: str = schemas.PARSE_RESPONSE) -> DataFrame:
    """Whole files (see ``named_files.read_named``), each with one JSON object, under a declared schema."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.from_json(content, schema).alias("__r")).select(*rest, "__r.*")


def read_envelopes(spark: SparkSession, folder: str, document: str) -> DataFrame:
    """Rows of all documents of all batch envelopes, with the batch columns."""
    rows = spark.read.schema(f"{schemas.ENVELOPE_HEAD}, part bigint, documents array<{document}>").json(folder)
    head = [c for c in rows.columns if c != "documents"]
    return rows.select(*head, F.posexplode("documents").alias("position", "document"))


def envelope_documents(df: DataFrame, column: str) -> DataFrame:
    """Documents of a JSON text of any of three shapes: a bare record, ``{"documents": [...]}``, a bare list.

    Adds ``position`` and VARIANT ``document``; entries that are not objects are left out.
    """
    doc = F.try_parse_json(F.col(column))
    kind = F.schema_of_variant(doc)
    bare = F.try_variant_get(doc, "$.invoice_info", "variant").isNotNull() | F.try_variant_get(
        doc, "$.customer_info", "variant"
    ).isNotNull()
    entries = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(doc, "$", "array<variant>"))
        .when(bare, F.array(doc))
        .otherwise(F.try_variant_get(doc, "$.documents", "array<variant>"))
    )
    rest = [c for c in df.columns if c != column]
    rows = unnest(df, rest, entries, "position", "document")
    return rows.where(F.schema_of_variant("document").startswith("OBJECT"))


def extraction_of(document: Column) -> Column:
    """The record inside a document: newer key, older key, or the document itself when it is one."""
    at = lambda path: F.try_variant_get(document, path, "variant")
    bare = at("$.invoice_info").isNotNull() | at("$.customer_info").isNotNull()
    real = lambda v: F.when(~F.is_variant_null(v), v)
    return (
        F.when(at("$.extraction_output").isNotNull(), real(at("$.extraction_output")))
        .when(at("$.extraction").isNotNull(), real(at("$.extraction")))
        .when(bare, document)
    )


def event_rows(events: DataFrame, column: str) -> DataFrame:
    """One row per record of a trigger event, its key URL-decoded; a bad escape gives null."""
    typed = F.from_json(column, schemas.OBJECT_EVENT)
    rest = [c for c in events.columns if c != column]
    rows = unnest(events, rest, typed["Records"], "record", "r")
    return rows.select(
        *rest, "record", F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("raw_key"),
        F.try_url_decode("r.s3.object.key").alias("key"),
    )


def work_items(events: DataFrame, root: str = "input/") -> DataFrame:
    """Records that name a file below the input folder, with the key of their result."""
    key = F.col("key")
    rows = events.where(key.startswith(root) & ~paths.is_folder_marker(key) & (paths.last_segment(key) != ""))
    return rows.withColumn("output", paths.output_key(key, root))


def route(event: Column) -> dict[str, Column]:
    """Trigger type, single file and prefix of a handler event given as VARIANT."""
    first = "$.Records[0].s3"
    key = F.try_variant_get(event, f"{first}.object.key", "string")
    prefix = F.try_variant_get(event, "$.prefix", "string")
    triggered = F.try_variant_get(event, first, "variant").isNotNull()
    single = F.coalesce(paths.names_single_file(prefix), F.lit(False))
    return {
        "trigger_type": F.when(triggered, "s3_event").otherwise("manual"),
        "specific_file": F.when(triggered, key).when(single, prefix),
        "prefix": F.when(~triggered & ~single, prefix),
    }


def resolved_results(jobs: DataFrame, linked: DataFrame, empty_fails: bool = True) -> DataFrame:
    """Markdown of finished jobs: inline when present, else from the linked result; a link to nothing is a failure.

    ``linked`` has ``output_url, linked_markdown`` and one row per url. An empty markdown is a failure as well, unless
    ``empty_fails`` is false, as for documents that may be empty.
    """
    rows = left_join_spreading_nulls(jobs, linked.withColumn("__linked", F.lit(True)), "output_url")
    inline = F.col("data").isNotNull()
    markdown = F.when(inline, F.col("data.markdown")).otherwise(F.col("linked_markdown"))
    failed = ~inline & F.col("__linked").isNull()
    if empty_fails:
        failed = failed | (F.coalesce(markdown, F.lit("")) == "")
    result = (
        F.when(F.col("status") != "completed", "not_completed")
        .when(~inline & F.col("output_url").isNull(), "no_output")
        .when(failed, "failed")
        .otherwise("success")
    )
    return rows.withColumn("result", result).withColumn("markdown", F.when(F.col("result") == "success", markdown)).drop("__linked")
