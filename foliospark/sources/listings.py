"""File listings as tables ``path, length, modificationTime``. File content is never read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import sinks


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    reader = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
    )
    return reader.load(folder).select("path", "length", "modificationTime")


def staged(listing: DataFrame, like: str, below_bytes: int, limit: int | None = None) -> DataFrame:
    """Paths under a size and of a name pattern; with a limit the first in path order."""
    rows = listing.where((F.col("length") < below_bytes) & F.col("path").like(like)).select("path")
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def with_endings(listing: DataFrame, endings, in_folder: str | None = None) -> DataFrame:
    """Files of the given endings, case ignored; ``in_folder`` leaves sub-folders out."""
    rows = listing.where(paths.has_ending(F.col("path"), endings))
    if in_folder is not None:
        root = in_folder.rstrip("/") + "/"
        rows = rows.where(F.col("path").startswith(root) & ~F.substring("path", len(root) + 1, 1 << 30).contains("/"))
    return rows


def object_table(listing: DataFrame, prefix: str = "", max_files: int = 100) -> DataFrame:
    """Printable listing, at most ``max_files`` in path order."""
    rows = listing.where(F.col("path").startswith(prefix)).orderBy("path").limit(max_files)
    return rows.select(
        F.col("path").alias("File"),
        # format_number rounds halves to even, as the printed sizes do; its thousands marks are dropped.
        F.concat(F.replace(F.format_number(F.col("length") / 1024, 1), F.lit(","), F.lit("")), F.lit(" KB")).alias("Size"),
        F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("Modified"),
    )


def batch_keys(listing: DataFrame, prefix: str, pattern: str | None = None) -> DataFrame:
    """Keys below a prefix that match the glob, or without one end like a document (case-sensitive)."""
    rows = listing.where(F.col("path").startswith(prefix))
    return rows.where(paths.matches_glob(F.col("path"), pattern) if pattern else paths.names_single_file(F.col("path")))


def folder_state(listing: DataFrame, prefix: str, expected: int | None = None) -> DataFrame:
    """Number of files below a prefix, and how many of the expected ones are missing."""
    rows = listing.where(F.col("path").startswith(prefix) & ~paths.is_folder_marker(F.col("path")))
    found = F.count(F.lit(1)).alias("files")
    missing = F.greatest(F.lit(expected or 0) - F.count(F.lit(1)), F.lit(0)).alias("missing")
    return rows.agg(found, missing)


def latest_file(listing: DataFrame, prefix: str, ending: str) -> DataFrame:
    """Path of the most recently modified file of an ending; equal times are settled by path."""
    rows = listing.where(F.col("path").startswith(prefix) & F.col("path").endswith(ending))
    return rows.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def read_latest_csv(spark: SparkSession, listing: DataFrame, prefix: str, schema: str, whole_folder: bool = False) -> DataFrame:
    """Rows of the most recent CSV file below a prefix, under a declared schema, so that no row is read to guess types.

    ``whole_folder`` reads all CSV files of that file's folder, as one written table has several. No file gives no row.
    """
    path = latest_file(listing, prefix, ".csv").first()[0]  # an aggregate of one row
    if path is None:
        return spark.createDataFrame([], schema)
    if whole_folder:
        path = path.rsplit("/", 1)[0]
    return sinks.csv_reader(spark, schema).option("pathGlobFilter", "*.csv").csv(path)


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Whole files as ``filename, content`` and the columns of partition folders."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    rest = [c for c in files.columns if c != "value"]
    return files.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"), *rest)


def upload_candidates(listing: DataFrame, endings) -> DataFrame:
    return listing.where(paths.has_ending(F.col("path"), endings))


def new_objects(events: DataFrame, event: Column, key: Column, prefix: str, suffix: str = "") -> DataFrame:
    """Object-created notifications below a prefix, with an optional suffix."""
    rows = events.where(event.startswith("s3:ObjectCreated:") & key.startswith(prefix))
    return rows.where(key.endswith(suffix)) if suffix else rows
