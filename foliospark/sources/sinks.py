"""Writers. Data is partitioned by Spark; nothing is gathered before it is written."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.joins import null_safe_join
from ..operators.ordered import part_numbers

#: Form of the CSV files. Spark's writer would cut white space and control characters off both ends of a value.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_json(df: DataFrame, path: str, by: str | None = None) -> str:
    """JSON results; ``by`` makes one folder per value, e.g. per document stem."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
    return path


def write_text(df: DataFrame, path: str, text: str, by: str, most_rows: int = 0) -> str:
    """Markdown texts, one folder per value of ``by`` (files of at most ``most_rows`` records, 0 for no bound).

    Each record ends with a line break.
    """
    writer = df.select(by, text).write.mode("overwrite").option("maxRecordsPerFile", most_rows)
    writer.partitionBy(by).text(path)
    return path


def write_csv(df: DataFrame, path: str, by: str | None = None) -> str:
    """CSV with a header, as one table or one folder per document."""
    writer = df.write.mode("overwrite").options(**CSV)
    (writer.partitionBy(by) if by else writer).csv(path)
    return path


def csv_reader(spark: SparkSession, schema: str) -> DataFrameReader:
    """Reader of CSV files under a declared schema, whose values may hold line ends.

    An empty field is null and ``""`` an empty text, as they are written. By default Spark reads both as null, since the empty
    text stands for null; here a text does that no file holds.
    """
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).option("nullValue", uuid.uuid4().hex)


def csv_text(items: Column, line: Callable[[Column], dict[str, Column]]) -> Column:
    """CSV text with a header, one line for each item of an array, in order; a null or empty array gives the header alone.

    Values are quoted where they hold commas, quotes or line ends, quotes are doubled, and a null value is an empty one.
    """
    names = list(line(F.lit(None)))

    def quoted(value: Column) -> Column:
        whole = F.coalesce(value.cast("string"), F.lit(""))
        return F.when(whole.rlike(r'[",\r\n]|^\s|\s$'), F.concat(F.lit('"'), F.replace(whole, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(whole)

    lines = F.transform(items, lambda i: F.concat_ws(",", *[quoted(v) for v in line(i).values()]))
    return F.concat(F.array_join(F.array_prepend(F.coalesce(lines, F.array().cast("array<string>")), ",".join(names)), "\n"), F.lit("\n"))


def csv_records(content: Column, schema: str) -> Column:
    """Rows of a CSV text as ``csv_text`` writes it, without its header, as an array of structs of the declared schema."""
    # A record ends at a line break outside quotes.
    records = F.regexp_extract_all(content, F.lit(r'(?:[^"\n]++|"[^"]*+")++'), F.lit(0))
    rest = F.slice(records, 2, F.greatest(F.size(records) - 1, F.lit(0)))
    return F.transform(rest, lambda r: F.from_csv(r, schema, {"quote": '"', "escape": '"'}))


def fixed_columns(df: DataFrame, order) -> DataFrame:
    """Exact column order; a missing column or value is written as an empty text."""
    have = set(df.columns)
    return df.select(
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in order]
    )


def write_fixed_csv(df: DataFrame, path: str, order) -> str:
    fixed_columns(df, order).write.mode("overwrite").options(**CSV).option("emptyValue", "").csv(path)
    return path


def write_tables(tables: dict[str, DataFrame], root: str, form: str = "parquet") -> dict[str, str]:
    """Several tables of one job below one folder; columnar ones as zstd, since each table repeats the keys, which are digests."""
    out = {}
    packed = {"compression": "zstd"} if form in ("parquet", "orc") else {}
    for name, df in tables.items():
        out[name] = f"{root}/{name}"
        df.write.mode("overwrite").format(form).options(header=True, **packed).save(out[name])
    return out


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create or replace a table with the rows of ``df``, at ``path`` or in the warehouse."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def result_key(specific_file: Column, extracting: Column, stamp: Column) -> Column:
    """``<stem>_<mode>_<time>`` for one file, ``batch_<mode>_<time>`` for a prefix."""
    mode = F.when(extracting, "extracted").otherwise("parsed")
    name = F.coalesce(F.regexp_replace(paths.last_segment(specific_file), r"\.[^.]*$", ""), F.lit("batch"))
    return F.concat_ws("_", name, mode, stamp)


def envelopes(
    docs: DataFrame, batch: list[str], order: str, order_value: Column, rows_per_part: int = 1000, bytes_per_part: int = 16 << 20,
    size: Column | None = None,
) -> DataFrame:
    """Batch envelopes with the document count of the batch.

    A batch of more than ``rows_per_part`` documents or ``bytes_per_part`` bytes (``size`` of a document: its JSON text, if not
    given) gives several envelopes with a ``part`` number, so that no task collects a whole batch; the parts together hold
    every document once, in order. A null batch column is a value like any other.
    """
    content = [c for c in docs.columns if c not in batch]
    size = F.octet_length(F.to_json(F.struct(*content))) if size is None else size
    placed = part_numbers(docs, batch, [order], order_value, size, bytes_per_part, rows_per_part)
    entry = F.struct(F.col(order).isNotNull().alias("n"), F.col(order).alias("o"), F.struct(*content).alias("d"))
    parts = placed.groupBy(*batch, "part").agg(F.array_sort(F.collect_list(entry)).alias("__d"))
    counts = docs.groupBy(*batch).agg(F.count(F.lit(1)).alias("parsed_count"))
    return null_safe_join(parts, counts, batch).select(
        *batch, "part", "parsed_count", F.transform("__d", lambda e: e["d"]).alias("documents")
    )


def report_lines(report: DataFrame, name: str, errors: DataFrame | None = None) -> DataFrame:
    """Text lines of a per-entity report: counts, the recent filings if any, and one line for each row of ``errors`` (``error``)."""
    recent = report.where(F.col("recent_filings").isNotNull()).select(F.concat(F.col(name), F.lit(": recent "), F.col("recent_filings")).alias("value"))
    counts = report.select(
        F.concat(
            F.col(name), F.lit(": filings "), F.col("filing_count").cast("string"), F.lit(", downloaded "),
            F.col("download_count").cast("string"), F.lit(" ("), F.format_number("success_rate", 1), F.lit("%)"),
        ).alias("value")
    )
    lines = counts.union(recent)
    return lines if errors is None else lines.union(errors.select(F.concat(F.lit("error: "), F.col("error")).alias("value")))
