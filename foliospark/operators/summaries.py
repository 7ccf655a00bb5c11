"""Reports over statuses, logs, folders and usage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values
from .arrays import unnest_fields

# Marker text in a log line and the file name it carries, per status.
LOG_MARKERS = {
    "processed": r"Completed pipeline for (.*?) →",
    "processing": r"Starting .*?parsing for (.*?) \(",
    "skipped": r"Skipping (.*?) - already processed",
    "error": r"Error processing ([^:]*):",
}


def moment(now: datetime, df: DataFrame, time: str) -> Column:
    """``now`` as a constant of the type of a time column, so that no zone shift comes between the two."""
    return F.lit(now.isoformat(" ")).cast(df.schema[time].dataType)


def recent(events: DataFrame, time: str, now: datetime, pattern: str | None = None, **span: int) -> DataFrame:
    """Rows of the look-back window that ends at ``now``; ``span`` is e.g. ``hours=24`` or ``minutes=10``."""
    (unit, amount), = span.items()
    end = moment(now, events, time)
    rows = events.where(F.col(time).between(end - F.expr(f"INTERVAL {int(amount)} {unit}"), end))
    return rows.where(F.col("message").contains(pattern)) if pattern else rows


def matches(events: DataFrame, time: str, now: datetime, patterns: list[str], **span: int) -> DataFrame:
    """Rows of the look-back window with ``pattern``, once for each pattern that their message has, in one pass."""
    hits = F.array_compact(F.array(*[F.when(F.col("message").contains(p), F.lit(p)) for p in patterns]))
    return recent(events, time, now, **span).withColumn("pattern", F.explode(hits))


def classified(events: DataFrame, message: str = "message") -> DataFrame:
    """Status and file name per log line; lines without a marker drop.

    Both come out of one generated row, so that a line is put together and matched once: a filter on a plain column would
    be copied below it, with the whole text in every marker's test.
    """
    text = F.col(message)
    found = None
    for name, pattern in LOG_MARKERS.items():
        told = F.struct(F.lit(name).alias("status"), F.regexp_extract(text, pattern, 1).alias("file"))
        found = F.when(text.rlike(pattern), told) if found is None else found.when(text.rlike(pattern), told)
    kept = [F.col(f"`{c}`") for c in events.columns if c.lower() not in ("status", "file")]
    return unnest_fields(events, kept, F.array(found), "status")


def first_seen(lines: DataFrame, time: str) -> DataFrame:
    """First time each file was seen in each status; repeated lines merge before the shuffle."""
    return lines.groupBy("status", "file").agg(F.min(time).alias("first_seen"))


def files_per_status(lines: DataFrame) -> DataFrame:
    return lines.groupBy("status").agg(F.countDistinct("file").alias("files"))


def file_lists(lines: DataFrame) -> DataFrame:
    """The files of each status, one row for each, so that no list is a value of unbounded size."""
    return lines.where(F.col("status").isNotNull()).select("status", "file").distinct()


def success_totals(rows: DataFrame, ok: Column, *by: str) -> DataFrame:
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")]
    return (rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)).withColumn(
        "success_rate", values.percent(F.col("succeeded"), F.col("total"))
    )


def files_per_folder(keys: DataFrame, key: str) -> DataFrame:
    """Files per second path segment; folder markers and bare names are left out."""
    rows = keys.where(~paths.is_folder_marker(F.col(key))).select(paths.top_folder(F.col(key)).alias("folder"))
    return rows.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def usage(responses: DataFrame, *by: str) -> DataFrame:
    """Pages, seconds and credits of parse metadata; sums are exact decimals."""
    credits = F.col("metadata.credit_usage").cast("decimal(18,4)")
    return responses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("metadata.page_count").alias("pages"),
        (F.sum("metadata.duration_ms") / 1000).alias("seconds"), F.sum(credits).alias("credits"),
        (F.avg("metadata.duration_ms") / 1000).alias("seconds_per_document"),
    )


def count_by(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *by)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication; partial aggregation drops repeats before the shuffle."""
    return df.distinct()


def named_view(df: DataFrame, dimensions: dict[str, tuple[list[str], str]]) -> DataFrame:
    """View with a comment and a synonym list on each dimension column."""
    return df.select(
        *[
            F.col(c).alias(c, metadata={"comment": note, "synonyms": names})
            for c, (names, note) in dimensions.items()
        ]
    )


def pick(view: DataFrame, *names: str) -> DataFrame:
    """Columns by physical name or synonym, case ignored, under the asked names."""
    known = {}
    for field in view.schema.fields:
        for name in [field.name, *(field.metadata or {}).get("synonyms", [])]:
            known.setdefault(name.lower(), field.name)
    return view.select(*[F.col(known[n.lower()]).alias(n) for n in names])
