"""Log monitoring as a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summaries
from ..operators.joins import not_yet_done, seen_before
from . import ingest


def monitor(lines: DataFrame, out: str, time: str = "ts", checkpoint: str | None = None) -> DataFrame:
    """First sighting of every file in every status, kept in a table; returns that table.

    Repeated lines merge inside each task before the shuffle, so a noisy file is no hot spot.
    """
    spark: SparkSession = lines.sparkSession
    ingest.open_table(spark, out, "status string, file string, first_seen timestamp")

    def reduce(batch: DataFrame) -> DataFrame:
        rows = summaries.first_seen(summaries.classified(batch), time)
        return rows.withColumn("first_seen", F.col("first_seen").cast("timestamp"))

    ingest.keep_first(lines, out, ["status", "file"], reduce, checkpoint)
    return ingest.result_rows(spark, out)


def within_watermark(lines: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Stream variant with state bounded by a watermark: a file may be reported again after ``delay``."""
    rows = summaries.classified(lines).withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["status", "file"])


POLL = "poll"
TOTALS = "status string, lines bigint, files bigint"


def last_poll(spark: SparkSession, out: str) -> tuple[int, datetime | None]:
    """Number and cursor of the last finished poll; -1 and none before the first one."""
    ingest.save_batch(spark.createDataFrame([], "poll int, cursor timestamp_ntz"), f"{out}/cursor", ("none", -1))
    last = spark.read.parquet(f"{out}/cursor").agg(F.max_by("cursor", POLL).alias("cursor"), F.max(POLL).alias(POLL)).first()
    return (-1, None) if last[POLL] is None else (last[POLL], last["cursor"])


def poll(lines: DataFrame, out: str, since: datetime, until: datetime | None = None, time: str = "ts") -> int | None:
    """One poll of a log: lines later than the cursor, first sightings per status and file, and the running totals.

    ``lines`` is a plain table; the bounds on ``time`` reach its scan. The cursor starts at ``since`` (included) and moves to
    the last time that was read, so later polls read later lines only, and lines that arrive with earlier times are not read. Each
    poll writes below ``out`` its new ``sightings``, its ``totals`` (lines and different files per status so far) and, last, its
    ``cursor``. A poll that stopped before that is done again under its number and replaces what it left: nothing is lost or
    told twice. Lines without a time are not read. Returns the poll's number, or none where no line is new.
    """
    spark = lines.sparkSession
    number, cursor = last_poll(spark, out)
    kind = lines.schema[time].dataType
    at = lambda moment: F.lit(moment.isoformat(" ")).cast(kind)
    after = F.col(time) >= at(since) if cursor is None else F.col(time) > at(cursor)
    fresh = lines.where(after if until is None else after & (F.col(time) <= at(until)))
    end = fresh.agg(F.max(time).cast("timestamp_ntz")).first()[0]
    if end is None:
        return None
    batch = ("poll", number + 1)
    # One row for each status and file; the lines are read once more, up to the same end whatever has arrived since.
    rows = summaries.classified(fresh.where(F.col(time) <= at(end)))
    items = rows.groupBy("status", "file").agg(F.min(time).alias("first_seen"), F.count(F.lit(1)).alias("lines")).persist()
    done_keys = ingest.key_table(f"{out}/sightings", ["status", "file"])
    new = not_yet_done(items, seen_before(done_keys.done(items, batch), items, ["status", "file"]), ["status", "file"], unique=True)
    ingest.save_batch(new.drop("lines"), f"{out}/sightings", batch)
    done_keys.add(items, batch)
    ingest.open_table(spark, f"{out}/totals", f"poll int, {TOTALS}")
    before = spark.read.parquet(f"{out}/totals").where(F.col(POLL) == number).select("status", "lines", "files")
    told = spark.read.parquet(f"{out}/sightings/{ingest.RUN}={batch[0]}/{ingest.BATCH}={batch[1]}")
    parts = (
        before.unionByName(items.select("status", "lines", F.lit(0).cast("bigint").alias("files")))
        .unionByName(told.select("status", F.lit(0).cast("bigint").alias("lines"), F.lit(1).cast("bigint").alias("files")))
    )
    totals = parts.groupBy("status").agg(F.sum("lines").alias("lines"), F.sum("files").alias("files"))
    ingest.save_batch(totals.select(F.lit(batch[1]).alias(POLL), "status", "lines", "files"), f"{out}/totals", batch)
    items.unpersist()
    moved = spark.createDataFrame([(batch[1], end)], "poll int, cursor timestamp_ntz")
    ingest.save_batch(moved, f"{out}/cursor", batch)
    return batch[1]


def follow(
    read: Callable[[], DataFrame], out: str, since: datetime, waits: Callable[[], bool] = lambda: False, time: str = "ts"
) -> None:
    """Poll again and again: after each poll ``waits`` sleeps and tells whether to go on. Without it, once."""
    while True:
        poll(read(), out, since, time=time)
        if not waits():
            return
