"""Streams of new objects and idempotent, skip-existing processing.

State lives in result tables, one folder per run and micro-batch. A run is what one checkpoint location follows; a
repeated batch of a run overwrites its own folder and ignores it when it looks for earlier work (see ``keys``), so a lost driver or
executor never leaves duplicates, and a run with another checkpoint adds to what earlier runs have left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import not_yet_done, seen_before, with_status
from ..session import fresh_path
from .keys import Batch, KeyTable

RUN, BATCH = "run_id", "batch_id"


def new_files(spark: SparkSession, folder: str, pattern: str = "*", text: bool = False) -> DataFrame:
    """Stream with one row per new file: its listing entry, or name and whole text."""
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if text:
        rows = reader.format("text").option("wholetext", True).load(folder)
        return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return reader.format("binaryFile").schema(schema).load(folder).select("path", "length", "modificationTime")


def new_rows(
    spark: SparkSession, folder: str, schema, form: str = "parquet", pattern: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    reader = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def run(stream: DataFrame, each_batch: Callable[[DataFrame, Batch], None], checkpoint: str | None = None, mode: str = "append") -> list:
    """Process everything that is there now, batch by batch, and return the progress of the last batches.

    ``each_batch`` gets the rows and the batch: the run's name, which the checkpoint location gives, and its number.
    """
    checkpoint = checkpoint or fresh_path(stream.sparkSession, "stream-checkpoint")
    name = "r" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    query = (
        stream.writeStream.foreachBatch(lambda rows, number: each_batch(rows, (name, number))).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


def open_table(spark: SparkSession, path: str, schema) -> None:
    """Make sure that a result table can be read before its first batch."""
    save_batch(spark.createDataFrame([], schema), path, ("none", -1))


def key_table(path: str, keys: list[str]) -> KeyTable:
    """The keys that a result table has done, kept beside it by hash bucket."""
    return KeyTable(f"{path.rstrip('/')}_keys", tuple(keys))


def record(rows: DataFrame, path: str, keys: list[str], batch: Batch) -> None:
    """Results of work that was done elsewhere, as a batch of their own; their keys count as done."""
    save_batch(rows, path, batch)
    key_table(path, keys).add(rows, batch)


def save_batch(rows: DataFrame, path: str, batch: Batch) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{RUN}={batch[0]}/{BATCH}={batch[1]}")


def result_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a result table, without the columns that name run and batch."""
    return spark.read.parquet(path).drop(RUN, BATCH)


def ingest(
    stream: DataFrame,
    out: str,
    keys: list[str],
    process: Callable[[DataFrame], DataFrame],
    checkpoint: str | None = None,
    force: bool = False,
) -> None:
    """Status row ``success``, ``skipped`` or ``failed`` per new item; items with an earlier success are skipped.

    ``process`` gets the pending rows and returns them with ``ok`` (boolean) and ``error`` (text or null).
    """

    table = key_table(out, keys)

    def each_batch(batch: DataFrame, at: Batch) -> None:
        # Used several times; a lost block is recomputed from the batch.
        items = batch.dropDuplicates(keys).persist()
        done = seen_before(table.done(items, at), items, keys)
        marked = with_status(items, done, keys, force, unique=True)
        worked = process(marked.where(F.col("status") == "pending"))
        tried = worked.select(*keys, F.when(F.col("ok"), "success").otherwise("failed").alias("status"), "error")
        skipped = marked.where(F.col("status") == "skipped").select(*keys, "status", F.lit("already_processed").alias("error"))
        save_batch(tried.unionByName(skipped), out, at)
        own = items.sparkSession.read.parquet(f"{out}/{RUN}={at[0]}/{BATCH}={at[1]}")
        table.add(own.where(F.col("status") == "success"), at)
        items.unpersist()

    run(stream, each_batch, checkpoint)


def keep_first(
    stream: DataFrame, out: str, keys: list[str], reduce: Callable[[DataFrame], DataFrame], checkpoint: str | None = None
) -> None:
    """Append each key once, in its first batch. ``reduce`` gives one row per key and merges repeats per task."""

    table = key_table(out, keys)

    def each_batch(batch: DataFrame, at: Batch) -> None:
        items = reduce(batch).persist()
        done = seen_before(table.done(items, at), items, keys)
        save_batch(not_yet_done(items, done, keys, unique=True), out, at)
        table.add(items, at)
        items.unpersist()

    run(stream, each_batch, checkpoint)
