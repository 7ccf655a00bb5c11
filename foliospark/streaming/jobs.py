"""Job states: last status, first terminal status and timeouts.

As a mergeable aggregate that any reader can judge at any time (``job_state``, ``track``), and as a stream that itself
writes each job's end or timeout once, by event time (``finished`` with timers, ``watch`` with a table of open jobs).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.summaries import moment
from . import ingest

# Statuses that end a job, and the seconds a job may take.
TERMINAL = ("completed", "failed")
TIMEOUT_SECONDS = 3600


def job_state(rows: DataFrame, job: str = "job_id", status: str = "status", time: str = "ts") -> DataFrame:
    """Start, last status and first terminal status per job. Works on batches and streams; needs no Python state."""
    ends = F.col(status).isin(*TERMINAL)
    return rows.groupBy(job).agg(
        F.min(time).alias("started"),
        F.max_by(F.struct(F.col(status).alias("status")), F.struct(time, status))["status"].alias("last_status"),
        F.min(F.when(ends, F.struct(F.col(time).alias("at"), F.col(status).alias("status")))).alias("terminal"),
        F.max(F.struct(F.col(time).alias("at"), F.col(status).alias("status"))).alias("last"),
    )


def merged_states(states: DataFrame, job: str = "job_id") -> DataFrame:
    """State per job of a table that holds one row per job and changed batch, of any number of runs."""
    last = F.max("last")["status"].alias("last_status")
    return states.groupBy(job).agg(F.min("started").alias("started"), last, F.min("terminal").alias("terminal"))


def outcomes(states: DataFrame, now: datetime, timeout_seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """Final status of each job as a waiting client would see it at ``now``."""
    deadline = F.col("started") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    in_time = F.col("terminal").isNotNull() & (F.col("terminal.at") < deadline)
    outcome = F.when(in_time, F.col("terminal.status")).when(moment(now, states, "started") >= deadline, "timeout").otherwise(F.col("last_status"))
    return states.withColumn("outcome", outcome)


def track(rows: DataFrame, out: str, checkpoint: str | None = None, **names: str) -> DataFrame:
    """Stream job statuses into a state table; only changed jobs are written per batch."""
    state = job_state(rows, **names)
    ingest.open_table(rows.sparkSession, out, state.schema)
    ingest.run(state, lambda batch, at: ingest.save_batch(batch, out, at), checkpoint, mode="update")
    return merged_states(rows.sparkSession.read.parquet(out), names.get("job", "job_id"))


def finished(rows: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, delay: str = "10 minutes", job: str = "job_id", status: str = "status", time: str = "ts") -> DataFrame:
    """Stream of ``job, outcome, at``: one row for each job, when it ends in time or when its deadline passes.

    The deadline is ``timeout_seconds`` after the first status. A job that ends before it gives its first terminal status;
    another gives ``timeout`` once the watermark, ``delay`` behind the latest row, is past the deadline. An ended job
    stays in the state until then, so that later rows of it change nothing, and a timed-out one leaves with its row; what
    is kept are the jobs of the last ``timeout_seconds`` and ``delay``. Rows without a job or time are left out.
    Python is called for each job of a batch; ``watch`` gives the same for very many jobs.
    """
    limit = int(timeout_seconds * 1000)

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def told(outcome: str, at: int) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({job: [key[0]], "outcome": [outcome], "at": [pd.Timestamp(at, unit="ms")]})

        started, ended = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield from told("timeout", started + limit)
            return
        seen = pd.concat(list(parts)).sort_values(["ms", status])
        first = int(seen["ms"].iloc[0])
        started = first if started is None else min(first, started)
        deadline = started + limit
        if not ended:
            ends = seen[seen[status].isin(TERMINAL) & (seen["ms"] < deadline)]
            if len(ends):
                ended = True
                yield from told(ends[status].iloc[0], int(ends["ms"].iloc[0]))
        if deadline <= state.getCurrentWatermarkMs():  # already past: nothing to wait for
            if not ended:
                yield from told("timeout", deadline)
            if state.exists:
                state.remove()
            return
        state.update((started, ended))
        state.setTimeoutTimestamp(deadline)

    kind = rows.schema[job].dataType.simpleString()
    timed = rows.select(job, status, F.col(time).cast("timestamp").alias(time)).where(F.col(job).isNotNull() & F.col(time).isNotNull())
    timed = timed.withWatermark(time, delay).withColumn("ms", F.unix_millis(time))
    return timed.groupBy(job).applyInPandasWithState(
        follow, f"{job} {kind}, outcome string, at timestamp", "started bigint, ended boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def watch(
    rows: DataFrame, out: str, checkpoint: str | None = None, timeout_seconds: int = TIMEOUT_SECONDS, delay: str = "10 minutes", job: str = "job_id",
    status: str = "status", time: str = "ts",
) -> DataFrame:
    """Writes jobs to a table as ``finished`` tells them, each once, and returns it.

    The open jobs are a table beside the result instead of a state that Python is called on key by key: a batch reduces its
    rows to one for each job, joins them with the jobs that its forerunner left open, and writes all that it knows once. Two
    such tables take turns, so a batch that is run again finds the one before it, and both hold the jobs of the last
    ``timeout_seconds`` and ``delay`` only.
    """
    spark = rows.sparkSession
    kind = rows.schema[job].dataType.simpleString()
    ingest.open_table(spark, out, f"{job} {kind}, outcome string, at timestamp")
    limit = F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    empty = spark.createDataFrame([], f"{job} {kind}, started timestamp, ended boolean")
    timed = rows.select(job, status, F.col(time).cast("timestamp").alias(time)).where(F.col(job).isNotNull() & F.col(time).isNotNull())

    def each_batch(batch: DataFrame, at: ingest.Batch) -> None:
        run, number = at
        own, before = (f"{out.rstrip('/')}_open/{run}/{n % 2}" for n in (number, number - 1))
        mark, known = None, empty
        if number:
            mark = spark.read.parquet(f"{before}/mark").where(F.col("batch") == number - 1).first()["mark"]
            known = spark.read.parquet(f"{before}/jobs").where("open").select(job, "started", "ended")
        fresh = batch if mark is None else batch.where(F.col(time) > F.lit(mark).cast("timestamp"))
        # One number: the watermark, ``delay`` behind the latest row.
        latest = fresh.agg((F.max(time) - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
        moved = max((m for m in (latest, mark) if m is not None), key=datetime.fromisoformat, default=None)
        first_end = F.min(F.when(F.col(status).isin(*TERMINAL), F.struct(F.col(time).alias("at"), F.col(status).alias("status"))))
        told = fresh.groupBy(job).agg(F.min(time).alias("first"), first_end.alias("end"))
        joined = told.join(known, job, "full").withColumn("started", F.least("started", "first")).withColumn("deadline", F.col("started") + limit)
        due = F.col("deadline") < F.lit(moved).cast("timestamp")
        waits = ~F.coalesce("ended", F.lit(False))
        ends = waits & F.coalesce(F.col("end.at") < F.col("deadline"), F.lit(False))
        late = waits & ~ends & due
        joined.select(
            job, "started", (~waits | ends).alias("ended"), (~due).alias("open"),
            F.when(ends, F.col("end.status")).when(late, "timeout").alias("outcome"), F.when(ends, F.col("end.at")).when(late, F.col("deadline")).alias("at"),
        ).write.mode("overwrite").parquet(f"{own}/jobs")
        ingest.save_batch(spark.read.parquet(f"{own}/jobs").where(F.col("outcome").isNotNull()).select(job, "outcome", "at"), out, at)
        spark.createDataFrame([(number, moved)], "batch bigint, mark string").write.mode("overwrite").parquet(f"{own}/mark")

    ingest.run(timed, each_batch, checkpoint)
    return ingest.result_rows(spark, out)
