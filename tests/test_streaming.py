"""Streams in several batches, repeated batches and restarts."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.streaming import index, ingest, jobs, keys, logs


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    return folder


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def stream(spark, folder, schema):
    return ingest.new_rows(spark, str(folder), schema, "json", files_per_batch=1)


def no_failure(rows):
    return rows.withColumn("ok", F.col("key") != "bad").withColumn("error", F.when(F.col("key") == "bad", "broken"))


def test_ingest_skips_earlier_successes_and_retries_failures(spark, tmp_path, inbox):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.open_table(spark, out, "key string, status string, error string")
    go = lambda: ingest.ingest(stream(spark, inbox, "key string"), out, ["key"], no_failure, check)
    put(inbox, "1.json", [{"key": "a"}, {"key": "a"}, {"key": "bad"}])
    go()
    put(inbox, "2.json", [{"key": "a"}, {"key": "b"}, {"key": "bad"}])
    go()
    go()
    rows = spark.read.parquet(out).collect()
    got = sorted((r["batch_id"], r["key"], r["status"]) for r in rows)
    assert got == [(0, "a", "success"), (0, "bad", "failed"), (1, "a", "skipped"), (1, "b", "success"), (1, "bad", "failed")]


def test_force_never_skips(spark, tmp_path, inbox):
    out = str(tmp_path / "out")
    ingest.open_table(spark, out, "key string, status string, error string")
    put(inbox, "1.json", [{"key": "a"}])
    for n in ("c1", "c2"):
        ingest.ingest(stream(spark, inbox, "key string"), out, ["key"], no_failure, str(tmp_path / n), force=True)
    assert [r["status"] for r in spark.read.parquet(out).collect()] == ["success", "success"]


def test_repeated_batch_leaves_no_duplicates(spark, tmp_path):
    out, at = str(tmp_path / "out"), ("r1", 0)
    ingest.open_table(spark, out, "key string")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    done = ingest.key_table(out, ["key"])
    for _ in range(2):  # a batch that is run again after a failure
        assert done.done(rows, at).count() == 0
        ingest.record(rows, out, ["key"], at)
    assert sorted(r["key"] or "" for r in ingest.result_rows(spark, out).collect()) == ["", "a", "b"]
    assert sorted(r["key"] or "" for r in done.done(rows, ("r1", 1)).collect()) == ["", "a", "b"]


def test_files_read_by_a_batch_do_not_grow_with_history(spark, tmp_path):
    table = keys.KeyTable(str(tmp_path / "k"), ("key",), buckets=4, most_parts=3)
    added, most = set(), 0
    for batch in range(16):
        rows = spark.createDataFrame([(f"{batch}-{i}",) for i in range(6)] + [("again",)], "key string").coalesce(1)
        before = table.done(rows, ("r", batch))
        most = max(most, len(before.inputFiles()))
        touched = set(table.touched(rows))
        want = {k for k, b in added if b in touched}
        assert {r["key"] for r in before.collect()} == want
        table.add(rows, ("r", batch))
        added |= {(r[0], r[1]) for r in rows.select("key", table.bucket()).collect()}
    assert most <= 4 * 3
    one = spark.createDataFrame([("0-1",)], "key string")
    assert len(table.parts(spark, table.touched(one))) == 1  # only its own bucket is listed


def test_crowded_bucket_is_written_anew_without_loss(spark, tmp_path):
    table = keys.KeyTable(str(tmp_path / "k"), ("key",), buckets=1, most_parts=2)
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "key string")
    for i, name in enumerate("abcd"):
        table.add(rows(name), ("r", i))
    assert sorted(r[0] for r in table.done(rows("x"), ("r", 4)).collect()) == list("abcd")
    assert table.parts(spark, [0]) == {0: ["of_r_4"]}
    table.add(rows("x"), ("r", 4))
    assert sorted(r[0] for r in table.done(rows("x"), ("r", 4)).collect()) == list("abcd")  # repeated after a failure
    assert sorted(r[0] for r in table.done(rows("x"), ("s", 0)).collect()) == list("abcdx")


def test_another_checkpoint_keeps_earlier_results(spark, tmp_path, inbox):
    out = str(tmp_path / "out")
    ingest.open_table(spark, out, "key string, status string, error string")
    put(inbox, "1.json", [{"key": "a"}, {"key": "b"}])
    ingest.ingest(stream(spark, inbox, "key string"), out, ["key"], no_failure)
    put(inbox, "2.json", [{"key": "b"}, {"key": "c"}])
    ingest.ingest(stream(spark, inbox, "key string"), out, ["key"], no_failure)
    got = sorted((r["key"], r["status"]) for r in ingest.result_rows(spark, out).collect())
    assert got == [("a", "skipped"), ("a", "success"), ("b", "skipped"), ("b", "skipped"), ("b", "success"), ("c", "success")]


def test_log_monitor_over_batches(spark, tmp_path, inbox):
    line = lambda t, m: {"ts": f"2024-01-01T00:{t:02d}:00Z", "message": m}
    put(inbox, "1.json", [line(5, "Error processing a.pdf: x"), line(3, "Error processing a.pdf: y"), line(1, "REPORT")])
    put(inbox, "2.json", [line(9, "Error processing a.pdf: z"), line(8, "Completed pipeline for a.pdf → o")])
    rows = logs.monitor(stream(spark, inbox, "ts timestamp, message string"), str(tmp_path / "out")).collect()
    got = sorted((r["status"], r["file"], r["first_seen"].minute) for r in rows)
    assert got == [("error", "a.pdf", 3), ("processed", "a.pdf", 8)]


def test_watermarked_variant(spark, tmp_path, inbox):
    put(inbox, "1.json", [{"ts": f"2024-01-01T00:0{i}:00Z", "message": "Error processing a.pdf: x"} for i in range(5)])
    rows = logs.within_watermark(stream(spark, inbox, "ts timestamp, message string"))
    q = rows.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1


def test_job_states_over_batches(spark, tmp_path, inbox):
    row = lambda job, minute, status: {"job_id": job, "ts": f"2024-01-01T0{minute // 60}:{minute % 60:02d}:00Z", "status": status}
    put(inbox, "1.json", [row("a", 0, "processing"), row("b", 0, "processing"), row("c", 0, "processing"), row("d", 100, "processing")])
    put(inbox, "2.json", [row("a", 10, "completed"), row("a", 20, "failed"), row("b", 70, "completed")])
    updates = stream(spark, inbox, "job_id string, ts timestamp, status string")
    states = jobs.track(updates, str(tmp_path / "out"))
    got = {r["job_id"]: r["outcome"] for r in jobs.outcomes(states, datetime(2024, 1, 1, 2)).collect()}
    # a ends in time (its first end counts), b ends too late, c never ends, d still has time.
    assert got == {"a": "completed", "b": "timeout", "c": "timeout", "d": "processing"}
    batch = jobs.outcomes(jobs.job_state(spark.read.schema(updates.schema).json(str(inbox))), datetime(2024, 1, 1, 2))
    assert {r["job_id"]: r["outcome"] for r in batch.collect()} == got


def test_finished_jobs_leave_the_stream_once(spark, tmp_path, inbox):
    row = lambda job, minute, status: {"job_id": job, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "status": status}
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    batches = [
        [row("a", 0, "processing"), row("b", 0, "processing"), row("b", 20, "failed"), row("c", 5, "completed"), row(None, 1, "failed")],
        [row("a", 30, "processing"), row("b", 40, "completed"), row("d", 50, "processing")],
        [row("e", 200, "processing")],  # the watermark passes the deadlines of a to d
        [row("e", 210, "completed"), row("f", 400, "processing")],
    ]
    sizes = []
    for i, rows in enumerate(batches):
        put(inbox, f"{i}.json", rows)
        updates = jobs.finished(stream(spark, inbox, "job_id string, ts timestamp, status string"), 3600)
        progress = ingest.run(updates, lambda b, at: ingest.save_batch(b, out, at), check)
        sizes.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    got = sorted((r["job_id"], r["outcome"], r["at"].strftime("%H:%M")) for r in ingest.result_rows(spark, out).collect())
    # b's first end counts, a and d time out an hour after their first row, f still has time.
    assert got == [("a", "timeout", "01:00"), ("b", "failed", "00:20"), ("c", "completed", "00:05"), ("d", "timeout", "01:50"), ("e", "completed", "03:30")]
    assert sizes == [3, 4, 1, 1]  # ended and timed-out jobs leave the state


def test_watched_jobs_need_no_call_for_each_job(spark, tmp_path, inbox, monkeypatch):
    row = lambda job, minute, status: {"job_id": job, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "status": status}
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    batches = [
        [row("a", 0, "processing"), row("b", 0, "processing"), row("b", 20, "failed"), row("c", 5, "completed"), row(None, 1, "failed")],
        [row("a", 30, "processing"), row("b", 40, "completed"), row("d", 50, "processing")],
        [row("e", 200, "processing"), row("g", 45, "processing")],  # the watermark passes the deadlines of a, d and g
        [row("e", 210, "completed"), row("f", 400, "processing"), row("a", 31, "completed")],  # a's row comes behind the watermark
    ]
    monkeypatch.setattr(jobs, "finished", None)
    go = lambda: jobs.watch(stream(spark, inbox, "job_id string, ts timestamp, status string"), out, check, timeout_seconds=3600)
    left = []
    for i, rows in enumerate(batches):
        put(inbox, f"{i}.json", rows)
        if i == 2:  # the driver is lost behind the result of a batch, which is then done again
            save = ingest.save_batch

            def stops(saved, path, batch):
                save(saved, path, batch)
                if batch[1] == 2:
                    raise RuntimeError("lost driver")

            monkeypatch.setattr(ingest, "save_batch", stops)
            with pytest.raises(Exception, match="lost driver"):
                go()
            monkeypatch.setattr(ingest, "save_batch", save)
        found = go()
        state = list((tmp_path / "out_open").glob(f"*/{i % 2}/jobs"))
        left.append(sorted(r["job_id"] for r in spark.read.parquet(str(state[0])).where("open").collect()))
    got = sorted((r["job_id"], r["outcome"], r["at"].strftime("%H:%M")) for r in found.collect())
    assert got == [
        ("a", "timeout", "01:00"), ("b", "failed", "00:20"), ("c", "completed", "00:05"), ("d", "timeout", "01:50"), ("e", "completed", "03:30"), ("g", "timeout", "01:45"),
    ]
    assert left == [["a", "b", "c"], ["a", "b", "c", "d"], ["e"], ["f"]]


def test_index_follows_new_chunks(spark, tmp_path, inbox):
    put(inbox, "1.json", [{"id": "1", "body": "red fox"}])
    put(inbox, "2.json", [{"id": "1", "body": "red fox"}, {"id": "2", "body": "red hen"}])
    rows = index.follow(stream(spark, inbox, "id string, body string"), str(tmp_path / "ix"), "id", "body")
    assert sorted((r["id"], r["term"]) for r in rows.collect()) == [("1", "fox"), ("1", "red"), ("2", "hen"), ("2", "red")]


def test_new_files(spark, tmp_path, inbox):
    (inbox / "a.md").write_text("one\ntwo")
    (inbox / "b.txt").write_text("no")
    rows = ingest.new_files(spark, str(inbox), "*.md", text=True)
    ingest.run(rows, lambda b, i: ingest.save_batch(b, str(tmp_path / "out"), i))
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["one\ntwo"]
    ingest.run(ingest.new_files(spark, str(inbox)), lambda b, i: ingest.save_batch(b, str(tmp_path / "l"), i))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def log_rows(spark, rows):
    made = [(datetime(2024, 1, 1, 0, m), f"Skipping {f} - already processed" if k == "s" else f"Error processing {f}: no") for m, f, k in rows]
    return spark.createDataFrame(made, "ts timestamp_ntz, message string")


def totals_of(spark, out):
    return {(r["poll"], r["status"]): (r["lines"], r["files"]) for r in ingest.result_rows(spark, f"{out}/totals").collect()}


def test_polls_move_the_cursor_and_keep_running_totals(spark, tmp_path):
    out, since = str(tmp_path / "log"), datetime(2024, 1, 1)
    rows = [(1, "a", "s"), (2, "a", "s"), (3, "b", "e")]
    assert logs.poll(log_rows(spark, rows), out, since) == 0
    assert logs.poll(log_rows(spark, rows), out, since) is None
    assert logs.last_poll(spark, out) == (0, datetime(2024, 1, 1, 0, 3))
    rows += [(4, "a", "s"), (5, "c", "s"), (6, "b", "s")]
    assert logs.poll(log_rows(spark, rows), out, since) == 1
    assert totals_of(spark, out) == {(0, "skipped"): (2, 1), (0, "error"): (1, 1), (1, "skipped"): (5, 3), (1, "error"): (1, 1)}
    seen = sorted((r["status"], r["file"], r["first_seen"].minute) for r in ingest.result_rows(spark, f"{out}/sightings").collect())
    assert seen == [("error", "b", 3), ("skipped", "a", 1), ("skipped", "b", 6), ("skipped", "c", 5)]


def test_a_stopped_poll_is_done_again(spark, tmp_path, monkeypatch):
    out, since = str(tmp_path / "log"), datetime(2024, 1, 1)
    rows = [(1, "a", "s"), (2, "b", "s")]
    logs.poll(log_rows(spark, rows), out, since)
    rows += [(3, "a", "s"), (4, "c", "s")]
    save = ingest.save_batch

    def stops(saved, path, batch):
        if path.endswith("/cursor") and batch[1] >= 0:
            raise RuntimeError("lost driver")
        save(saved, path, batch)

    monkeypatch.setattr(ingest, "save_batch", stops)
    with pytest.raises(RuntimeError):
        logs.poll(log_rows(spark, rows), out, since)
    monkeypatch.setattr(ingest, "save_batch", save)
    logs.follow(lambda: log_rows(spark, rows + [(5, "d", "s")]), out, since)
    assert totals_of(spark, out) == {(0, "skipped"): (2, 2), (1, "skipped"): (5, 4)}
    assert ingest.result_rows(spark, f"{out}/sightings").count() == 4


def test_a_poll_reads_behind_the_cursor_only(spark, tmp_path):
    path, out = str(tmp_path / "lines"), str(tmp_path / "log")
    log_rows(spark, [(m, f"f{m}", "s") for m in range(40)]).write.parquet(path)
    logs.poll(spark.read.parquet(path), out, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 9))
    assert totals_of(spark, out) == {(0, "skipped"): (10, 10)}
    asked = spark.read.parquet(path).where(F.col("ts") > F.lit("2024-01-01 00:09:00").cast("timestamp_ntz"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts,2024-01-01T00:09)]" in asked._jdf.queryExecution().executedPlan().toString()
    assert logs.poll(spark.read.parquet(path), out, datetime(2024, 1, 1)) == 1
    assert totals_of(spark, out)[(1, "skipped")] == (40, 40)
