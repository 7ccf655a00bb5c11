"""Files of given names: listings show exactly these, and a task that runs again leaves no second file."""

import csv
import io
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.sources import named_files, sinks


def listed(path):
    return {f: open(os.path.join(path, f), newline="").read() for f in os.listdir(path)}


def test_names_and_contents(spark, tmp_path):
    rows = spark.createDataFrame([("a b.md", "x\ny"), ("c.json", None), ("é.txt", "é" * 100_000)], "n string, t string").repartition(3)
    path = named_files.write_named(rows, str(tmp_path / "out"), F.col("n"), F.col("t"))
    assert listed(path) == {"a b.md": "x\ny", "c.json": "", "é.txt": "é" * 100_000}
    named_files.write_named(rows.where("n = 'a b.md'").withColumn("t", F.lit("new")), f"file://{path}", F.col("n"), F.col("t"))
    assert listed(path) == {"a b.md": "new", "c.json": "", "é.txt": "é" * 100_000}
    named_files.write_named(rows.limit(0), path, F.col("n"), F.col("t"))
    assert len(listed(path)) == 3


@pytest.mark.parametrize("names", [["a", "a"], [None], [""], ["a/b"], ["_a"], [".a"]])
def test_refused_names_write_nothing(spark, tmp_path, names):
    rows = spark.createDataFrame([(n,) for n in names] + [("fine",)], "n string")
    with pytest.raises(ValueError, match="no name for one file"):
        named_files.write_named(rows, str(tmp_path / "out"), F.col("n"), F.lit("x"))
    assert not (tmp_path / "out").exists()


def test_a_task_that_repeats_or_fails(tmp_path):
    writer = named_files.NamedFilesWriter(str(tmp_path))
    batch = lambda names: pa.RecordBatch.from_pydict({"name": names, "content": [f"text of {n}" for n in names]})

    def lost():
        yield batch(["a"])
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(lost())
    (tmp_path / f"{named_files.UNFINISHED}of-a-lost-executor").write_text("te")
    first, again = writer.write(iter([batch(["a", "b"])])), writer.write(iter([batch(["a", "b"])]))
    writer.commit([first, again])
    assert listed(tmp_path) == {"a": "text of a", "b": "text of b"} and (first.files, first.size) == (2, 18)


def test_spark_runs_a_failed_task_again(spark, tmp_path):
    with pytest.raises(Exception):
        bad = spark.range(8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("n"), "id")
        named_files.write_named(bad, str(tmp_path), F.col("n"), F.when(F.col("id") == 5, F.raise_error(F.lit("odd"))).otherwise(F.lit("x")))
    assert not any(f.startswith(named_files.UNFINISHED) for f in os.listdir(tmp_path))
    good = spark.range(8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("n"))
    named_files.write_named(good, str(tmp_path), F.col("n"), F.lit("x"))
    assert listed(tmp_path) == {f"f{i}": "x" for i in range(8)}


def test_csv_text(spark):
    values = ["plain", 'say "x", y', "two\nlines", " edge ", "", None, "a,b"]
    rows = spark.createDataFrame([(1, values), (2, []), (3, None)], "id int, v array<string>")
    made = {r["id"]: r["t"] for r in rows.select("id", sinks.csv_text(F.col("v"), lambda v: {"value": v, "size": F.length(v)}).alias("t")).collect()}
    back = list(csv.reader(io.StringIO(made[1], newline="")))
    assert back == [["value", "size"]] + [[v or "", "" if v is None else str(len(v))] for v in values]
    assert made[2] == made[3] == "value,size\n"


def test_files_in_sub_folders_are_read_by_their_own_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".md")).alias("n"), F.when(F.col("id") > 0, F.repeat(F.lit("é\n"), 3)).alias("t"))
    path = named_files.write_named(rows, str(tmp_path / "out"), F.col("n"), F.col("t"), folders=7)
    (tmp_path / "out" / "other.txt").write_text("own")
    (tmp_path / "out" / "_hidden.md").write_text("no")
    read = named_files.read_named(spark, path, "*.md")
    assert {r["name"]: r["content"] for r in read.collect()} == {f"f{i}.md": "é\n" * 3 if i else "" for i in range(300)}
    # One task for the folder and each sub-folder, however many files there are.
    assert read.rdd.getNumPartitions() == 8
    assert [r["content"] for r in named_files.read_named(spark, path, "*.txt").collect()] == ["own"]
    assert named_files.folders_for(2_000) == 0 and named_files.folders_for(3_000_000) == 1_500


def test_responses_are_not_one_folder_each(spark, folder, tmp_path, monkeypatch):
    from foliospark.plans import chunk_plans

    monkeypatch.setattr(chunk_plans, "fresh_path", lambda spark, label: str(tmp_path / label))
    assert chunk_plans.parse_response_scan(spark, folder).count() == len(listed(tmp_path / "responses")) > 100


def test_csv_texts_are_read_record_by_record(spark):
    values = ["plain", 'say "x", y', "two\nlines", " edge ", "", None, "a,b", '"', "back\\slash", "end\r", "x" * 50_000]
    rows = spark.createDataFrame([(1, values), (2, []), (3, None)], "id int, v array<string>")
    texts = rows.select("id", sinks.csv_text(F.col("v"), lambda v: {"value": v, "size": F.length(v)}).alias("t"))
    back = {r["id"]: r["r"] for r in texts.select("id", sinks.csv_records(F.col("t"), "value string, size int").alias("r")).collect()}
    assert [(r["value"], r["size"]) for r in back[1]] == [(v or None, None if v is None else len(v)) for v in values]
    assert back[2] == back[3] == []


@pytest.mark.parametrize("name, label", [
    ("json_results", "json-results"), ("markdown_files", "markdown"), ("markdown_scan", "markdown"), ("chunk_csv_separate", "chunk-csv"),
])
def test_named_results_are_read_by_folder(spark, folder, tmp_path, monkeypatch, name, label):
    from foliospark.plans import sink_plans

    monkeypatch.setattr(sink_plans, "fresh_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(named_files, "FILES_PER_FOLDER", 50)
    rows = getattr(sink_plans, name)(spark, folder)
    assert "BatchScan named_files" in rows._jdf.queryExecution().executedPlan().toString()
    parts = [f for f in os.listdir(tmp_path / label) if f.startswith("part-")]
    assert len(parts) == named_files.folders_for(spark.read.parquet(f"{folder}/documents.parquet").count()) > 1 and rows.count() > 100
