"""Tables of keys that are done, read by the buckets that a batch touches.

A key lies in the folder of its hash bucket, in a part named after the run and batch that added it. A batch lists and reads
the folders of its own buckets only; a bucket with more than ``MOST_PARTS`` parts is first written anew as one. What a
batch reads therefore depends on its keys and the size of their buckets, not on how many batches came before. A repeated
batch replaces its own parts and does not see them; parts go only after the one that holds their keys is there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, PART = "bucket", "part"
BUCKETS, MOST_PARTS = 64, 8
Batch = tuple[str, int]


@dataclass(frozen=True)
class KeyTable:
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    most_parts: int = MOST_PARTS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def parts(self, spark: SparkSession, buckets: list[int]) -> dict[int, list[str]]:
        """Names of the parts of some buckets."""
        root, files = self._folder(spark)
        found: dict[int, list[str]] = {}
        for bucket in buckets:
            folder = spark._jvm.org.apache.hadoop.fs.Path(root, f"{BUCKET}={bucket}")
            if files.exists(folder):
                found[bucket] = sorted(s.getPath().getName().removeprefix(f"{PART}=") for s in files.listStatus(folder) if s.isDirectory())
        return found

    def _remove(self, spark: SparkSession, bucket: int, part: str) -> None:
        root, files = self._folder(spark)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{BUCKET}={bucket}/{PART}={part}"), True)

    def _read(self, spark: SparkSession, parts: dict[int, list[str]], schema) -> DataFrame:
        folders = [f"{self.path}/{BUCKET}={b}/{PART}={p}" for b, names in parts.items() for p in names]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*folders)

    def _write(self, rows: DataFrame, part: str) -> None:
        told = rows.select(*self.keys).distinct().withColumns({BUCKET: self.bucket(), PART: F.lit(part)})
        told.repartition(BUCKET).write.mode("append").partitionBy(BUCKET, PART).parquet(self.path)

    @staticmethod
    def _name(batch: Batch) -> str:
        return re.sub(r"[^A-Za-z0-9_-]", "_", f"{batch[0]}_{batch[1]}")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def done(self, rows: DataFrame, batch: Batch) -> DataFrame:
        """Keys that earlier batches and other runs have added to the buckets of ``rows``."""
        spark, schema = rows.sparkSession, rows.select(*self.keys).schema
        own = self._name(batch)
        found = {b: [p for p in names if p != own] for b, names in self.parts(spark, self.touched(rows)).items()}
        crowded = {b: names for b, names in found.items() if len(names) > self.most_parts}
        if crowded:
            whole = f"of_{own}"
            self._write(self._read(spark, crowded, schema), whole)
            for bucket, names in crowded.items():
                for part in set(names) - {whole}:
                    self._remove(spark, bucket, part)
                found[bucket] = [whole]
        return self._read(spark, found, schema)

    def add(self, rows: DataFrame, batch: Batch) -> None:
        """Adds the keys of a batch's rows."""
        spark, own = rows.sparkSession, self._name(batch)
        for bucket, names in self.parts(spark, self.touched(rows)).items():
            if own in names:
                self._remove(spark, bucket, own)
        self._write(rows, own)
