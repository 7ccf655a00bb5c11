"""Search index that follows new chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import search
from ..operators.joins import not_yet_done, seen_before
from . import ingest


def follow(chunks: DataFrame, out: str, chunk_id: str, text: str, *attributes: str, checkpoint: str | None = None) -> DataFrame:
    """Index each new chunk once. The index is kept by chunk, so earlier rows are never rewritten; a batch reads
    the keys of its own buckets, not the postings."""
    spark = chunks.sparkSession
    ingest.open_table(spark, out, search.postings(chunks, chunk_id, text, *attributes).schema)

    table = ingest.key_table(out, [chunk_id])

    def each_batch(batch: DataFrame, at: ingest.Batch) -> None:
        items = batch.dropDuplicates([chunk_id]).persist()
        seen = seen_before(table.done(items, at), items, [chunk_id])
        fresh = not_yet_done(items, seen, [chunk_id], unique=True)
        ingest.save_batch(search.postings(fresh, chunk_id, text, *attributes), out, at)
        table.add(items, at)
        items.unpersist()

    ingest.run(chunks, each_batch, checkpoint)
    return ingest.result_rows(spark, out)
