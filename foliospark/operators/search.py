"""Chunk search: postings, BM25 as joins, vector and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import unnest_fields
from .joins import sized_join, spread_join
from .ordered import first_rows

K1, B = 1.2, 0.75
FUSION = 60


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sorted_tokens(text: Column) -> Column:
    """Words in order, by the built-in order of strings: a comparator would be called for each comparison."""
    return F.sort_array(tokens(text))


def term_counts(words: Column) -> Column:
    """Array of ``{term, tf}`` from sorted words, by run lengths: no shuffle is needed.

    The starts of the runs are bound to a variable of an outer array of one element, so that they are found once a row.
    """
    none = F.array().cast("array<struct<term string, tf int>>")
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def runs(found: Column) -> Column:
        return F.transform(found, lambda s, n: F.struct(F.get(words, s).alias("term"), (F.coalesce(F.get(found, n + 1), F.size(words)) - s).alias("tf")))

    return F.when(F.size(words) == 0, none).otherwise(F.get(F.transform(F.array(starts), runs), F.lit(0)))


def postings(chunks: DataFrame, chunk_id: str, text: str, *attributes: str) -> DataFrame:
    """Index rows ``(chunk, attributes, length, term, tf)``, kept in chunk order: a frequent term gathers nowhere."""
    words = chunks.select(chunk_id, *attributes, sorted_tokens(F.col(text)).alias("w"))
    counted = words.select(chunk_id, *attributes, F.size("w").alias("length"), term_counts(F.col("w")).alias("terms"))
    return unnest_fields(counted, [chunk_id, *attributes, "length"], F.col("terms"), "term")


def corpus_size(index: DataFrame, chunk_id: str) -> tuple[int, float]:
    """Number of chunks with words and mean chunk length: two numbers."""
    total = F.sum("tf").alias("t")
    row = index.groupBy(chunk_id).agg(total).agg(F.count(F.lit(1)), F.sum("t")).first()
    return row[0], (row[1] or 0) / max(row[0], 1)


def term_frequencies(index: DataFrame) -> DataFrame:
    """Chunks per term, counted per task before the shuffle."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def one_query(spark, text: str, query_id: int = 0) -> DataFrame:
    """A single search text as a query table."""
    return spark.range(1).select(F.lit(query_id).cast("bigint").alias("query_id"), F.lit(text).alias("text"))


def bm25(
    index: DataFrame, terms: DataFrame, size: int, mean_length: float, query_id: str, chunk_id: str, most_terms: int = 200_000,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Score of every chunk that shares a term with a query.

    Only postings of the queries' words are kept (a counted word list is broadcast). They are then spread by
    chunk, never by term: a chunk meets its queries and is summed in one task, and a frequent word is no hot spot.
    ``frequencies`` (term, df) are those of the whole corpus where ``index`` is a part of it; else they are counted.
    """
    # One count over the queries bounds both the word list and the weights, which have a row per query and word.
    small = terms.limit(most_terms + 1).count() <= most_terms
    words = terms.select("term").distinct()
    wanted = index.join(F.broadcast(words) if small else words, "term", "left_semi")
    weight = F.log(1 + (F.lit(float(size)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(term_frequencies(wanted) if frequencies is None else frequencies, "term").select("term", query_id, weight.alias("idf"))
    spread = wanted.select("term", "tf", "length", chunk_id).repartition(chunk_id)
    hits = spread.join(F.broadcast(weighted), "term") if small else spread_join(spread, weighted, ["term"], spread_by=[chunk_id])
    length_norm = F.lit(1.0 - B) + F.lit(B) * F.col("length") / F.lit(float(mean_length))
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + F.lit(K1) * length_norm)
    summed = hits.groupBy(query_id, chunk_id).agg(F.sum(part).alias("raw"))
    return summed.select(query_id, chunk_id, F.round("raw", 6).alias("score"))


def search(
    index: DataFrame, size: int, mean_length: float, queries: DataFrame, query_id: str, text: str, chunk_id: str,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    return bm25(index, query_terms(queries, query_id, text), size, mean_length, query_id, chunk_id, frequencies=frequencies)


def top_chunks(scores: DataFrame, query_id: str, chunk_id: str, limit: int) -> DataFrame:
    """Best ``limit`` chunks per query; equal scores are ordered by chunk id."""
    return first_rows(scores, [query_id], [F.desc("score"), F.col(chunk_id)], limit)


def best_per_chunk(hits: DataFrame, chunk_id: str) -> DataFrame:
    """One row per chunk id, the one of the highest score, as a partial aggregate."""
    rest = [c for c in hits.columns if c != chunk_id]
    return hits.groupBy(chunk_id).agg(F.max_by(F.struct(*rest), F.struct("score", *[c for c in rest if c != "score"])).alias("b")).select(
        chunk_id, "b.*"
    )


def boosted(hits: DataFrame, kind: str, preferred=("table", "figure")) -> DataFrame:
    """Mark tables and figures so that they sort first for numeric questions."""
    return hits.withColumn("boost", F.when(F.col(kind).isin(*preferred), 1).otherwise(0))


def cosine_scores(vectors: DataFrame, vec_id: str, vector: str, query: list[float]) -> DataFrame:
    """Cosine of every vector with one query vector; the query is a constant in the plan. A zero vector has no cosine (null)."""
    other = F.array(*[F.lit(float(x)) for x in query])
    own = F.transform(vector, lambda x: x.cast("double"))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = sum(float(x) * float(x) for x in query) ** 0.5
    similarity = F.try_divide(product(own, other), F.sqrt(product(own, own)) * F.lit(length))
    return vectors.select(vec_id, F.round(similarity, 6).alias("score"))


def best_rows(scores: DataFrame, key: str, limit: int) -> DataFrame:
    """Top ``limit`` of one ranking with its rank; rows without a score are not ranked."""
    top = scores.where(F.col("score").isNotNull()).orderBy(F.desc("score"), F.col(key)).limit(limit)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))).alias("a"))
    rows = ranked.select(F.posexplode("a").alias("i", "e"))
    return rows.select(F.col("e.k").alias(key), (-F.col("e.s")).alias("score"), (F.col("i") + 1).alias("rank"))


def fuse(left: DataFrame, right: DataFrame, key: str, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two short rankings."""
    both = left.select(key, "rank").unionByName(right.select(key, "rank"))
    fused = both.groupBy(key).agg(F.round(F.sum(1.0 / (F.lit(FUSION) + F.col("rank"))), 6).alias("score"))
    return best_rows(fused, key, limit)


def hybrid(words: DataFrame, vectors: DataFrame, key: str, limit: int, depth: int = 50) -> DataFrame:
    """Fusion of two scored rankings, each of which counts down to rank ``depth``."""
    return fuse(best_rows(words, key, depth), best_rows(vectors, key, depth), key, limit)


def with_attributes(top: DataFrame, chunks: DataFrame, chunk_id: str, *columns: str) -> DataFrame:
    """Add projected columns to ranked chunks; the chunk table is scanned in place when the ranking is short."""
    return sized_join(chunks.select(chunk_id, *columns), top, [chunk_id], spread_by=list(columns))


def rendered(hits: DataFrame, query: str, source: str = "source", score: str = "score", content: str = "content") -> DataFrame:
    """One text with all hits of a short ranking (``rank`` gives their order), or the no-result message."""
    line = F.concat(
        F.lit("**Source:** "), F.coalesce(source, F.lit("Unknown source")), F.lit(" (Relevance: "),
        F.format_number(score, 2), F.lit(")\n"), F.left(F.col(content), F.lit(500)), F.lit("..."),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda e: e["line"])
    none = F.lit(f"No documents found for query: '{query}'. The knowledge base may be empty or still processing.")
    return hits.agg(F.when(F.count(F.lit(1)) > 0, F.array_join(lines, "\n\n---\n\n")).otherwise(none).alias("answer"))
