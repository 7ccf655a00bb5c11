"""Chunk search: index, ranked text search, hybrid and structured-first retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, search, topk
from ..operators.arrays import unnest_fields
from ..operators.joins import sized_join
from ..operators.vectors import VectorTable
from ..session import durable, fresh_path, table
from . import derive
from .registry import query

# Words of a search text as used in these queries.
ONE_TEXT = "the intended use of nation and thesh licensed"


def chunk_table(spark, folder):
    rows = chunks.flatten_chunks(derive.parsed(spark, folder), "doc_id")
    return rows.select(
        "doc_id", F.col("chunk.id").alias("chunk_id"), F.col("chunk.type").alias("chunk_type"),
        text.clean_chunk(F.col("chunk.markdown")).alias("content"),
    )


@dataclass(frozen=True)
class SearchTables:
    """Written tables of one corpus: chunks, their counted words, and the words with their bounds."""

    chunks: DataFrame
    corpus: topk.Corpus

    @property
    def index(self) -> DataFrame:
        """Postings, by chunk."""
        return unnest_fields(self.corpus.counted, ["chunk_id", "doc_id", "chunk_type", "length"], F.col("terms"), "term")

    def best_of_one(self, spark, text: str, limit: int) -> DataFrame:
        """Best chunks of one search text: each is scored in its own row, and only the best of each task are moved."""
        asked = search.one_query(spark, text)
        scores = self.corpus.scored_by(asked, "query_id", "text")
        if scores is None:
            return self.corpus.best_chunks(asked, "query_id", "text", limit).best.drop("query_id")
        return durable(search.best_rows(scores.select("chunk_id", "score"), "chunk_id", limit))

    def scored(self, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
        """Scores of all chunks in ``index``, a part of this one or all of it, that share a word with a question."""
        part, corpus = self.index if index is None else index, self.corpus
        return search.search(part, corpus.size, corpus.mean_length, queries, "query_id", "text", "chunk_id", corpus.bounds.select("term", "df"))


_BUILT: dict[tuple, SearchTables] = {}


def _state(rows: DataFrame) -> tuple:
    """What changes when a table's files do: their number and a digest of names, sizes and times."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first())


def search_tables(spark, folder) -> SearchTables:
    """Search tables of a folder, built by the first question of an application and used again until its files change."""
    built = (spark.sparkContext.applicationId, folder, *_state(table(spark, folder, "documents")))
    if built not in _BUILT:
        path = fresh_path(spark, "search")
        rows = chunk_table(spark, folder)
        counted = topk.counted_chunks(rows, "chunk_id", "content", "doc_id", "chunk_type", "content")
        counted.write.parquet(f"{path}/chunks")
        counted = spark.read.parquet(f"{path}/chunks")
        size, mean_length = topk.corpus_of(counted)
        topk.term_bounds(counted, mean_length).write.parquet(f"{path}/terms")
        corpus = topk.Corpus(counted, spark.read.parquet(f"{path}/terms"), size, mean_length, "chunk_id")
        _BUILT[built] = SearchTables(counted.select("doc_id", "chunk_id", "chunk_type", "content"), corpus)
    return _BUILT[built]


TOKENS = f"""{derive.LINES},
tokens AS (SELECT doc_id, type, chunk_id, unnest(regexp_extract_all(lower(clean), '[\\p{{L}}\\p{{N}}]+')) AS term FROM lines),
lengths AS (SELECT l.chunk_id, l.doc_id, l.type, len(regexp_extract_all(lower(clean), '[\\p{{L}}\\p{{N}}]+')) AS length FROM lines l),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths WHERE length > 0)"""

SCORES = """
scores AS (
  SELECT q.query_id, t.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2)
      / (tf + 1.2 * ((1.0 - 0.75)::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM query_terms q JOIN tf t ON q.term = t.term JOIN df d ON d.term = t.term JOIN lengths l ON l.chunk_id = t.chunk_id CROSS JOIN corpus
  GROUP BY 1, 2)"""

ONE_TERMS = f"query_terms AS (SELECT DISTINCT 0 AS query_id, unnest(string_split('{ONE_TEXT}', ' ')) AS term)"
BATCH_TERMS = """query_terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark)"""


@query(
    "r1_index_terms",
    f"WITH {TOKENS} SELECT term, CAST(df AS BIGINT) AS chunks, CAST(occurrences AS BIGINT) AS occurrences FROM df JOIN (SELECT term, sum(tf) AS occurrences FROM tf GROUP BY 1) USING (term)",
)
def index_terms(spark, folder):
    rows = search.postings(chunk_table(spark, folder), "chunk_id", "content")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"))


@query(
    "r2_text_search",
    f"""WITH {TOKENS}, {ONE_TERMS}, {SCORES}
    SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS BIGINT) AS rank, doc_id, type AS chunk_type, clean AS content
    FROM scores JOIN lines USING (chunk_id) ORDER BY rank LIMIT 10""",
)
def text_search(spark, folder):
    tables = search_tables(spark, folder)
    best = tables.best_of_one(spark, ONE_TEXT, 10)
    top = best.select("chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))
    return search.with_attributes(top, tables.chunks, "chunk_id", "doc_id", "chunk_type", "content")


@query(
    "r5_batch_search",
    f"""WITH {TOKENS}, {BATCH_TERMS}, {SCORES}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores)
    SELECT query_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5""",
)
def batch_search(spark, folder):
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = search_tables(spark, folder).corpus.best_chunks(queries, "query_id", "text", 5).best
    return best.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "r3_hybrid_search",
    f"""WITH {TOKENS}, {ONE_TERMS}, {SCORES},
    by_doc AS (SELECT doc_id, max(score) AS score FROM scores JOIN lengths USING (chunk_id) GROUP BY 1),
    words AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM by_doc ORDER BY rank LIMIT 50),
    seed AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
    near AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings CROSS JOIN seed),
    vectors AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM near ORDER BY rank LIMIT 50),
    fused AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM words UNION ALL SELECT * FROM vectors) GROUP BY 1)
    SELECT 'doc_' || doc_id || '.pdf' AS source, round(score, 2) AS relevance, left(text, 500) || '...' AS content,
      CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM fused JOIN documents USING (doc_id) ORDER BY rank LIMIT 5""",
)
def hybrid_search(spark, folder):
    scores = search_tables(spark, folder).scored(search.one_query(spark, ONE_TEXT))
    owner = F.substring_index("chunk_id", "-", 1).cast("bigint")
    by_doc = scores.groupBy(owner.alias("doc_id")).agg(F.max("score").alias("score"))
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    seed = vectors.orderBy("doc_id").select("embedding").first()[0]
    near = search.cosine_scores(vectors, "doc_id", "embedding", seed)
    top = search.hybrid(by_doc, near, "doc_id", 5, depth=50)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # ``top`` has five rows.
    return docs.join(F.broadcast(top), "doc_id").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"),
        F.round("score", 2).alias("relevance"), text.preview(F.col("text"), 500, "always").alias("content"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "r4_structured_first",
    f"""WITH {TOKENS}, {ONE_TERMS}, {SCORES}, hits AS (
      SELECT chunk_id, type, score, CASE WHEN type IN ('table', 'figure') THEN 1 ELSE 0 END AS boost FROM scores JOIN lengths USING (chunk_id)
      WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
    SELECT chunk_id, type AS chunk_type, score, CAST(row_number() OVER (ORDER BY boost DESC, score DESC, chunk_id) AS BIGINT) AS rank
    FROM hits ORDER BY rank LIMIT 10""",
)
def structured_first(spark, folder):
    # The entity rows come first; only their chunks are ranked, tables and figures ahead of text.
    tables = search_tables(spark, folder)
    chosen = table(spark, folder, "labels").where("quality = 0").select("doc_id").distinct()
    asked = search.one_query(spark, ONE_TEXT)
    scores = tables.corpus.scored_by(asked, "query_id", "text")
    if scores is None:
        scores = tables.scored(asked).join(tables.chunks.select("chunk_id", "doc_id", "chunk_type"), "chunk_id")
    # What is moved is a chunk's key, type and score, not its words.
    scores = sized_join(scores.select("chunk_id", "doc_id", "chunk_type", "score"), chosen, ["doc_id"], "left_semi", spread_by=["chunk_id"])
    hits = search.boosted(scores.select("chunk_id", "chunk_type", "score"), "chunk_type")
    order = [F.desc("boost"), F.desc("score"), F.col("chunk_id")]
    top = hits.orderBy(*order).limit(10)
    ranked = top.withColumn("k", F.struct((-F.col("boost")).alias("b"), (-F.col("score")).alias("s"), "chunk_id", "chunk_type"))
    rows = ranked.agg(F.array_sort(F.collect_list("k")).alias("a")).select(F.posexplode("a").alias("i", "e"))
    return rows.select(
        F.col("e.chunk_id").alias("chunk_id"), F.col("e.chunk_type").alias("chunk_type"), (-F.col("e.s")).alias("score"),
        (F.col("i") + 1).cast("bigint").alias("rank"),
    )


@query(
    "w5_best_per_chunk",
    f"""WITH {derive.LINES} SELECT chunk_id, max(score) AS score FROM (
      SELECT chunk_id, CAST(words AS DOUBLE) AS score FROM lines UNION ALL SELECT chunk_id, CAST(length(line) AS DOUBLE) / 10 FROM lines) GROUP BY 1""",
)
def best_per_chunk(spark, folder):
    # Two rankings of the same chunks; each chunk keeps its better row.
    rows = chunks.flatten_chunks(derive.parsed(spark, folder), "doc_id").select(
        F.col("chunk.id").alias("chunk_id"), F.regexp_replace("chunk.markdown", r"^<a id='[^']*'></a>\n\n", "").alias("line")
    )
    both = F.array(text.word_count(F.col("line")).cast("double"), F.length("line").cast("double") / 10)
    return search.best_per_chunk(rows.select("chunk_id", F.explode(both).alias("score")), "chunk_id")


@query(
    "r3_rendered_answer",
    f"""WITH {TOKENS}, {ONE_TERMS}, {SCORES}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM scores ORDER BY rank LIMIT 5)
    SELECT string_agg('**Source:** ' || filename || ' (Relevance: ' || format('{{:.2f}}', score) || ')' || chr(10) || left(clean, 500) || '...',
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS answer FROM top JOIN lines USING (chunk_id)""",
)
def rendered_answer(spark, folder):
    tables = search_tables(spark, folder)
    best = tables.best_of_one(spark, ONE_TEXT, 5)
    hits = search.with_attributes(best, tables.chunks, "chunk_id", "doc_id", "content")
    files = table(spark, folder, "documents").select("doc_id", derive.filename().alias("source"))
    return search.rendered(search.with_attributes(hits, files, "doc_id", "source"), ONE_TEXT)


@query(
    "r3_vector_neighbours",
    """WITH seed AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings CROSS JOIN seed""",
)
def vector_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    seed = vectors.orderBy("vec_id").select("embedding").first()[0]
    return search.cosine_scores(vectors, "vec_id", "embedding", seed)


@query(
    "r3_inverted_neighbours",
    """WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    scores AS (SELECT q.vec_id AS question, e.vec_id AS id, round(list_cosine_similarity(e.v, q.v), 6) AS score
      FROM vectors q CROSS JOIN vectors e WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS BIGINT) AS rank FROM scores)
    SELECT question, rank, id, score FROM ranked WHERE rank <= 10""",
)
def inverted_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    stored = VectorTable.write(vectors, "vec_id", "embedding", fresh_path(spark, "vectors"), size=64)
    best = stored.nearest(vectors.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding", 10).best
    return best.select("question", F.col("rank").cast("bigint").alias("rank"), "id", "score")
