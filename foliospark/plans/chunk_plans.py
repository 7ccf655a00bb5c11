"""Chunk tables, chunk statistics and page chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text, values
from ..operators import chunks, provenance
from ..session import fresh_path, table
from ..sources import named_files, responses
from . import derive
from .registry import query

PROCESSED_AT = "2024-01-31T00:00:00"


@query(
    "w1_rag_chunks",
    f"""WITH {derive.LINES}
    SELECT filename AS "DOCUMENT_NAME", chunk_id, pos AS chunk_sequence_number, type AS chunk_type,
      '<a id=''' || chunk_id || '''></a>' || chr(10) || chr(10) || line AS chunk_content_raw, clean AS chunk_content,
      CAST(length(clean) AS BIGINT) AS chunk_text_length, CAST(words AS BIGINT) AS chunk_word_count, page,
      CAST(0.05 AS DOUBLE) AS box_l, top AS box_t, CAST(0.95 AS DOUBLE) AS box_r, bottom AS box_b,
      lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id,
      'results/chunk_images/' || regexp_replace(filename, '[.]pdf$', '') || '/page_' || page || '/' || type || '.'
        || chunk_id || '.png' AS chunk_image_path,
      '{PROCESSED_AT}' AS processed_at, '{derive.VERSION}' AS library_version, 'lines' AS model_version
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def rag_chunks(spark, folder):
    named = derive.parsed(spark, folder).withColumn("document", F.col("metadata.filename"))
    rows = chunks.chunk_rows(named, "document", PROCESSED_AT, derive.VERSION, "lines", "results")
    for name in ("chunk_sequence_number", "chunk_text_length", "chunk_word_count", "page"):
        rows = rows.withColumn(name, F.col(name).cast("bigint"))
    return rows


@query(
    "p12_p13_chunk_text",
    f"""WITH {derive.LINES}
    SELECT chunk_id, clean AS content, CAST(length(clean) AS BIGINT) AS length, CAST(words AS BIGINT) AS words FROM lines""",
)
def chunk_text(spark, folder):
    rows = chunks.flatten_chunks(derive.parsed(spark, folder), "doc_id")
    clean = rows.select(F.col("chunk.id").alias("chunk_id"), text.clean_chunk(F.col("chunk.markdown")).alias("content"))
    return clean.select(
        "chunk_id", "content", F.length("content").cast("bigint").alias("length"),
        text.word_count(F.col("content")).cast("bigint").alias("words"),
    )


@query(
    "s9_parse_response_scan",
    f"""WITH {derive.LINES}
    SELECT filename, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS markdown_length,
      CAST(max(page) + 1 AS BIGINT) AS page_count, '{derive.VERSION}' AS version
    FROM lines GROUP BY doc_id, filename""",
)
def parse_response_scan(spark, folder):
    # One response in each file, as the service leaves them.
    rows = derive.parsed(spark, folder).select("doc_id", F.to_json(F.struct("chunks", "markdown", "metadata", "grounding")).alias("json"))
    name = F.concat(F.lit("parse_doc_"), F.col("doc_id").cast("string"), F.lit(".json"))
    folders = named_files.folders_for(table(spark, folder, "documents").count())
    path = named_files.write_named(rows, fresh_path(spark, "responses"), name, F.col("json"), folders)
    r = responses.parsed_responses(named_files.read_named(spark, path))
    return r.select(
        F.col("metadata.filename").alias("filename"), F.size("chunks").cast("bigint").alias("chunks"),
        F.length("markdown").cast("bigint").alias("markdown_length"),
        F.col("metadata.page_count").cast("bigint").alias("page_count"), F.col("metadata.version").alias("version"),
    )


@query(
    "j2_lateral_chunks",
    f"""WITH {derive.LINES}
    SELECT doc_id, pos AS chunk_index, chunk_id, type AS chunk_type, page AS page_number, top AS box_top,
      '@stage' AS stage_name, '@stage/' || filename AS full_path FROM lines""",
)
def lateral_chunks(spark, folder):
    # A VARIANT column is flattened the way a lateral flatten does, index and typed paths included.
    src = derive.parsed(spark, folder).select(
        "doc_id", F.col("metadata.filename").alias("path"), F.parse_json(F.to_json("chunks")).alias("v")
    )
    rows = src.select("doc_id", "path", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("i", "c"))
    at = lambda p, t: F.try_variant_get("c", p, t)
    return rows.select(
        "doc_id", F.col("i").cast("bigint").alias("chunk_index"), at("$.id", "string").alias("chunk_id"),
        at("$.type", "string").alias("chunk_type"), at("$.grounding.page", "bigint").alias("page_number"),
        at("$.grounding.box.top", "double").alias("box_top"), F.lit("@stage").alias("stage_name"),
        F.concat(F.lit("@stage/"), F.col("path")).alias("full_path"),
    )


@query(
    "a2_chunk_statistics",
    f"""WITH {derive.LINES}, per_type AS (SELECT doc_id, type, count(*) AS n FROM lines GROUP BY 1, 2)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_chunks, string_agg(type || '=' || n, ',' ORDER BY type) AS chunk_types,
      CAST((SELECT max(page) + 1 FROM lines l WHERE l.doc_id = per_type.doc_id) AS BIGINT) AS total_pages
    FROM per_type GROUP BY doc_id""",
)
def chunk_statistics(spark, folder):
    stats = chunks.document_statistics(derive.parsed(spark, folder), "doc_id")
    listed = F.transform(F.map_entries("chunk_types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return stats.select(
        "doc_id", F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.array_join(F.array_sort(listed), ",").alias("chunk_types"), F.col("total_pages").cast("bigint").alias("total_pages"),
    )


@query(
    "a3_parse_summary",
    f"""WITH {derive.LINES}
    SELECT 'doc_' || doc_id || '.pdf' AS "File", any_value(CASE WHEN lang = 'es' THEN 'unknown' ELSE lang END) AS "Type",
      CAST(max(page) + 1 AS BIGINT) AS "Pages", CAST(count(*) AS BIGINT) AS "Chunks",
      CAST(count(*) FILTER (type = 'table') AS BIGINT) AS "Tables",
      CAST(count(*) FILTER (type = 'figure') AS BIGINT) AS "Figures"
    FROM lines GROUP BY doc_id""",
)
def parse_summary(spark, folder):
    stats = chunks.document_statistics(derive.parsed(spark, folder, "lang"), "doc_id", "metadata", "lang")
    rows = chunks.parse_summary(stats.withColumn("name", F.col("metadata.filename")), "name", F.nullif("lang", F.lit("es")))
    return rows.select("File", "Type", *[F.col(c).cast("bigint").alias(c) for c in ("Pages", "Chunks", "Tables", "Figures")])


@query(
    "a15_type_totals",
    f"WITH {derive.LINES} SELECT type, CAST(count(*) AS BIGINT) AS chunks FROM lines GROUP BY type",
)
def type_totals(spark, folder):
    rows = chunks.flatten_chunks(derive.parsed(spark, folder))
    return rows.groupBy(F.col("chunk.type").alias("type")).agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "u1_page_chunks",
    f"WITH {derive.ELEMENTS} SELECT chunk_id, pos AS chunk_index, type, content FROM elements",
)
def page_chunks(spark, folder):
    rows = derive.page_parsed(spark, folder).select(F.posexplode("chunks").alias("i", "c"))
    return rows.select(
        F.col("c.id").alias("chunk_id"), F.col("i").cast("bigint").alias("chunk_index"), "c.type",
        F.col("c.markdown").alias("content"),
    )


@query(
    "f4_typed_page_chunks",
    f"WITH {derive.ELEMENTS} SELECT page_id, chunk_id, content FROM elements WHERE type = 'title'",
)
def typed_page_chunks(spark, folder):
    kept = derive.page_parsed(spark, folder).select(
        "page_id", F.explode(F.filter("chunks", lambda c: c["type"] == "title")).alias("c")
    )
    return kept.select("page_id", F.col("c.id").alias("chunk_id"), F.col("c.markdown").alias("content"))


@query(
    "p39_canonical_chunks",
    f"""WITH {derive.LINES} SELECT chunk_id AS id, type, line AS markdown, page, CAST(0.05 AS DOUBLE) AS box_left,
      top AS box_top FROM lines""",
)
def canonical_chunks(spark, folder):
    # English documents arrive in the older shape, the others in the newer; both end on one struct.
    p = derive.parsed(spark, folder, "lang")
    plain = F.transform(
        "chunks",
        lambda c: F.struct(
            c["id"].alias("id"), c["type"].alias("type"),
            F.regexp_replace(c["markdown"], r"^<a id='[^']*'></a>\n\n", "").alias("markdown"), c["grounding"].alias("grounding"),
        ),
    )
    old = F.transform(
        plain,
        lambda c: F.struct(
            c["markdown"].alias("text"), c["type"].alias("chunk_type"), c["id"].alias("chunk_id"),
            F.array(
                F.struct(
                    c["grounding"]["page"].alias("page"),
                    F.struct(
                        c["grounding"]["box"]["left"].alias("l"), c["grounding"]["box"]["top"].alias("t"),
                        c["grounding"]["box"]["right"].alias("r"), c["grounding"]["box"]["bottom"].alias("b"),
                    ).alias("box"),
                )
            ).alias("grounding"),
        ),
    )
    is_old = F.col("lang") == "en"
    both = p.select(F.when(~is_old, plain).alias("new"), F.when(is_old, old).alias("old"))
    rows = both.select(F.explode(chunks.canonical_chunks(F.col("new"), F.col("old"))).alias("c"))
    return rows.select(
        "c.id", "c.type", "c.markdown", F.col("c.grounding.page").cast("bigint").alias("page"),
        F.col("c.grounding.box.left").alias("box_left"), F.col("c.grounding.box.top").alias("box_top"),
    )


@query(
    "p40_page_split",
    """WITH m AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
    SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS page, unnest(p) AS markdown FROM m""",
)
def page_split(spark, folder):
    # Markdown with a page-break line between its pages, cut back into pages.
    marked = table(spark, folder, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit(f"\n{text.PAGE_BREAK}\n")).alias("markdown")
    )
    rows = marked.select("doc_id", F.posexplode(text.markdown_pages(F.col("markdown"))).alias("page", "markdown"))
    return rows.select("doc_id", F.col("page").cast("bigint").alias("page"), "markdown")


@query(
    "p18_chunk_image_path",
    f"""WITH {derive.LINES}
    SELECT chunk_id, CASE WHEN type <> 'marginalia' THEN 'out/chunk_images/' || regexp_replace(filename, '[.]pdf$', '')
      || '/page_' || page || '/' || type || '.' || chunk_id || '.png' END AS image FROM lines""",
)
def chunk_image_path(spark, folder):
    rows = chunks.flatten_chunks(derive.parsed(spark, folder), "metadata")
    kind = F.nullif(F.col("chunk.type"), F.lit("marginalia"))
    path = paths.chunk_image_path("out", F.col("metadata.filename"), F.col("chunk.grounding.page"), kind, F.col("chunk.id"))
    return rows.select(F.col("chunk.id").alias("chunk_id"), path.alias("image"))


@query(
    "p27_chunk_colours",
    f"""WITH {derive.LINES}
    SELECT chunk_id, CASE type WHEN 'text' THEN 'chunkText' WHEN 'table' THEN 'chunkTable' WHEN 'marginalia' THEN 'chunkMarginalia'
        WHEN 'figure' THEN 'chunkFigure' WHEN 'attestation' THEN 'other' ELSE 'chunkScanCode' END || ':' || chunk_id AS label,
      CAST(CASE type WHEN 'text' THEN 40 WHEN 'table' THEN 0 WHEN 'marginalia' THEN 111 WHEN 'figure' THEN 255
        WHEN 'attestation' THEN 128 ELSE 255 END AS BIGINT) AS red,
      CAST(CASE type WHEN 'text' THEN 167 WHEN 'table' THEN 123 WHEN 'marginalia' THEN 66 WHEN 'figure' THEN 0
        WHEN 'attestation' THEN 128 ELSE 193 END AS BIGINT) AS green
    FROM lines""",
)
def chunk_colours(spark, folder):
    grounds = provenance.grounding_rows(derive.parsed(spark, folder), "doc_id")
    renamed = grounds.withColumn("type", F.when(F.col("type") == "chunkAttestation", "other").otherwise(F.col("type")))
    rows = provenance.with_colours(renamed, provenance.colour_rows(spark))
    return rows.select(
        F.col("ground_id").alias("chunk_id"), "label", F.col("red").cast("bigint").alias("red"), F.col("green").cast("bigint").alias("green")
    )


@query(
    "p28_previews",
    """SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS shown,
      left(text, 500) || '...' AS hit, left(text, 80) AS head FROM documents""",
)
def previews(spark, folder):
    body = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", text.preview(body, 150).alias("shown"), text.preview(body, 500, "always").alias("hit"),
        text.preview(body, 80, "never").alias("head"),
    )


@query(
    "p38_stamped_keys",
    f"""SELECT 'run-1' AS run_id, sha256(source || '/doc_' || doc_id || '.pdf') AS document_key,
      source || '/doc_' || doc_id || '.pdf' AS document_name, '{derive.VERSION}' AS version FROM documents""",
)
def stamped_keys(spark, folder):
    from ..operators.invoices import stamp_keys

    rows = stamp_keys(table(spark, folder, "documents").select("source", "doc_id"), "run-1", derive.filename(), F.lit(derive.VERSION))
    return rows.select(
        F.col("RUN_ID").alias("run_id"), F.col("INVOICE_UUID").alias("document_key"), F.col("DOCUMENT_NAME").alias("document_name"),
        F.col("PARSER_VERSION").alias("version"),
    )


@query(
    "a16_usage",
    f"""WITH {derive.LINES}, per_doc AS (SELECT doc_id, source, max(page) + 1 AS pages FROM lines GROUP BY 1, 2)
    SELECT p.source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(pages) AS BIGINT) AS pages,
      CAST(sum(length(text) * 10) / 1000.0 AS DOUBLE) AS seconds, CAST(sum(pages * 3) AS DOUBLE) AS credits
    FROM per_doc p JOIN documents d ON p.doc_id = d.doc_id GROUP BY p.source""",
)
def usage(spark, folder):
    from ..operators import summaries

    named = derive.parsed(spark, folder).withColumn("source", F.substring_index(F.col("metadata.filename"), "/", 1))
    return summaries.usage(named, "source").select(
        "source", "documents", "pages", F.col("seconds"), F.col("credits").cast("double").alias("credits")
    )


@query(
    "p17_stage_columns",
    f"WITH {derive.LISTING} SELECT '@docs' AS stage, '@docs/' || path AS full_path, '@\"docs\"/' || path AS quoted FROM listing",
)
def stage_columns(spark, folder):
    path = F.col("path")
    return derive.listing(spark, folder).select(
        F.lit("@docs").alias("stage"), F.concat(F.lit("@docs/"), path).alias("full_path"), F.concat(F.lit('@"docs"/'), path).alias("quoted")
    )


@query(
    "p22_name_chain",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '[^/]*$'), ''), CASE WHEN url LIKE '%/' THEN '' END,
      'doc_' || (page_id + 1)) AS name FROM (SELECT page_id,
        CASE WHEN length(html) > 4000 THEN url WHEN length(html) > 2000 THEN 'set/' || page_id || '.pdf' END AS url FROM pages)""",
)
def name_chain(spark, folder):
    size = F.length("html")
    first = F.when(size > 4000, F.col("url"))
    second = F.when(size > 2000, F.concat(F.lit("set/"), F.col("page_id").cast("string"), F.lit(".pdf")))
    return table(spark, folder, "pages").select("page_id", values.document_name([first, second], F.col("page_id")).alias("name"))
