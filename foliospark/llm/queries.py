"""The registered queries of this subpackage, with the equal SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import table

from . import bpe, chat, collocations, infill, language, neighbours, packing, pii, quality, sentencepieces, simhash, toxicity, url_filter
from .common import fold_of

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_SQL[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query(
    "op1_url_filter",
    r"""
    WITH r(rule_host, rule_path, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM p
    )
    SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(said, 'allow') AS verdict
    FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules, ["page_id"])


@_query("op2_collision_neighbours")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


@_query("op3_toxicity_pu")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(docs, table(spark, folder, "labels"), folds=5, held=0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@_query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), window=4096, end_id=2)


@_query(
    "op5_chat_events",
    r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    e AS (
        SELECT *, list_sum(list_transform(['<s>', '</s>', '[SYS]', '[/SYS]', '[INST]', '[/INST]', '[ROLE]', '[/ROLE]', chr(92)],
            lambda x: (length(text) - length(replace(text, x, ''))) // length(x))) AS breaks
        FROM c
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(text) + breaks + CASE role WHEN 'assistant' THEN 7 WHEN 'system' THEN 20 WHEN 'user' THEN 22 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digests(chat.render(chat.fold_events(chat.log_of_turns(rows))))


@_query("op6_personal_data")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return pii.personal_data(docs, pii.fit(docs)).drop("text")


@_query("op7_language_profiles")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    profiles = language.fit(docs, folds=4, held=2)
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return language.predict(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query("op8_simhash_components")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op10_byte_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return bpe.encode_documents(spark, docs, vocabulary("byte_bpe_50k.json")).drop("text")


@_query("op9_decision_list")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    rules = quality.fit(docs, table(spark, folder, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept", "rule")


@_query(
    "op9_statistics",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    win AS (
        SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
            unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g
        FROM d WHERE len(w) >= 3
    ),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
    base AS (
        SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
            coalesce(cov.n, 0) AS n_repeat_words
        FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
    )
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
    """,
)
def op9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.statistics(documents(spark, folder))
    return rows.select("doc_id", *quality.BASE, quality.base_failed().alias("base_failed"))


@_query("op11_chunk_table_pieces")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return sentencepieces.digests(docs, vocabulary("piece_bpe_32k.model"))


@_query(
    "op12_skip_list_infill",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
            sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
        FROM documents
    ),
    h AS (
        SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
        FROM d
    ),
    c AS (
        SELECT doc_id, t, n, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
            array_to_string(u[1 + least(h1 % (n + 1), h2 % (n + 1)):greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
            array_to_string(u[1 + greatest(h1 % (n + 1), h2 % (n + 1)):], '') AS s,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM h
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM c
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.transformed(documents(spark, folder).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


@_query(
    "op13_toivonen_phrases",
    r"""
    WITH s AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s
        FROM documents
    ),
    w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM s),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
    ),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
    inside AS (
        SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
        FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w FROM f WHERE k >= 3), (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i)
        WHERE m < k AND i + m - 1 <= k GROUP BY ALL
    ),
    open_ AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE k >= 2 AND NOT coalesce(100 * most >= 80 * a, false)),
    cuts AS (SELECT lang, phrase, a, k, c, string_split(phrase, ' ') AS w FROM open_, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
    told AS (
        SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS BIGINT) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
    ),
    best AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM best JOIN n USING (lang) QUALIFY rank <= 2000
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


@_query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
