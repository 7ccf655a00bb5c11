"""Registered queries: equal SQL where there is one, else shapes and whole results on the smallest tables."""

import pytest
from verify import compare

import __spark_entry__ as contract
from foliospark.llm.queries import LLM_QUERIES, LLM_SQL

COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op2_collision_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op3_toxicity_pu": ["doc_id", "held_out", "score", "predicted"],
    "op4_best_fit_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_chat_events": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op6_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_language_profiles": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_simhash_components": ["doc_id", "fingerprint", "component_id"],
    "op9_decision_list": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"],
    "op10_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_chunk_table_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_skip_list_infill": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_toivonen_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query_matches_sql(spark, con, folder, name):
    assert compare(LLM_QUERIES[name](spark, folder), con, LLM_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_whole_tables(spark, folder, name):
    got = LLM_QUERIES[name](spark, folder)
    assert got.columns == COLUMNS[name]
    if "doc_id" in COLUMNS[name]:
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
        assert sorted(r[0] for r in got.select("doc_id").distinct().collect()) == sorted(r[0] for r in docs.collect())


def test_registered_in_the_contract():
    assert set(LLM_QUERIES) <= set(contract.queries())
    assert set(LLM_SQL) <= set(contract.oracle_sql())
