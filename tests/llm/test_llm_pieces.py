"""SentencePiece by chunk table: equal to the library on odd texts, exact decoding, bounded table."""

import hashlib
import random

import pytest
import sentencepiece

from foliospark.llm import sentencepieces
from foliospark.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b ", "▁", "▁▁x ▁", "a▁b", " ▁ ", "a\n\nb \n", "\t x", "日本語 テキスト", "é é", "\x00a", "<s> </s><unk>",
       "　x y", "😀 😀😀", "x" * 5000, " " * 40, "the the the", "﻿a", "a b", "<0x41>"]


def random_texts(n: int) -> list[str]:
    rng = random.Random(11)
    letters = ["a", "b", "the", "ing", " ", " ", "  ", "▁", "\n", "\t", "é", "中", "😀", ".", "0", "12", "\x00", "́"]
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(n)]


def test_equal_to_the_library(model):
    texts = ODD + random_texts(4000)
    table = sentencepieces.ChunkTable(PATH)
    for text, (ids, back) in zip(texts, table.encode(texts), strict=True):
        want = model.encode(text)
        assert ids.decode() == ",".join(map(str, want)), repr(text)
        assert back == model.decode(want), repr(text)


def test_full_table_is_begun_anew(model):
    table = sentencepieces.ChunkTable(PATH, most_bytes=2000)
    for text in random_texts(300):
        assert table.encode([text])[0][0].decode() == ",".join(map(str, model.encode(text)))
        assert table.size < 2000 + 400 * 42


def test_columns(spark, model):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (0, "a b", "y"), (0, "a b", "y"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = sentencepieces.digests(df, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def row(key, text):
        ids = model.encode(text or "")
        return key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode() if ids else b"").hexdigest()

    assert sorted(map(tuple, got.collect()), key=str) == sorted((row(k, t) for k, t, _ in rows), key=str)


def test_ids_and_their_text(spark, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    made = sentencepieces.encoded(df, PATH)
    ids = {r["doc_id"]: r["ids"] for r in made.collect()}
    assert ids == {i: model.encode(t or "") for i, t in enumerate([*ODD, None])}
    back = {r["doc_id"]: r["back"] for r in sentencepieces.decoded(made, PATH, name="back").collect()}
    assert back == {i: model.decode(v) if v else "" for i, v in ids.items()}


def test_empty_table(spark):
    assert sentencepieces.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_model_with_crossing_pieces_is_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b")
    with pytest.raises(ValueError, match="crosses"):
        sentencepieces.ChunkTable(PATH)
