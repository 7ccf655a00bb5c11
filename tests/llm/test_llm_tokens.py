"""BPE, packing and chat: equality with the tokenizers library, whole pieces, round trips."""

import random
import zlib

import numpy as np
import pytest

from foliospark.llm import bpe, chat, packing
from foliospark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "b", "the", "ing", "'s", "'re", "é", "é", "ß", "Σ", "İ", "J̌", "1", "²", "%", "***", ".", ",", "<|endoftext|>", "<|startoftext|>", "中文", "🙂", "‍", "\x00", "\r\n", "_", "The"]


def texts(n, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [None, "", *made, "x" * 5000, "word. " * 3000]


def test_bpe_equals_the_library(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t, "clash") for i, t in enumerate(texts(3000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    block = bpe.build_lexicon(bpe.frequent_words(docs, most=500), bpe.Vocabulary(path))
    got = bpe.encoded(docs, path, block, digests=False)
    back = {r["doc_id"]: r["back"] for r in bpe.decoded(got, path, "ids", "back").collect()}
    for r in got.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want, r["text"]
        assert back[r["doc_id"]] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(spark, docs.limit(0), path).count() == 0


def test_lexicon_is_a_minimal_automaton():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode(): [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(300)}
    block = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(block)
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    others = {"".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))).encode() for _ in range(2000)} - set(words)
    assert all(lexicon.get(w) is None for w in others)
    endings = lambda p: frozenset(w[len(p) :] for w in words if w.startswith(p))
    states = {endings(w[:i]) for w in words for i in range(len(w) + 1)}
    assert len(lexicon.final) == len(states)
    assert bpe.Lexicon(bpe.compile_lexicon({})).get(b"a") is None


def check_packing(rows, window, ids_of):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, pieces in by_doc.items():
        at, ids = 0, ids_of(key)
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return by_doc, by_sequence


def test_packing(spark):
    path = vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = {i: t for i, t in enumerate(texts(1500, 2))}
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows.items()], "doc_id bigint, text string, offset int")
    got = packing.packed_documents(docs, path, window=64).collect()
    by_doc, by_sequence = check_packing(got, 64, lambda i: [*library.encode(rows[i] or "", add_special_tokens=False).ids, 2])
    assert set(by_doc) == set(rows)
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1.02 * total / 64 + 1
    assert packing.packed_documents(docs.limit(0), path).count() == 0
    told = packing.padding(spark.createDataFrame([(1, 4096), (2, 2048), (3, 5)], "sequence_id bigint, length bigint")).first()
    assert (told["sequences"], told["tokens"], told["padded"]) == (3, 6149, 4091)


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(0)
    for window in (1, 7, 64, 100):
        lengths = rng.integers(1, window + 1, 300)
        own, offset = packing.best_fit_decreasing(lengths, window)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else window) - lengths[i])
        left = sorted(window - lengths[own == w].sum() for w in np.unique(own))
        assert left == sorted(room)


def test_repeated_rows_and_null_keys_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    got = packing.packed_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["offset"], r["length"]) for r in got) == [(0, 6, 2), (1, 0, 3), (1, 3, 3)]


def test_chat_round_trip():
    rng = random.Random(0)
    parts = ["\\", "<", "s", ">", "/", "[", "]", "INST", *chat.CONTROL, " ", "\n", "é"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        role = rng.choice(["user", "assistant", "system", "", "x<s>", "[ROLE]", "tool\\"])
        segment, start, end = chat.render_turn(role, text)
        assert chat.read_turn(segment) == (role, text)
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.unescape(segment[start:end]) == (text if role == "assistant" else "")


def test_events_fold_and_digests(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 3, "regenerate", None, "zzz"),
        (1, 1, 4, "delta", "assistant", "c<s>"), (1, 1, 5, "delta", None, None), (1, 0, 6, "edit", None, "ho"), (2, 0, 0, "message", None, None),
        (None, 0, 0, "message", "user", "x"), (3, 0, 0, "message", "user", "p"), (3, 0, 0, "message", "user", "p"), (4, 7, 1, "odd", "tool", "t"),
    ]
    events = spark.createDataFrame(rows, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string")
    folded = chat.fold_events(events)
    got = sorted((r["conv_id"] or 0, r["turn"], r["copy"], r["role"], r["text"]) for r in folded.collect() if r["role"])
    assert got == [(0, 0, 0, "user", "x"), (1, 0, 0, "user", "ho"), (1, 1, 0, "assistant", "c<s>"), (3, 0, 0, "user", "p"), (3, 0, 1, "user", "p"), (4, 7, 0, "tool", "t")]
    rendered = chat.render(folded)
    told = {r["conv_id"]: r for r in chat.digests(rendered).collect()}
    assert {k: (v["n_turns"], v["loss_chars"]) for k, v in told.items()} == {1: (2, 4), 2: (1, 0), None: (1, 0), 3: (2, 0), 4: (1, 0)}
    whole = {r["conv_id"]: r["formatted"] for r in chat.formatted(rendered).collect()}
    assert all(len(whole[k]) == told[k]["formatted_chars"] for k in told)
    assert whole[1] == "<s>[INST] ho [/INST]</s><s>c<\\s></s>"
    assert chat.digests(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_many_rows_without_a_key_are_dealt_to_many_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(None, f"a {i % 7}") for i in range(3000)] + [(5, "b")] * 1000, "doc_id bigint, text string")
    pack = packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, keys, window: pack(pieces, keys, window, group_pieces=250))
    got = packing.packed_documents(docs, vocabulary("word_bpe_49k.json"), window=64).collect()
    sizes = {}
    for r in got:
        sizes[r["sequence_id"] >> 32] = sizes.get(r["sequence_id"] >> 32, 0) + 1
    assert len(got) == 4000 and len(sizes) == 16 and max(sizes.values()) < 500


def test_pieces_of_no_length_are_not_packed(spark):
    pieces = spark.createDataFrame([(1, 0), (2, 5), (3, None), (4, 59)], "k int, length long")
    got = {r["k"]: (r["sequence_id"], r["offset"]) for r in packing.pack(pieces, ["k"], 64).collect()}
    assert got[1] == got[3] == (None, None) and got[2][0] == got[4][0] and {got[2][1], got[4][1]} == {0, 59}


def test_word_ids_equal_the_library_and_stay_bounded():
    path = vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["a", "The", "ING", "s", "é", "É", "İ", "ſ", "K", "中", "'s", "'S", ".", ",", ";", "!", "0", " ", "  ", "\n", "\t", "\x1c", "\x85", "😀", "ǅ", "ß", "́", "ª", "<|endoftext|>"]
    some = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)]
    for most in (1 << 30, 5000):
        words = packing.WordIds(path, most)
        for start in range(0, len(some), 50):
            got = words.encode(some[start : start + 50])
            assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some[start : start + 50]]
            assert words.size < most + 50 * 12 * 300


def test_a_word_has_one_entry_in_latin_texts():
    path = vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    words = packing.WordIds(path)
    some = ["Über über. ÜBER, (über); über's", "über!über"]
    assert words.encode(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    assert len([w for w in words.ids if "ber" in w.lower()]) == 1
    rng = random.Random(6)
    parts = [*map(chr, range(256)), "'s", "'RE", "<|endoftext|>", "<|StartOfText|>", "<|", "</w>", "ing", "The", "…"]
    odd = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    assert words.encode(odd) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_log_of_turns_folds_back_and_needs_every_kind(spark):
    rng = random.Random(8)
    rows = [(i % 30, i // 30, rng.choice(["user", "assistant", "", None]), "é😀 word " * rng.randrange(0, 60)) for i in range(300)]
    rows += [(5, 1, "user", "twice"), (5, 1, "user", "twice"), (None, 0, "user", None), (7, None, None, "x"), (8, 3, "assistant", "long " * 20_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    log = chat.log_of_turns(turns)
    events = log.collect()
    assert {r["kind"] for r in events} == set(chat.KINDS)

    def folded(some):
        random.Random(1).shuffle(some)  # a log in any order
        made = chat.fold_events(spark.createDataFrame(some, log.schema).repartition(3))
        return sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in made.collect()), key=str)

    want = sorted(((c, t, r, x or "") for c, t, r, x in rows), key=str)
    assert folded(list(events)) == want
    for kind in chat.KINDS:
        assert folded([e for e in events if e["kind"] != kind]) != want
    assert chat.log_of_turns(turns.limit(0)).count() == 0
