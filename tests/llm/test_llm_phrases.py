"""Phrase mining against brute force: border failures, overlaps, ties, separators, null groups, odd rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import collocations

SEPARATORS = ".,;:!?\n\x0b\x0c\r"


def phrases(docs):
    counts, totals = Counter(), Counter()
    for _, text, lang in docs:
        g, t = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for s in SEPARATORS[1:]:
            t = t.replace(s, ".")
        for piece in t.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[g] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[g, tuple(words[i : i + k])] += 1
    return counts, totals


def brute(docs, least=30, most=2000):
    counts, totals = phrases(docs)
    frequent = {p: f for p, f in counts.items() if f >= least}
    inside = {}
    for (g, p), f in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[g, p[i : i + k]] = max(inside.get((g, p[i : i + k]), 0), f)
    out = []
    for g in totals:
        rows = []
        for (own, p), a in frequent.items():
            if own != g or len(p) < 2 or 100 * inside.get((g, p), 0) >= 80 * a:
                continue
            cuts = [(2000000 * a // (frequent[g, p[:k]] + frequent[g, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), frequent[g, p[:k]], frequent[g, p[k:]]))
        out += [(g, i, p.decode(), -a, left, right, totals[g], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["of", "the", "a", "Sea", "sea", "élan", "ÉLAN", "x1", "-", "\x85", "new", "york", "city", "hall"]
    docs = []
    for i in range(n):
        parts = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "  "]) for p in parts)
        docs.append((i, text + ("New York city hall " * (i % 3)), rng.choice(["en", "de", None])))
    return docs


def run(spark, docs, **mining):
    df = spark.createDataFrame([(k, t, g, "x") for k, t, g in docs], "doc_id long, text string, lang string, phrase string")
    return sorted(map(tuple, collocations.collocations(df.repartition(5), **mining).collect()))


@pytest.mark.parametrize("sample", [1, 20, 1000])
def test_any_sample_gives_the_exact_result(spark, sample):
    docs = corpus(500)
    docs += [(k, None, "en") for k in (900, 901)] + [(None, "new york city hall", "en")] * 40 + [(7, "ha ha ha ha ha", None)] * 20 + [(950, "", "fr"), (951, "rare", "fr")]
    want = brute(docs, least=6)
    assert len(want) > 100 and {r[0] for r in want} == {"en", "de", "und"}
    assert run(spark, docs, sample=sample, least=6) == want


def test_small_tables_only_cost_counts(spark):
    docs = corpus(120, seed=9)
    assert run(spark, docs, bits=8, least=10, sample=5) == brute(docs, least=10)


def test_border_failures_take_further_passes(spark, monkeypatch):
    # The sampled documents know none of the frequent words, so that words, pairs, triples and quadruples fail in turn.
    docs = [(i, "alpha beta gamma delta", "en") for i in range(60)] + [(i, "", "en") for i in range(60, 400)]
    passes = []
    count = collocations._count_digests
    monkeypatch.setattr(collocations, "_count_digests", lambda texts, least, known, before, bits, **more: passes.append(before) or count(texts, least, known, before, bits, **more))
    monkeypatch.setattr(collocations, "lowest_keys", lambda df, key, most, rows: df.where("doc_id = 399").select(key))
    assert run(spark, docs) == brute(docs)
    assert len(passes) == 1 + 4  # the sample, and a full pass for each length


def test_many_slices(spark, monkeypatch):
    docs = corpus(300, seed=3)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 700)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 400)
    assert sorted(map(tuple, collocations.collocations(df, least=8, sample=30).collect())) == brute(docs, least=8)


def test_most_and_ties(spark):
    docs = [(i, "c d. a b. e f", "en") for i in range(30)]
    assert [r[2] for r in run(spark, docs, most=2)] == ["a b", "c d"]


def test_long_text_and_one_group_for_all(spark):
    docs = [(0, "one two three " * 40_000, "en")] + [(i, "one two", "en") for i in range(1, 40)]
    assert run(spark, docs) == brute(docs)


def test_no_rows_and_no_words(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None, None), (1, " .\n", "en")]) == []


def test_large_products_are_exact(spark):
    big = 3 * 10**15
    rows = [("en", 0, "", 9 * 10**18), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).collect()
    assert [r["score"] for r in got] == [2000000 * (big - 1) // (2 * big + 1)]


def test_digests_depend_on_word_and_group_alone():
    words = ["a", "b", "ab", "ba", "aa", "é", "\x00", "x" * 3000, "thing"]
    rng = random.Random(1)
    order = [rng.choice(words) for _ in range(500)]
    told = {}
    for group in ("en", "de"):
        digests, pieces = collocations.word_digests(" ".join(order).encode() + b" \n ", group)
        assert len(digests) == 500 and not pieces.any()
        for w, d in zip(order, digests.tolist(), strict=True):
            assert told.setdefault((group, w), d) == d
    assert len(set(told.values())) == len(told)
    digests, pieces = collocations.word_digests(b"\n a\n\nb c", "en")
    assert pieces.tolist() == [1, 3, 3] and digests[0] == told["en", "a"]
    assert len(collocations.word_digests(b" \n", "en")[0]) == 0 == len(collocations.word_digests(b"", "en")[0])
    grams = collocations.Grams([b"A b.", b"b,ab"], "en")
    assert grams.own.tolist() == [told["en", w] for w in ("a", "b", "b", "ab")] and len(set(grams.piece.tolist())) == 3


def test_slices_of_a_task_are_added_up():
    """What a task gives away does not grow with its slices, and adding up loses nothing where the room is small."""
    for most, times in ((1 << 20, 1), (4, None)):
        held, given = collocations.Held(most), []
        for n in range(10):
            held.add("en", 2, pa.array(["a b", f"x {n % 3}"]), np.array([2, 1]))
            held.add("de", 1, pa.array(["a"]), np.array([1]))
            given += [r for b in held.told() for r in b.to_pylist()]
        given += [r for b in held.told(last=True) for r in b.to_pylist()]
        sums = {}
        for r in given:
            at = (r["lang"], r["k"], r["phrase"])
            sums[at] = sums.get(at, 0) + r["f"]
        assert sums == {("en", 2, "a b"): 20, ("en", 2, "x 0"): 4, ("en", 2, "x 1"): 3, ("en", 2, "x 2"): 3, ("de", 1, "a"): 10}
        assert times is None or len(given) == len(sums)
    assert list(collocations.Held(4).told(last=True)) == []


def test_one_task_names_a_phrase(spark):
    """Rows that tasks give away for texts are as many as phrases, however many tasks hold each phrase."""
    docs = corpus(60, seed=2)
    texts = spark.createDataFrame([(g or "und", t) for _, t, g in docs * 8], "g string, t string").repartition(8).cache()
    known = np.full(1 << 10, ~np.uint64(0))
    found = collocations._count_digests(texts, 30, known, None, 16).cache()
    rows = collocations._name_phrases(texts, collocations._table_of(found, 16), collocations._owners(found), 16).where("k > 0").cache()
    frequent = {(g, " ".join(p)): f for (g, p), f in phrases(docs * 8)[0].items() if f >= 30}
    counts = {(r.lang, r.phrase): r.n for r in rows.join(found, ["h", "g"]).collect()}
    assert len(frequent) > 100 and counts == frequent
    assert rows.join(found, ["h", "g"]).count() < 1.1 * len(frequent)  # eight times as many when every task gave its own
    assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 0.5 * rows.count()
    for frame in (texts, found, rows):
        frame.unpersist()


def test_shared_cells_are_named_by_all(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CELL_BITS", 8)
    docs = corpus(200, seed=4)
    assert run(spark, docs, least=5, sample=20) == brute(docs, least=5)


@pytest.mark.parametrize("fault", ["no task names a phrase", "texts share a digest"])
def test_unnamed_or_shared_digests_are_counted_by_text(spark, monkeypatch, fault):
    docs, counted = corpus(200, seed=6), []
    if fault == "no task names a phrase":
        monkeypatch.setattr(collocations, "_owners", lambda found: [np.zeros(256, np.uint16)])
    else:
        monkeypatch.setattr(collocations, "_level", lambda digest, k: collocations._mixed(digest) >> np.uint64(58) << np.uint64(58) | np.uint64(k - 1))
    by_text = collocations._count_phrases
    monkeypatch.setattr(collocations, "_count_phrases", lambda *given: counted.append(1) or by_text(*given))
    assert run(spark, docs, least=6, sample=20) == brute(docs, least=6)
    assert counted == [1]


def test_last_word_tells_digests_apart(spark, monkeypatch):
    """Phrases of one counted digest but other last words have a count each."""
    monkeypatch.setattr(collocations, "_level", lambda digest, k: np.full(len(digest), k - 1, np.uint64))
    docs = [(i, "a b. a c", "en") for i in range(40)] + [(99, "a d", "en")]
    assert run(spark, docs) == brute(docs)
