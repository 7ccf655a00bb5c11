"""SimHash components and the pipeline against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from foliospark.llm import components, pii, simhash, toxicity
from foliospark.llm.queries import vocabulary


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[a] != label[b] and linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    nodes = {n for p in pairs if None not in p and p[0] != p[1] for n in p}
    known = {frozenset(p) for p in pairs}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == closed(sorted(nodes), lambda a, b: frozenset((a, b)) in known)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_hubs(spark):
    """Nodes with most of the links are dealt to many tasks and close as the others do."""
    pairs = [(900, i) for i in range(1000, 1400)] + [(901, i) for i in range(1300, 1500)] + [(5, 1499), (20, 21), (21, 22)]
    nodes = {n for p in pairs for n in p}
    want = {n: 20 if n < 30 and n != 5 else 5 for n in nodes}
    edges = spark.createDataFrame(pairs, "u bigint, v bigint")
    for hub in (1, 10, 256):
        got = {r["node"]: r["component"] for r in components.components(edges, least_hub=hub).collect()}
        assert got == want
    once = components._beside_least(edges, components._least(edges), 10).collect()
    assert sorted((r["u"], r["v"]) for r in once) == sorted(pairs)


@pytest.mark.parametrize("small, large", [(64, 65536), (2, 65536), (2, 8)])
def test_bucket_links_of_every_size(monkeypatch, small, large):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    near = lambda s: s ^ sum(1 << int(b) for b in rng.integers(0, 40, rng.integers(0, 6)))
    prints = np.array(sorted({int(near(int(s))) for s in seeds for _ in range(20)}), np.uint64)
    bucket = np.sort(rng.integers(0, 3, len(prints)))
    nodes = np.arange(len(prints))
    u, v = simhash.bucket_links(prints, nodes, bucket, [list(range(64))] * 3, 4)
    links = {frozenset(p) for p in zip(u.tolist(), v.tolist(), strict=True)}
    want = closed(nodes.tolist(), lambda a, b: bucket[a] == bucket[b] and int(prints[a] ^ prints[b]).bit_count() <= 4)
    assert closed(nodes.tolist(), lambda a, b: frozenset((a, b)) in links) == want
    assert len(u) <= len(prints)


def documents(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(200)]
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            rows += [(100 + i, " ".join(text)), (200 + i, " ".join([*text[:-1], "other"]).upper())]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one  TWO"), (None, "one two"), (305, "x " * 30000)]
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, fingerprint int"), rows


def test_near_duplicates(spark):
    frame, rows = documents(spark)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert {i: f % 2**64 for i, (f, _) in got.items()} == prints
    keyed = [i for i in prints if i is not None]
    assert {i: got[i][1] for i in keyed} == closed(keyed, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert got[None][1] is None
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.first_of_each(frame.union(frame.where("doc_id = 303")), "doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({got[i][1] for i in keyed}) and kept.count(None) == 1


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(150):
        text = " ".join("".join(rng.choice(["tion", "the", "ing", "er", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(60))
        toxic = i % 5 == 1
        if toxic:
            text += " grubble snark grubble"
        rows.append((i, text + (" mail a.b@c.de now" if i % 7 == 0 else ""), "en", "s", len(text), "extra"))
        labels.append((i, 1, int(toxic)))
    rows += [(500, rows[0][1], "en", "s", 1, "e"), (501, None, None, None, None, None), (502, "", "en", "s", 0, "e"), (503, "%% 12", "en", "s", 5, "e"), (None, rows[2][1], None, "s", 5, "e")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_pipeline_stages(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["language"] == set(text) - {501, 502, 503}
    model = toxicity.fit(spark.read.parquet(f"{folder}/language"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept["toxicity"] == {i for i in kept["language"] if model.scorer()([text[i]])[0] < 0.5}
    assert {i for i in range(150) if i % 5 != 1} <= kept["toxicity"] and len(kept["toxicity"] & {i for i in range(150) if i % 5 == 1}) <= 3
    assert kept["near_copies"] == kept["toxicity"] - {500}
    clean = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/personal_data").collect()}
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean.values())
    assert all(("[EMAIL]" in clean[i]["text"]) == (i % 7 == 0) for i in clean if i is not None)
    assert kept["packing"] == kept["near_copies"]
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.select("doc_id", "start", "length").collect())) == sorted(map(str, docs.select("doc_id", "start", "length").collect()))
    assert vocabulary("word_bpe_49k.json").endswith(".json")


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    none = f"{tmp_path}/none"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
