"""Fill-in-middle: cuts of the skip list against plain slicing, exact restoring, forms and odd rows."""

import hashlib
import random
import re

import pytest

from foliospark.llm import infill
from pyspark.sql import functions as F

TEXTS = ["", "a", "a\n", "\n", "\n\n\n", "a\nb", "é中😀\nx\n\ny", "has <P> in\nit", "<S>", "x<M\n>", "<\nP>\n<", "a\r\nb\r\n", "l\n" * 700, "x" * 100_000, " a\u0085b"]


def plainly(key, text, seed=7, spm_rate=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, t
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 64, 1000])
def test_every_rank_of_the_skip_list(n):
    rng = random.Random(n)
    widths = [rng.randrange(1, 50) for _ in range(n)]
    lines = infill.SkipList(widths)
    assert (lines.size, lines.length) == (n, sum(widths))
    assert [lines.offset(i) for i in range(n + 1)] == [sum(widths[:i]) for i in range(n + 1)]
    with pytest.raises(IndexError):
        lines.offset(n + 1)


def test_lanes_thin_out():
    lanes = [len(x) for x in infill.SkipList([1] * 20_000).units]
    assert len(lanes) >= 5 and all(3 * b < 1.5 * a for a, b in zip(lanes, lanes[1:], strict=False) if a > 500)
    assert all(sum(x) == 20_000 for x in infill.SkipList([1] * 20_000).units)


def test_rows_equal_plain_slicing(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(None, "a\nb\nc"), (3, None), (5, "a\nb"), (5, "a\nb"), (-2, "q\nr\ns\n")]
    df = spark.createDataFrame([(k, t, "was") for k, t in rows], "doc_id long, text string, OUTPUT string")
    made = infill.transformed(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()), key=str)
    assert got == sorted(((k, t, *plainly(k, t)) for k, t in rows), key=str)
    assert made.where("back <> coalesce(text, '')").count() == 0
    assert {r["form"] for r in made.collect()} == {"plain", "spm", "psm"}


def test_rates(spark):
    df = spark.createDataFrame([(i, "a\nb") for i in range(200)], "doc_id long, text string")
    assert infill.transformed(df, rate=0).where("form <> 'plain'").count() == 0
    assert infill.transformed(df, spm_rate=0).where("form <> 'psm'").count() == 0
    assert 20 < infill.transformed(df, rate=30).where("form <> 'plain'").count() < 100


def test_empty_table(spark):
    assert infill.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
