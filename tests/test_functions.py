"""Edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import paths, text, values


def one(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "raw", ["  a b\t", " x y　", "\x1c a\x85b \n", "", " ", "​kept", "a b", "no_space"]
)
def test_strip_and_words_are_as_in_python(spark, raw):
    assert one(spark, text.strip(F.col("t")), t=raw) == raw.strip()
    assert one(spark, text.word_count(F.col("t")), t=raw) == len(raw.split())


def test_clean_chunk_removes_anchors(spark):
    assert one(spark, text.clean_chunk(F.col("t")), t="<a id='x-1'>\n</a>\n\n body <a id=''></a>") == "body"


def test_previews(spark):
    c = F.col("t")
    assert one(spark, text.preview(c, 3), t="abc") == "abc"
    assert one(spark, text.preview(c, 3), t="abcd") == "abc..."
    assert one(spark, text.preview(c, 3, "always"), t="ab") == "ab..."
    assert one(spark, text.preview(c, 3, "never"), t="abcd") == "abc"


def test_page_breaks(spark):
    assert one(spark, text.markdown_pages(F.col("t")), t=f"one\n\n{text.PAGE_BREAK}\n\ntwo") == ["one", "two"]


@pytest.mark.parametrize(
    ("name", "stem"), [("a.pdf", "a"), ("a.b.pdf", "a.b"), (".env", ".env"), ("plain", "plain"), ("", "")]
)
def test_stem(spark, name, stem):
    assert one(spark, paths.stem(F.col("t")), t=name) == stem


def test_basename_of_folder_is_null(spark):
    assert one(spark, paths.basename(F.col("t")), t="a/b/") is None
    assert one(spark, paths.last_segment(F.col("t")), t="a/b/") == ""
    assert one(spark, paths.basename(F.col("t")), t="a/b.pdf") == "b.pdf"


@pytest.mark.parametrize(
    ("key", "glob", "hit"),
    [("in/a/b.pdf", "in/*.pdf", True), ("in/b.PDF", "*.pdf", False), ("x1.pdf", "x[0-9].p?f", True), ("x1.pdf\n", "*.pdf", False)],
)
def test_glob_crosses_folders(spark, key, glob, hit):
    assert one(spark, paths.matches_glob(F.col("t"), glob), t=key) is hit


def test_output_key(spark):
    k = paths.output_key(F.col("t"))
    assert one(spark, k, t="input/a/b/doc.v1.pdf") == "output/a/b/doc.v1.md"
    assert one(spark, k, t="input/doc.pdf") == "output/doc.md"


def test_top_folder(spark):
    k = paths.top_folder(F.col("t"))
    assert [one(spark, k, t=t) for t in ("out/inv/a.md", "out/a.md", "a.md")] == ["inv", "root", None]


def test_chunk_image_path_needs_id_type_and_page(spark):
    c = lambda v: F.lit(v)
    full = paths.chunk_image_path("r", c("d.pdf"), c(0), c("text"), c("i"))
    assert one(spark, full) == "r/chunk_images/d/page_0/text.i.png"
    assert one(spark, paths.chunk_image_path("r", c("d.pdf"), c(None).cast("int"), c("text"), c("i"))) is None
    assert one(spark, paths.chunk_image_path("r", c("d.pdf"), c(0), c(""), c("i"))) is None


def test_money(spark):
    assert one(spark, values.money_text(F.lit(1234567.125))) == "$1,234,567.12"
    assert one(spark, values.money_text(F.lit(0.0))) == "-"
    assert one(spark, values.money_text(F.lit(None).cast("double"))) == "-"
    assert str(one(spark, values.money_value(F.lit("$1,234.50")))) == "1234.50"
    assert one(spark, values.money_value(F.lit("-"))) is None


def test_zero_pad_never_cuts(spark):
    assert one(spark, values.zero_pad(F.lit("320193"))) == "0000320193"
    assert one(spark, values.zero_pad(F.lit("12345678901"))) == "12345678901"


def test_defaults_fill_absent_keys_only(spark):
    doc = F.parse_json(F.lit('{"a": null, "b": "x"}'))
    pick = lambda k: values.variant_default(doc, f"$.{k}", "string", "USD")
    assert [one(spark, pick(k)) for k in "abc"] == [None, "x", "USD"]


def test_masks(spark):
    assert one(spark, values.mask_account(F.lit("123456789012"))) == "1234XXXX9012"
    assert one(spark, values.mask_account(F.lit("12345678"))) == "X" * 12


def test_truthy(spark):
    assert [one(spark, values.is_truthy(F.lit(v))) for v in ("TRUE", "1", "yes", "no", "")] == [True, True, True, False, False]
    assert one(spark, values.is_truthy(F.lit(None).cast("string"))) is False


def test_document_links(spark):
    url = values.document_url(F.lit("0000320193-24-000123"), F.lit("a.htm"))
    assert one(spark, url) == "https://www.sec.gov/Archives/edgar/data/0000320193/000032019324000123/a.htm"
    assert one(spark, values.filing_pdf_name(F.lit("1-2"), F.lit("a.html"))) == "1-2_a.pdfl"


def test_list_text_prints_as_python_does(spark):
    for items in (["a", "b c"], [], ["it's"], ['"'], ["it's \"x\""], ["a\\b\nc"], ["x", None]):
        column = F.array(*[F.lit(i).cast("string") for i in items]).cast("array<string>")
        assert one(spark, values.list_text(column)) == str(items)


def test_dates(spark):
    d = lambda v: one(spark, values.lenient_date(F.lit(v), "yyyy-MM-dd", "MM-dd-yyyy").cast("string"))
    assert [d(v) for v in ("2024-02-03", "02-03-2024", "soon", "2024-02-31")] == ["2024-02-03", "2024-02-03", None, None]
