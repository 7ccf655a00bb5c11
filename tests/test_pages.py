"""Whole pages against an independent reader: the standard library's HTML parser."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from foliospark.operators import chunks
from foliospark.session import table


class Reader(HTMLParser):
    """All text outside of scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.unseen, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in chunks.UNSEEN
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.unseen -= tag in chunks.UNSEEN

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def letters(text):
    return re.sub(r"\s", "", text)


def read(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return letters("".join(reader.parts))


def test_every_visible_character_is_in_a_chunk(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html", chunks.page_chunks(F.col("html"), F.col("page_id").cast("string")).alias("c"))
    for r in pages.collect():
        assert letters("".join(c["markdown"] for c in r["c"])) == read(r["html"])


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>one<p>two<br>three</p>tail", [("text", "one"), ("text", "two\nthree"), ("text", "tail")]),
        ("<H2 class='a'>T &amp;amp; &#65;&#x41;</H2><div>x<b>y</b> z</div>", [("title", "T &amp; AA"), ("text", "xy z")]),
        ("<table><tr><th>a</th><td>b &lt; c</td></tr></table>", [("table", "a"), ("table", "b < c")]),
        ("<script>var t='</p>';</script>a<!-- <p>b</p> -->c<style>p{}</style>", [("text", "ac")]),
        ("<pre>a < b</pre><footer>&copy; x</footer> \n", [("text", "a < b"), ("marginalia", "© x")]),
        ("", []), (" ", []), ("&#0;&#1114112;&#55296;", [("text", "&#0;&#1114112;&#55296;")]),
    ],
)
def test_small_pages(spark, page, want):
    row = spark.createDataFrame([(page,)], "h string").select(chunks.page_chunks(F.col("h"), F.lit("k")).alias("c")).first()
    assert [(c["type"], c["markdown"]) for c in row["c"]] == want
    assert [c["id"] for c in row["c"]] == [f"k-{i}" for i in range(len(want))]


def test_quoted_attributes_and_hexadecimal_references(spark):
    pages = [("<p title='a>b'>z</p>", ["z"]), ('<p data-x="1>2" title=\'>\'>y<b title=">">w</b>', ["yw"]), ("<p>it&#x27;s &#X41;&#39;", ["it's A'"]), ("<p title=it's>q</p>", ["q"])]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "id int, html string")
    got = {r["id"]: [c["markdown"] for c in r["c"]] for r in df.select("id", chunks.page_chunks(F.col("html"), F.col("id").cast("string")).alias("c")).collect()}
    for i, (html, want) in enumerate(pages):
        assert [m.split("\n\n", 1)[-1] for m in got[i]] == want, html
