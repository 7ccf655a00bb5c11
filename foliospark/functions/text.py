"""Text columns: stripping, word counts, previews, page breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup written into parsed text.
ANCHOR_TAG = r"<a id='[^']*'>\s*</a>"
PAGE_BREAK = "<!-- PAGE BREAK -->"

# All Unicode white space: as a pattern, and as the list of characters to trim. Neither needs the slow (?U) flag.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` would only take spaces)."""
    return F.btrim(text, F.lit(_SPACES))


def clean_chunk(text: Column) -> Column:
    return strip(F.regexp_replace(text, ANCHOR_TAG, ""))


def word_count(text: Column) -> Column:
    """Words between white space; leading and trailing space make no word, and an empty text has none."""
    return F.size(F.array_remove(F.split(text, rf"{_SPACE}+"), ""))


def preview(text: Column, length: int, mark: str = "longer") -> Column:
    """First ``length`` characters; ``mark`` adds dots when ``longer``, ``always`` or ``never``."""
    head = F.left(text, F.lit(length))
    if mark == "always":
        return F.concat(head, F.lit("..."))
    if mark == "never":
        return head
    return F.when(F.length(text) > length, F.concat(head, F.lit("..."))).otherwise(text)


def markdown_pages(markdown: Column) -> Column:
    """Array of page texts, cut at the page-break line."""
    return F.split(markdown, rf"\n*{PAGE_BREAK}\n*")
