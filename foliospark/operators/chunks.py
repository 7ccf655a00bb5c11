"""Chunk tables: native chunking of text and pages, chunk rows with neighbours, per-document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from .arrays import unnest

LINES_PER_PAGE = 40

# First matching rule gives the chunk type of a line.
LINE_RULES = (
    ("table", r"[|\t]"),
    ("scan_code", "[0-9]{4,}"),
    ("attestation", "(?i)licen|copyright|permission"),
    ("figure", r"[(][^()]*[)]"),
)
# Chunk type per HTML element; the text of other elements is of type text.
TAG_TYPES = {
    **{f"h{n}": "title" for n in range(1, 7)}, "title": "logo", "li": "marginalia", "footer": "marginalia", "nav": "marginalia",
    "aside": "marginalia", "th": "table", "td": "table", "figcaption": "figure",
}
# Elements that begin and end a block; all others stand inside a line of text.
BLOCKS = (
    "address|article|aside|blockquote|body|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav"
    "|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
# Elements whose content is no text of the page.
UNSEEN = ("script", "style", "template", "noscript")
# Named character references and their characters; any other name stays as it is.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "\u00a9", "reg": "\u00ae", "middot": "\u00b7",
    "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac", "amp": "&",
}


def line_type(line: Column) -> Column:
    ladder = None
    for kind, pattern in LINE_RULES:
        hit = line.rlike(pattern)
        ladder = F.when(hit, kind) if ladder is None else ladder.when(hit, kind)
    return ladder.when(text.word_count(line) <= 3, "marginalia").otherwise("text")


def text_chunks(body: Column, key: Column) -> Column:
    """Array of chunk structs, one per line, with id, type, anchored markdown, page and box."""

    def chunk(line: Column, i: Column) -> Column:
        chunk_id = F.concat_ws("-", key, i)
        row = F.pmod(i, F.lit(LINES_PER_PAGE))
        box = F.struct(
            F.lit(0.05).alias("left"),
            (row / F.lit(float(LINES_PER_PAGE))).alias("top"),
            F.lit(0.95).alias("right"),
            ((row + 1) / F.lit(float(LINES_PER_PAGE))).alias("bottom"),
        )
        page = F.floor(i / F.lit(LINES_PER_PAGE)).cast("int")
        return F.struct(
            chunk_id.alias("id"),
            line_type(line).alias("type"),
            F.concat(F.lit("<a id='"), chunk_id, F.lit("'></a>\n\n"), line).alias("markdown"),
            F.struct(page.alias("page"), box.alias("box")).alias("grounding"),
        )

    return F.transform(F.split(body, "\n"), chunk)


#: What stands in a tag up to its end: a ``>`` between quotes does not end it.
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


def decoded_entities(body: Column) -> Column:
    """Text with character references replaced, numeric ones first and the ampersand last."""

    def number(piece: Column) -> Column:
        digits, sixteens = F.regexp_extract(piece, "^&#([0-9]{1,7});", 1), F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", digits.cast("int")).when(sixteens != "", F.conv(sixteens, 16, 10).cast("int"))
        letter = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.concat(letter, F.regexp_replace(piece, "^&#[0-9a-fA-FxX]+;", ""))).otherwise(piece)

    numeric = F.array_join(F.transform(F.split(body, "(?=&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), number), "")
    out = F.when(F.contains(body, F.lit("&#")), numeric).otherwise(body)
    for name, character in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(character))
    return out


def page_chunks(html: Column, key: Column) -> Column:
    """Array of chunk structs with every visible text of a page, in page order.

    Comments, scripts and styles go first. The page is cut before every opening and closing block tag, so that an
    element without its closing tag ends where the next block begins; a piece's type follows from the tag it begins
    with. Line breaks become line ends, other tags vanish, character references are replaced, and blank pieces are left out.
    """
    seen = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    for name in UNSEEN:
        seen = F.regexp_replace(seen, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|$)", "")
    pieces = F.split(seen, rf"(?i)(?=</?(?:{BLOCKS})(?:[\s/]{ATTRIBUTES})?>)")
    kinds = F.create_map(*[F.lit(v) for pair in TAG_TYPES.items() for v in pair])

    def read(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<([a-zA-Z0-9]+)", 1))
        broken = F.regexp_replace(piece, r"(?i)<br\s*/?>", "\n")
        return F.struct(
            F.coalesce(kinds[tag], F.lit("text")).alias("type"),
            text.strip(decoded_entities(F.regexp_replace(broken, rf"(?s)<[a-zA-Z/!?](?:{ATTRIBUTES}>|[^>]*>)", ""))).alias("markdown"),
        )

    filled = F.filter(F.transform(pieces, read), lambda c: c["markdown"] != "")
    return F.transform(filled, lambda c, i: F.struct(F.concat_ws("-", key, i).alias("id"), c["type"].alias("type"), c["markdown"].alias("markdown")))


def parse_documents(docs: DataFrame, key: str, body: str, filename: Column, version: str, *keep: str) -> DataFrame:
    """Parse response per document: chunks, whole markdown, metadata and grounding, without any shuffle.

    The columns ``keep`` of the documents stay.
    """
    key_text = F.col(key).cast("string")
    lines = F.size(F.split(F.col(body), "\n"))
    pages = F.ceil(lines / LINES_PER_PAGE).cast("int")
    chunks = docs.select(key, *keep, F.col(body).alias("markdown"), filename.alias("filename"), pages.alias("page_count"),
                         text_chunks(F.col(body), key_text).alias("chunks"))
    kind = F.create_map(
        *[F.lit(v) for pair in {
            "text": "chunkText", "table": "chunkTable", "marginalia": "chunkMarginalia", "figure": "chunkFigure",
            "attestation": "chunkAttestation", "scan_code": "chunkScanCode",
        }.items() for v in pair]
    )
    grounding = F.map_from_entries(
        F.transform(
            "chunks",
            lambda c: F.struct(
                c["id"],
                F.struct(
                    c["grounding"]["page"].alias("page"), kind[c["type"]].alias("type"),
                    c["grounding"]["box"].alias("box"),
                ),
            ),
        )
    )
    return chunks.select(
        key, *keep, "chunks", "markdown",
        F.struct(
            "filename", "page_count", F.lit(version).alias("version"),
            (F.length("markdown") * 10).cast("bigint").alias("duration_ms"),
            (F.col("page_count") * 3.0).alias("credit_usage"),
        ).alias("metadata"),
        grounding.alias("grounding"),
    )


def flatten_chunks(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk with its 0-based index; documents without chunks give no row."""
    return unnest(parsed, keep, "chunks", "chunk_index", "chunk")


def chunk_rows(
    parsed: DataFrame,
    document: str,
    processed_at: str,
    library_version: str,
    model_version: str,
    image_root: str | None = None,
    *keep: str,
) -> DataFrame:
    """The 19-column retrieval table. Neighbours come from the array itself, so there is no window and no shuffle."""
    neighbours = F.transform(
        "chunks",
        lambda c, i: F.struct(
            c.alias("c"), F.get(F.col("chunks"), i - 1)["id"].alias("prev"), F.get(F.col("chunks"), i + 1)["id"].alias("next")
        ),
    )
    rows = unnest(parsed, [*keep, F.col(document).alias("DOCUMENT_NAME")], neighbours, "n", "w")
    rows = rows.withColumn("clean", text.clean_chunk(F.col("w.c.markdown")))
    page, box = F.col("w.c.grounding.page"), "w.c.grounding.box"
    image = (
        paths.chunk_image_path(image_root, F.col("DOCUMENT_NAME"), page, F.col("w.c.type"), F.col("w.c.id"))
        if image_root
        else F.lit(None).cast("string")
    )
    return rows.select(
        *keep, "DOCUMENT_NAME", F.col("w.c.id").alias("chunk_id"), F.col("n").alias("chunk_sequence_number"),
        F.col("w.c.type").alias("chunk_type"), F.col("w.c.markdown").alias("chunk_content_raw"),
        F.col("clean").alias("chunk_content"), F.length("clean").alias("chunk_text_length"),
        text.word_count(F.col("clean")).alias("chunk_word_count"), page.alias("page"),
        F.col(f"{box}.left").alias("box_l"), F.col(f"{box}.top").alias("box_t"),
        F.col(f"{box}.right").alias("box_r"), F.col(f"{box}.bottom").alias("box_b"),
        F.col("w.prev").alias("prev_chunk_id"), F.col("w.next").alias("next_chunk_id"),
        image.alias("chunk_image_path"), F.lit(processed_at).alias("processed_at"),
        F.lit(library_version).alias("library_version"), F.lit(model_version).alias("model_version"),
    )


def type_counts(chunks: Column) -> Column:
    """Map of chunk type to count, built inside the row."""
    kinds = F.transform(chunks, lambda c: F.coalesce(c["type"], F.lit("unknown")))
    return F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(kinds)),
            lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k))),
        )
    )


def page_total(chunks: Column) -> Column:
    """Highest page plus one; 1 when no chunk has a page or all are on the first."""
    return F.coalesce(F.array_max(F.transform(chunks, lambda c: c["grounding"]["page"])), F.lit(0)) + 1


def document_statistics(parsed: DataFrame, *keep: str) -> DataFrame:
    return parsed.select(
        *keep, F.size("chunks").alias("total_chunks"), type_counts(F.col("chunks")).alias("chunk_types"),
        page_total(F.col("chunks")).alias("total_pages"),
    )


def parse_summary(statistics: DataFrame, name: str, doc_type: Column) -> DataFrame:
    """Six-column summary; missing figures become the defaults."""
    count = lambda kind: F.coalesce(F.try_element_at("chunk_types", F.lit(kind)), F.lit(0))
    return statistics.select(
        paths.last_segment(F.col(name)).alias("File"), F.coalesce(doc_type, F.lit("unknown")).alias("Type"),
        F.coalesce("total_pages", F.lit(1)).alias("Pages"), F.coalesce("total_chunks", F.lit(0)).alias("Chunks"),
        count("table").alias("Tables"), count("figure").alias("Figures"),
    )


def canonical_chunks(new: Column | None = None, old: Column | None = None) -> Column:
    """Both chunk shapes on one struct: page and box come from the first grounding of the older shape."""

    def from_old(c: Column) -> Column:
        g = F.get(c["grounding"], F.lit(0))
        box = F.struct(
            g["box"]["l"].alias("left"), g["box"]["t"].alias("top"), g["box"]["r"].alias("right"),
            g["box"]["b"].alias("bottom"),
        )
        return F.struct(
            c["chunk_id"].alias("id"), c["chunk_type"].alias("type"), c["text"].alias("markdown"),
            F.struct(g["page"].alias("page"), box.alias("box")).alias("grounding"),
        )

    return new if old is None else F.transform(old, from_old) if new is None else F.coalesce(new, F.transform(old, from_old))
