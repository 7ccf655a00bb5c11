"""Where a field came from: references, their chunks and boxes, and rule-based field extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .arrays import unnest

# Drawing colour (red, green, blue) per grounding type.
CHUNK_COLOURS = {
    "chunkText": (40, 167, 69),
    "chunkTable": (0, 123, 255),
    "chunkMarginalia": (111, 66, 193),
    "chunkFigure": (255, 0, 255),
    "chunkLogo": (144, 238, 144),
    "chunkCard": (255, 165, 0),
    "chunkAttestation": (0, 255, 255),
    "chunkScanCode": (255, 193, 7),
    "chunkForm": (220, 20, 60),
    "tableCell": (173, 216, 230),
    "table": (70, 130, 180),
}
DEFAULT_COLOUR = (128, 128, 128)


def grounding_rows(parsed: DataFrame, key: str) -> DataFrame:
    """One row per grounding entry: chunk or table cell, its page, type and box."""
    rows = parsed.select(key, F.explode_outer("grounding").alias("ground_id", "g")).where(F.col("ground_id").isNotNull())
    return rows.select(
        key, "ground_id", F.col("g.page").alias("page"), F.col("g.type").alias("type"),
        *[F.col(f"g.box.{s}").alias(f"box_{s}") for s in ("left", "top", "right", "bottom")],
    )


def on_pages(grounds: DataFrame, pages: DataFrame | int, page: str = "page") -> DataFrame:
    """Groundings of one page, or of the pages listed per document."""
    if isinstance(pages, int):
        return grounds.where(F.col(page) == pages)
    return grounds.join(pages, [c for c in pages.columns], "left_semi")


def colour_rows(spark) -> DataFrame:
    rows = [(name, *rgb) for name, rgb in CHUNK_COLOURS.items()]
    return spark.createDataFrame(rows, "type string, red int, green int, blue int")


def with_colours(grounds: DataFrame, colours: DataFrame) -> DataFrame:
    """Colour per grounding type, grey for unknown types, and the label ``type:id``."""
    joined = grounds.join(F.broadcast(colours), "type", "left")  # one row per entry of CHUNK_COLOURS
    rest = [c for c in grounds.columns if c != "type"]
    return joined.select(
        *rest, "type",
        *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(("red", "green", "blue"), DEFAULT_COLOUR)],
        F.concat_ws(":", "type", "ground_id").alias("label"),
    )


def _placed_references(df: DataFrame, key: str, metadata: str, fields: list[str], grounding: str, first: bool) -> DataFrame:
    """References with their grounding, looked up inside the row before it is unfolded; the map is not copied along."""

    def place(ref: Column) -> Column:
        return F.struct(ref.alias("ground_id"), F.try_element_at(grounding, ref).alias("g"))

    def entry(field: str) -> Column:
        refs = F.col(f"{metadata}.{field}.references")
        chosen = F.slice(refs, 1, 1) if first else refs
        return F.struct(F.lit(field).alias("field"), F.transform(chosen, place).alias("refs"))

    rows = unnest(df, [key], F.array(*[entry(f) for f in fields]), "place", "e")
    placed = unnest(rows, [key, "e.field"], "e.refs", "position", "r")
    return placed.select(key, "field", "position", "r.ground_id", "r.g")


def first_reference_boxes(
    paired: DataFrame, key: str, metadata: str, fields: list[str], first_page: int = 0, grounding: str = "grounding"
) -> DataFrame:
    """Box of each field's first reference, if it is grounded on the document's first page.

    A document's references and its grounding map are in one row, so the lookup needs no join and no shuffle.
    """
    found = _placed_references(paired, key, metadata, fields, grounding, first=True).where(F.col("g.page") == first_page)
    return found.select(
        key, "field", "ground_id", "g.page", "g.type",
        *[F.col(f"g.box.{s}").alias(f"box_{s}") for s in ("left", "top", "right", "bottom")],
    )


def all_references(paired: DataFrame, key: str, metadata: str, fields: list[str], grounding: str = "grounding") -> DataFrame:
    """Every reference of every field; a reference without grounding keeps its row."""
    rows = _placed_references(paired, key, metadata, fields, grounding, first=False)
    return rows.select(key, "field", "position", "ground_id", "g.page", "g.type", "g.box")


def extract_fields(parsed: DataFrame, key: str, rules: dict[str, tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Typed record and provenance from declarative rules ``field -> (pattern with one group, Spark type)``.

    A field takes the first match in chunk order; its references are the ids of all chunks that match. Work stays
    inside the row: no shuffle, whatever the number of rules.
    """
    def matching(pattern: str) -> Column:
        return F.filter("chunks", lambda c: c["markdown"].rlike(pattern))

    # Matches are a projection of their own, so that each pattern runs once per chunk.
    matched = parsed.select(key, *(keep or []), *[matching(p).alias(f"__{f}") for f, (p, _) in rules.items()])
    values, sources = [], []
    for field, (pattern, kind) in rules.items():
        hits = F.col(f"__{field}")
        first = F.regexp_extract(F.get(hits, F.lit(0))["markdown"], pattern, 1)
        value = F.when(F.size(hits) > 0, text.strip(first).try_cast(kind))
        values.append(value.alias(field))
        sources.append(
            F.struct(value.alias("value"), F.transform(hits, lambda c: c["id"]).alias("references")).alias(field)
        )
    return matched.select(
        key, *(keep or []), F.struct(*values).alias("extraction"), F.struct(*sources).alias("extraction_metadata")
    )
