"""Invoice tables: the flat main row, line items, rendered summaries, the four-table job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths, values
from .arrays import unnest

KEYS = ("RUN_ID", "INVOICE_UUID", "DOCUMENT_NAME", "PARSER_VERSION")
ITEM_FIELDS = ("line_number", "sku", "description", "quantity", "unit_price", "price", "amount", "total")


def stamp_keys(df: DataFrame, run_id: str, document: Column, version: Column, identity: Column | None = None) -> DataFrame:
    """Four leading key columns; the document key is a digest of ``identity`` (else of the name), so a rerun gives the same keys."""
    identity = document if identity is None else identity
    return df.select(
        F.lit(run_id).alias("RUN_ID"), F.sha2(identity, 256).alias("INVOICE_UUID"), document.alias("DOCUMENT_NAME"),
        version.alias("PARSER_VERSION"), "*",
    )


def main_rows(keyed: DataFrame, extraction: str = "extraction") -> DataFrame:
    """31 columns: four keys and every header field, in upper case."""
    fields = [
        F.col(f"{extraction}.{section}.{entry.split()[0]}").alias(entry.split()[0].upper())
        for section, entries in schemas.INVOICE_SECTIONS.items()
        for entry in entries.split(", ")
    ]
    return keyed.select(*KEYS, *fields)


def item_rows(keyed: DataFrame, extraction: str = "extraction") -> DataFrame:
    """One row per line item with its 0-based index; records without items give none."""
    rows = unnest(keyed, KEYS, f"{extraction}.line_items", "LINE_INDEX", "item")
    return rows.select(*KEYS, "LINE_INDEX", *[F.col(f"item.{f}").alias(f.upper()) for f in ITEM_FIELDS])


def markdown_rows(keyed: DataFrame) -> DataFrame:
    return keyed.select(*KEYS, F.col("markdown").alias("MARKDOWN"))


def parsed_chunk_rows(keyed: DataFrame) -> DataFrame:
    rows = unnest(keyed, KEYS[:3], "chunks", "position", "c")
    box = "c.grounding.box"
    return rows.select(
        *KEYS[:3], F.col("c.id").alias("chunk_id"), F.col("c.type").alias("chunk_type"), F.col("c.markdown").alias("text"),
        F.col("c.grounding.page").alias("page"), F.col(f"{box}.left").alias("box_l"), F.col(f"{box}.top").alias("box_t"),
        F.col(f"{box}.right").alias("box_r"), F.col(f"{box}.bottom").alias("box_b"),
    )


def pair_results(parsed: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Parse and extract result of the same document; a document missing on either side drops."""
    return parsed.join(extracted, key)


def invoice_tables(paired: DataFrame, run_id: str, key: str) -> dict[str, DataFrame]:
    """Four tables over one parent with ``chunks, markdown, metadata, extraction``.

    A document without a name is identified by ``key``, so that no two of them share their rows.
    """
    name = F.col("metadata.filename")
    keyed = stamp_keys(
        paired, run_id, F.coalesce(name, F.lit("unknown")), F.coalesce("metadata.version", F.lit("unknown")),
        F.coalesce(name, F.concat_ws("/", F.lit(run_id), F.col(key).cast("string"))),
    )
    return {
        "markdown": markdown_rows(keyed),
        "parsed_chunks": parsed_chunk_rows(keyed),
        "invoices_main": main_rows(keyed),
        "invoice_line_items": item_rows(keyed),
    }


def invoice_summary(docs: DataFrame, doc: str, name: Column) -> DataFrame:
    """Eleven rendered columns from a VARIANT extraction: defaults only where a key is absent."""
    v = F.col(doc)
    pick = lambda path, kind, default: values.variant_default(v, path, kind, default)
    money = lambda path: values.money_text(pick(path, "double", 0.0))
    items = F.size(F.try_variant_get(v, "$.line_items", "array<variant>"))
    return docs.select(
        paths.last_segment(name).alias("File"),
        pick("$.invoice_info.invoice_number", "string", "-").alias("Invoice #"),
        pick("$.invoice_info.invoice_date", "string", "-").alias("Date"),
        pick("$.customer_info.sold_to_name", "string", "-").alias("Customer"),
        pick("$.company_info.supplier_name", "string", "-").alias("Supplier"),
        money("$.totals_summary.subtotal").alias("Subtotal"),
        money("$.totals_summary.tax").alias("Tax"),
        money("$.totals_summary.total_due").alias("Total"),
        pick("$.totals_summary.currency", "string", "USD").alias("Currency"),
        F.greatest(F.coalesce(items, F.lit(0)), F.lit(0)).alias("Line Items"),
        pick("$.invoice_info.status", "string", "N/A").alias("Status"),
    )


def totals(rows: DataFrame, amount: str, customer: str, supplier: str, per: list[str] | None = None,
           drop_empty_names: bool = True) -> DataFrame:
    """Row count, exact sum and distinct names. Null amounts are skipped; empty names count only on request."""
    named = lambda c: F.when(F.col(c) != "", F.col(c)) if drop_empty_names else F.col(c)
    measures = [
        F.count(F.lit(1)).alias("total_invoices"),
        F.coalesce(F.sum(values.exact(F.col(amount))), F.lit(0)).alias("total_value"),
        F.countDistinct(named(customer)).alias("unique_customers"),
        F.countDistinct(named(supplier)).alias("unique_suppliers"),
    ]
    return rows.groupBy(*per).agg(*measures) if per else rows.agg(*measures)


def product_summary(docs: DataFrame, name: str, doc: str, meta: str) -> DataFrame:
    """Fixed 32-column product table from VARIANT records; a record without one of the fields is an error.

    Each record is read once, into one struct that all columns are taken from; a getter for every column would search the
    record anew and make a method too long for the JVM to compile.
    """
    kinds = {**{n: "string" for n in schemas.PRODUCT_TEXT}, **schemas.PRODUCT_NUMBERS,
             **{n: "boolean" for n in schemas.PRODUCT_FLAGS}}
    order = ["product_name", "brand", "net_weight_oz", "net_weight_g", "servings_per_container", "serving_size",
             "product_type", "flavor", *schemas.PRODUCT_FLAGS]
    keys = F.coalesce(F.map_keys(F.try_variant_get(F.col(doc), "$", "map<string, variant>")), F.array().cast("array<string>"))
    kind = "struct<" + ", ".join(f"{n}: {kinds[n]}" for n in order) + ">"
    sources = "struct<" + ", ".join(f"{n}: struct<references: array<string>>" for n in schemas.PRODUCT_PROVENANCE) + ">"
    read = docs.select(
        F.col(name).alias("document_name"), F.try_variant_get(F.col(doc), "$", kind).alias("__record"),
        F.get(F.array_except(F.array(*[F.lit(n) for n in order]), keys), F.lit(0)).alias("__missing"),
        F.try_variant_get(F.col(meta), "$", sources).alias("__sources"),
    )
    missing = F.raise_error(F.concat(F.lit("record has no field "), F.col("__missing"))).cast(kind)
    whole = read.withColumn("__record", F.when(F.col("__missing").isNull(), F.col("__record")).otherwise(missing))
    columns = [F.col("document_name")]
    for field in order:
        columns.append(F.col(f"__record.{field}"))
        if field in schemas.PRODUCT_PROVENANCE:
            columns.append(F.coalesce(values.list_text(F.col(f"__sources.{field}.references")), F.lit("[]")).alias(f"{field}_chunks"))
    return whole.select(*columns)
