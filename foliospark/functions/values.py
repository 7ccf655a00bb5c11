"""Scalar columns: money, dates, defaults, identifiers, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_text(amount: Column) -> Column:
    """``$1,234.56``; a dash for null or zero."""
    return F.when(amount.isNull() | (amount == 0), F.lit("-")).otherwise(
        F.concat(F.lit("$"), F.format_number(amount, 2))
    )


def money_value(text: Column) -> Column:
    """Amount of a rendered price; null when nothing numeric is left."""
    return F.regexp_replace(text, "[$,]", "").try_cast("decimal(18,2)")


def exact(amount: Column) -> Column:
    """Money as a decimal, so that sums do not depend on the order of rows."""
    return amount.cast("decimal(18,2)")


def lenient_date(text: Column, *patterns: str) -> Column:
    """First pattern that reads the text wins; null when none does."""
    return F.coalesce(*[F.try_to_date(text, p) for p in (patterns or ("yyyy-MM-dd",))])


def list_text(items: Column) -> Column:
    """Array of texts as one text, ``['a', 'b']``, quoted the way Python prints a list."""

    def quoted(item: Column) -> Column:
        plain = item
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            plain = F.replace(plain, F.lit(raw), F.lit(shown))
        single, double = item.contains("'"), item.contains('"')
        text = F.when(single & ~double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )
        return F.coalesce(text, F.lit("None"))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def variant_text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def variant_default(doc: Column, path: str, kind: str, default) -> Column:
    """Value at ``path``; the default only where the key is absent. A JSON null stays null."""
    node = F.try_variant_get(doc, path, "variant")
    return F.when(node.isNull(), F.lit(default).cast(kind)).otherwise(F.try_variant_get(doc, path, kind))


def zero_pad(text: Column, width: int = 10) -> Column:
    """Left-pad with zeros and never cut (``lpad`` alone would)."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def mask_account(number: Column) -> Column:
    n = F.length(number)
    masked = F.concat(F.left(number, F.lit(4)), F.repeat(F.lit("X"), n - 8), F.right(number, F.lit(4)))
    return F.when(n > 8, masked).otherwise(F.repeat(F.lit("X"), F.lit(12)))


def is_truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1", "yes"), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def document_url(accession: Column, document: Column, company: Column | None = None) -> Column:
    """Archive address of a filing. Without ``company`` its first ten digits stand in for the company id."""
    clean = F.replace(accession, F.lit("-"), F.lit(""))
    owner = F.left(clean, F.lit(10)) if company is None else company
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), owner, F.lit("/"), clean, F.lit("/"), document)


def filing_pdf_name(accession: Column, document: Column) -> Column:
    return F.concat(accession, F.lit("_"), F.replace(document, F.lit(".htm"), F.lit(".pdf")))


def document_name(candidates: list[Column], position: Column | None = None) -> Column:
    """First known name, cut to its last path segment; else ``doc_<position + 1>``."""
    named = F.substring_index(F.coalesce(*candidates), "/", -1)
    if position is None:
        return named
    return F.coalesce(named, F.concat(F.lit("doc_"), (position + 1).cast("string")))


def failure_status(message: Column, key_pattern: str = "API_KEY") -> tuple[Column, Column]:
    """``(status code, error type)`` of a failed run, from the text of its error."""
    bad_input = message.rlike(r"^(ValueError|No bucket_name)")
    missing_module = message.rlike(r"^(ImportError|ModuleNotFoundError|No module named)")
    no_key = message.contains(key_pattern)
    code = F.when(bad_input, 400).when(missing_module, 500).when(no_key, 401).otherwise(500)
    kind = (
        F.when(bad_input, "configuration_error")
        .when(missing_module, "import_error")
        .when(no_key, "authentication_error")
        .otherwise("unexpected_error")
    )
    return code.cast("bigint"), kind


def failure_hint(message: Column) -> Column:
    """Label that goes to the log for two known causes; it does not change the status."""
    return F.when(message.contains("402 Payment Required"), "quota").when(
        message.contains("exceeds the maximum of 50 pages"), "page_limit"
    )
