"""Declared schemas of the records read here, and the reader of JSON Schema documents."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = "struct<left double, top double, right double, bottom double>"
GROUND = f"struct<page int, type string, box {BOX}>"
CHUNK = f"struct<id string, type string, markdown string, grounding struct<page int, box {BOX}>>"
OLD_CHUNK = (
    "struct<text string, chunk_type string, chunk_id string, "
    "grounding array<struct<page int, box struct<l double, t double, r double, b double>>>>"
)
PARSE_METADATA = (
    "struct<credit_usage double, duration_ms bigint, filename string, job_id string, org_id string, "
    "page_count int, version string, failed_pages array<int>>"
)
PARSE_RESPONSE = (
    f"chunks array<{CHUNK}>, markdown string, metadata {PARSE_METADATA}, "
    "splits array<struct<chunks array<string>, `class` string, identifier string, markdown string, pages array<int>>>, "
    f"grounding map<string, {GROUND}>"
)

INVOICE_SECTIONS = {
    "invoice_info": "invoice_date_raw string, invoice_date date, invoice_number string, order_date string, "
    "po_number string, status string",
    "customer_info": "sold_to_name string, sold_to_address string, customer_email string",
    "company_info": "supplier_name string, supplier_address string, representative string, email string, "
    "phone string, gstin string, pan string",
    "order_details": "payment_terms string, ship_via string, ship_date string, tracking_number string",
    "totals_summary": "currency string, total_due_raw string, total_due double, subtotal double, tax double, "
    "shipping double, handling_fee double",
}
LINE_ITEM = (
    "struct<line_number string, sku string, description string, quantity double, unit_price double, "
    "price double, amount double, total double>"
)
INVOICE_HEADER = ", ".join(f"{name} struct<{fields}>" for name, fields in INVOICE_SECTIONS.items())
INVOICE_ITEMS = f"line_items array<{LINE_ITEM}>"
INVOICE = f"{INVOICE_HEADER}, {INVOICE_ITEMS}"

PURCHASE_ORDER = (
    "po_number string, po_date date, vendor_name string, ship_to_address string, total_amount double, "
    "line_items array<struct<description string, quantity double, unit_price double, amount double>>"
)
RECEIPT = (
    "store_name string, transaction_date date, transaction_time string, total_amount double, payment_method string, "
    "items array<struct<description string, quantity double, unit_price double, amount double>>"
)
FLAT_INVOICE_COLUMNS = (
    "source_file", "invoice_number", "invoice_date", "customer", "supplier", "subtotal", "tax", "total",
    "currency", "line_items_count", "status",
)

CERTIFICATE = (
    "recipient_name string, issuing_org string, activity_title string, date_awarded date, credit_awarded string, "
    "credit_numeric double, ama_pra_cat1 boolean, ama_pra_cat2 boolean"
)

# The product record, in the order of the summary table.
PRODUCT_TEXT = ("product_name", "brand", "product_type", "flavor", "serving_size")
PRODUCT_NUMBERS = {"net_weight_oz": "double", "net_weight_g": "double", "servings_per_container": "bigint"}
PRODUCT_FLAGS = (
    "is_grass_fed", "is_organic", "is_keto_friendly", "is_paleo_friendly", "is_kosher", "is_regenerative",
    "is_certified_humane", "is_animal_welfare_certified", "is_pasture_raised", "is_non_gmo", "is_gluten_free",
    "is_dairy_free", "is_lactose_free", "is_whole30_approved", "has_no_added_sugar", "no_antibiotics",
    "no_hormones", "no_animal_byproducts", "usda_inspected",
)
PRODUCT_PROVENANCE = ("product_name", "brand", "net_weight_oz", "usda_inspected")

OBJECT_EVENT = "Records array<struct<s3 struct<bucket struct<name string>, object struct<key string>>>>"
ENVELOPE_HEAD = (
    "processed_at string, trigger_type string, bucket string, prefix string, specific_file string, parsed_count bigint"
)
FILING_INDEX = (
    "struct<form array<string>, filingDate array<string>, accessionNumber array<string>, "
    "primaryDocument array<string>, fileNumber array<string>, description array<string>>"
)
JOB_STATUS = (
    "job_id string, status string, progress double, data struct<markdown string>, output_url string, "
    "failure_reason string, metadata struct<page_count int, duration_ms bigint, credit_usage double>"
)

_SIMPLE = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def spark_type(node: dict, definitions: dict | None = None) -> T.DataType:
    """Spark type of a JSON Schema node; date formats become dates, unions with null their other branch."""
    definitions = definitions or node.get("$defs") or node.get("definitions") or {}
    if "$ref" in node:
        return spark_type(definitions[node["$ref"].rsplit("/", 1)[-1]], definitions)
    for union in ("anyOf", "oneOf"):
        branches = [b for b in node.get(union, []) if b.get("type") != "null"]
        if branches:
            return spark_type(branches[0], definitions)
    kind = node.get("type", "string")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "string")
    if kind == "object":
        fields = node.get("properties", {})
        return T.StructType([T.StructField(name, spark_type(sub, definitions)) for name, sub in fields.items()])
    if kind == "array":
        return T.ArrayType(spark_type(node.get("items", {}), definitions))
    if kind == "string" and node.get("format") == "date":
        return T.DateType()
    return _SIMPLE[kind]
