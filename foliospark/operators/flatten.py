"""Schema-driven flattening of nested records and of their provenance, and schema conformance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.values import list_text


def rendered(value: Column, kind: T.DataType) -> Column:
    if kind == T.ArrayType(T.StringType(), True) or kind == T.ArrayType(T.StringType(), False):
        return list_text(value)
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(value) if nested else value.cast("string")


def flat_leaves(record: str, schema: T.StructType, sep: str = "_") -> list[tuple[str, Column]]:
    """Name and value per leaf, nested names joined; text lists print as lists, other arrays and maps as JSON."""

    def walk(path: str, name: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                yield from walk(f"{path}.`{field.name}`", f"{name}{sep}{field.name}" if name else field.name, field.dataType)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            yield name, rendered(F.col(path), kind)
        else:
            yield name, F.col(path)

    return list(walk(record, "", schema))


def flat_columns(record: str, schema: T.StructType, sep: str = "_") -> list[Column]:
    return [value.alias(name) for name, value in flat_leaves(record, schema, sep)]


def provenance_columns(record: str, schema: T.StructType, sep: str = "_", deep: bool = True) -> list[Column]:
    """``<path>_chunks`` per leaf: its references as text; ``deep=False`` looks at the first level only."""

    def walk(path: str, name: str, kind: T.DataType):
        if isinstance(kind, T.StructType):
            if "references" in kind.fieldNames():
                yield rendered(F.col(f"{path}.references"), kind["references"].dataType).alias(f"{name}_chunks")
            elif deep or not name:
                for field in kind.fields:
                    inner = f"{name}{sep}{field.name}" if name else field.name
                    yield from walk(f"{path}.`{field.name}`", inner, field.dataType)
        elif deep:
            yield rendered(F.col(path), kind).alias(f"{name}_chunks")

    return list(walk(record, "", schema))


def struct_of(df: DataFrame, column: str) -> T.StructType:
    return df.select(column).schema.fields[0].dataType


def summary_rows(df: DataFrame, name: str, extraction: str, metadata: str | None = None, deep: bool = True) -> DataFrame:
    columns = flat_columns(extraction, struct_of(df, extraction))
    if metadata:
        columns += provenance_columns(metadata, struct_of(df, metadata), deep=deep)
    return df.select(F.col(name).alias("document_name"), *columns)


def merge_summaries(frames: list[DataFrame]) -> DataFrame:
    """One table over frames of different columns; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_as(df: DataFrame, column: str, schema: T.DataType | str, name: str = "extraction") -> DataFrame:
    """Typed nested column from JSON text; a leaf that does not fit becomes null."""
    return df.withColumn(name, F.from_json(F.col(column), schema))


def read_by_type(df: DataFrame, column: str, type_column: str, registry: dict[str, T.StructType | str]) -> DataFrame:
    """Typed flat rows per document type (case ignored); unknown types keep their row with ``known_type`` false.

    All types are read in one pass: each row is parsed under the schema of its own type only, and a field that
    several types share becomes one column.
    """
    kind = F.lower(F.col(type_column))
    rest = [c for c in df.columns if c != column]
    parsed = {f"__{name}": F.when(kind == name.lower(), F.from_json(column, schema)) for name, schema in registry.items()}
    typed = df.select(*rest, column, *[c.alias(n) for n, c in parsed.items()])
    by_name: dict[str, list[str]] = {}
    flat = []
    for place, source in enumerate(parsed):
        for i, (name, leaf) in enumerate(flat_leaves(source, struct_of(typed, source))):
            flat.append(leaf.alias(f"__{place}_{i}"))
            by_name.setdefault(name, []).append(f"__{place}_{i}")
    known = F.coalesce(kind.isin(*[n.lower() for n in registry]), F.lit(False))
    rows = typed.select(*rest, known.alias("known_type"), *flat)
    types = dict(rows.dtypes)

    def merged(parts: list[str]) -> Column:
        """One column for a field of several types: a common type stays, different ones become text."""
        if len({types[p] for p in parts}) == 1:
            return F.coalesce(*parts)
        simple = lambda p: F.to_json(p) if types[p].startswith(("struct", "array", "map")) else F.col(p).cast("string")
        return F.coalesce(*[simple(p) for p in parts])

    return rows.select(*rest, "known_type", *[merged(parts).alias(n) for n, parts in by_name.items()])


_JSON_TYPES = {
    "string": ("STRING",),
    "number": ("DOUBLE", "BIGINT", "DECIMAL", "FLOAT"),
    "integer": ("BIGINT",),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT", "STRUCT"),
    "array": ("ARRAY",),
}


_LISTS = "array<variant>"


def _step(name: str) -> str:
    """A field's step in a path; names that are no plain identifiers, such as those with dots, are quoted."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        return f".{name}"
    return f"['{name}']" if '"' in name else f'["{name}"]'


def _of_type(wanted, value: Column, kind: Column) -> Column:
    """Whether a value has one of the wanted JSON types: null only where it is named, whole decimals are integers."""
    wanted = wanted if isinstance(wanted, list) else [wanted]
    hits = [kind.startswith(n) for w in wanted for n in _JSON_TYPES.get(w, ())]
    if "null" in wanted:
        hits.append(kind == "VOID")
    if "integer" in wanted and "number" not in wanted:
        decimal = kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
        hits.append(decimal & (F.try_variant_get(value, "$", "double") % 1 == 0))
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _compact(found: list[Column]) -> Column:
    # Unlike array_compact this stays in generated code, where the repeated variant reads are shared.
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))


def violations(doc: Column, schema: dict) -> Column:
    """Array of texts, one per broken rule of a JSON Schema, for a VARIANT document; the row itself is kept.

    The rules inside an object hold where it is one: an absent optional object breaks none. Items of arrays, and of arrays in
    them, are checked one by one, and each broken rule of an array (``name[]``, ``name[][]``) is told once. A null breaks the
    type of its field unless that names ``null``; in a required field it counts as missing instead.
    """
    none = F.array().cast("array<string>")

    def of_items(value: Column, node: dict, label: str) -> Column:
        """Broken rules of the items of an array; none for another value."""
        each = F.transform(F.try_variant_get(value, "$", _LISTS), lambda item: of_value(item, node, label))
        return F.coalesce(F.array_distinct(F.flatten(each)), none)

    def of_value(item: Column, node: dict, label: str) -> Column:
        """Broken rules of one item; an item that is null in JSON reaches this as SQL null or a null variant."""
        kind = F.coalesce(F.schema_of_variant(item), F.lit("VOID"))
        found: list[Column] = []
        if node.get("type"):
            found.append(F.when(~F.coalesce(_of_type(node["type"], item, kind), F.lit(False)), f"{label}: type"))
        if "enum" in node:
            plain = F.try_variant_get(item, "$", "string")
            found.append(F.when(plain.isNotNull() & ~plain.isin(*node["enum"]), f"{label}: enum"))
        broken = [_compact(found)] if found else []
        if node.get("properties") or node.get("required") or node.get("additionalProperties") is False:
            inner = F.transform(violations(item, node), lambda text: F.concat(F.lit(f"{label}."), text))
            broken.append(F.when(kind.startswith("OBJECT") | kind.startswith("STRUCT"), inner).otherwise(none))
        if node.get("items"):
            broken.append(of_items(item, node["items"], f"{label}[]"))
        return F.concat(*broken) if broken else none

    def rules(node: dict, at: str, prefix: str, whole: Column) -> list[Column]:
        out: list[Column] = []
        fields = node.get("properties", {})
        required = set(node.get("required", []))
        for name in [*fields, *sorted(required - set(fields))]:
            sub = fields.get(name, {})
            where, label = at + _step(name), prefix + name
            value = F.try_variant_get(doc, where, "variant")
            kind = F.schema_of_variant(value)
            wanted = sub.get("type")
            null = F.is_variant_null(value)
            absent = value.isNull() if wanted and "null" in wanted else value.isNull() | null
            if name in required:
                out.append(F.when(absent, f"{label}: required"))
            if wanted:
                judged = ~absent if name in required else value.isNotNull()
                out.append(F.when(judged & ~_of_type(wanted, value, kind), f"{label}: type"))
            if "enum" in sub:
                plain = F.try_variant_get(doc, where, "string")
                out.append(F.when(plain.isNotNull() & ~plain.isin(*sub["enum"]), f"{label}: enum"))
            if sub.get("properties") or sub.get("required") or sub.get("additionalProperties") is False:
                there = kind.startswith("OBJECT") | kind.startswith("STRUCT")
                out.extend(F.when(there, rule) for rule in rules(sub, where, f"{label}.", value))
            if sub.get("items"):
                lists.append(of_items(value, sub["items"], f"{label}[]"))
        if node.get("additionalProperties") is False:
            keys = F.json_object_keys(F.to_json(whole))
            extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in fields]).cast("array<string>")))
            out.append(F.when(F.size(extra) > 0, F.concat(F.lit(prefix), F.array_join(extra, ","), F.lit(": not allowed"))))
        return out

    lists: list[Column] = []
    own = _compact(rules(schema, "$", "", doc))
    return F.concat(own, *lists) if lists else own


def schema_from(document: dict) -> T.StructType:
    return schemas.spark_type(document)
