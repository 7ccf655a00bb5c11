"""Arrays to rows.

The optimizer copies a computed array into a size check below an inner ``explode``, which evaluates costly text work
twice (and, with the array inlined into a lambda, once per element). The outer form plus a filter on the generated
position avoids that and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep, array, position: str, element: str) -> DataFrame:
    """Array elements as rows with their 0-based position; null and empty arrays give none."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, element))
    return rows.where(F.col(position).isNotNull())


def unnest_fields(df: DataFrame, keep, array, first: str) -> DataFrame:
    """Array of structs as columns; ``first`` names a field that is never null."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(first).isNotNull())
