"""Ordered operators that stay spread out when one group holds much of the data.

A window over ``partitionBy(group)`` hands a whole group to one task. Here the largest group is measured first;
only if it exceeds ``rows_per_task`` are the rows sorted into ranges of group and order, numbered inside each range,
and shifted by the totals of the group's earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .joins import null_safe_join

ROWS_PER_TASK = 2_000_000
_RANGE = "__range"


def largest_group(df: DataFrame, group: list[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def in_ranges(df: DataFrame, group: list[str], order: list[str], order_value: Column) -> DataFrame:
    """Rows dealt by ranges of group, order value and the whole order, each with its range's number ``__range``.

    A group of any size, even one of a single order value, fills as many ranges as its share of the rows asks for. Rows
    are kept by a checkpoint, so that a lost task finds the same ranges again.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *[F.col(c) for c in group], order_value, *order)
    return durable(dealt.withColumn(_RANGE, F.spark_partition_id()))


def _shifted(local: DataFrame, group: list[str], name: str, amount: Column) -> DataFrame:
    """Add to ``name`` what the group's earlier ranges hold of ``amount``."""
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    held = local.groupBy(*group, _RANGE).agg(F.sum(amount).alias("__held"))
    shifts = held.select(*group, _RANGE, F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__shift"))
    joined = null_safe_join(local, shifts, [*group, _RANGE])
    return joined.withColumn(name, F.col(name) + F.col("__shift")).drop(_RANGE, "__shift")


def row_index(
    df: DataFrame,
    group: list[str],
    order: list[str],
    order_value: Column,
    name: str = "row_index",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """0-based position of each row in its group. ``order`` must be total, ``order_value`` its leading number."""
    if largest_group(df, group) <= rows_per_task:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    cut = in_ranges(df, group, order, order_value)
    local = cut.withColumn(name, F.row_number().over(Window.partitionBy(*group, _RANGE).orderBy(*order)) - 1)
    return _shifted(local, group, name, F.lit(1))


def total_before(
    df: DataFrame,
    group: list[str],
    order: list[str],
    order_value: Column,
    amount: Column,
    name: str = "total_before",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sum of a whole-numbered ``amount`` over the earlier rows of each row's group; 0 for the first one."""

    def running(scope: list[str]) -> Column:
        earlier = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("__amount").over(earlier), F.lit(0)).cast("bigint")

    df = df.withColumn("__amount", amount.cast("bigint"))
    if largest_group(df, group) <= rows_per_task:
        return df.withColumn(name, running(group)).drop("__amount")
    cut = in_ranges(df, group, order, order_value)
    return _shifted(cut.withColumn(name, running([*group, _RANGE])), group, name, F.col("__amount")).drop("__amount")


def part_numbers(
    df: DataFrame,
    group: list[str],
    order: list[str],
    order_value: Column,
    size: Column,
    bytes_per_part: int,
    rows_per_part: int,
    name: str = "part",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number of the part that each row of an ordered group falls in, from 0 and never falling.

    A part starts at most ``rows_per_part`` rows, and rows of fewer than ``bytes_per_part`` bytes before its last one; it
    exceeds this by its last row at most. Behind a row larger than a part numbers are left out. A null size counts as 0.
    """
    weight = F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(-(-bytes_per_part // rows_per_part)).cast("bigint"))
    placed = total_before(df, group, order, order_value, weight, "__before", rows_per_task)
    return placed.withColumn(name, F.floor(F.col("__before") / F.lit(bytes_per_part)).cast("bigint")).drop("__before")


def run_numbers(
    df: DataFrame,
    group: list[str],
    order: list[str],
    order_value: Column,
    value: str,
    name: str = "run",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number the runs of equal ``value`` in each ordered group, from 1; rows without a value only break runs."""
    plain = largest_group(df, group) <= rows_per_task
    cut = df if plain else in_ranges(df, group, order, order_value)
    scope = group if plain else [*group, _RANGE]
    ordered = Window.partitionBy(*scope).orderBy(*order)
    previous = F.lag(value).over(ordered)
    starts = F.col(value).isNotNull() & (previous.isNull() | (previous != F.col(value)))
    numbered = cut.withColumn("__starts", starts.cast("bigint")).withColumn(
        name, F.sum("__starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    if not plain:
        rank = F.struct(*order)
        pieces = cut.groupBy(*group, _RANGE).agg(
            F.min_by(F.struct(value), rank)[value].alias("__first"),
            F.max_by(F.struct(value), rank)[value].alias("__last"),
        )
        counts = numbered.groupBy(*group, _RANGE).agg(F.max(name).alias("__runs"))
        by_range = Window.partitionBy(*group).orderBy(_RANGE)
        joins_up = F.coalesce((F.col("__first") == F.lag("__last").over(by_range)).cast("bigint"), F.lit(0))
        before = by_range.rowsBetween(Window.unboundedPreceding, -1)
        shifts = (
            null_safe_join(pieces, counts, [*group, _RANGE])
            .withColumn("__joins", joins_up)
            .withColumn(
                "__shift",
                F.coalesce(F.sum("__runs").over(before), F.lit(0))
                - F.sum("__joins").over(by_range.rowsBetween(Window.unboundedPreceding, 0)),
            )
            .select(*group, _RANGE, "__shift")
        )
        numbered = (
            null_safe_join(numbered, shifts, [*group, _RANGE])
            .withColumn(name, F.col(name) + F.col("__shift"))
            .drop(_RANGE, "__shift")
        )
    return numbered.where(F.col(value).isNotNull()).drop("__starts")


def first_rows(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. For ``n`` below 1,000 Spark keeps ``n`` rows per group and task before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= n)


def latest_row(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Row with the greatest order value per group, as a partial aggregate instead of a window."""
    rest = [c for c in df.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    grouped = df.groupBy(*group).agg(best) if group else df.agg(best)
    return grouped.where(F.col("__row").isNotNull()).select(*group, "__row.*")


def joined_text(
    df: DataFrame, keys: list[str], order: str, text: str, name: str = "markdown", rows_per_part: int = 1000,
    bytes_per_part: int = 8 << 20, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ordered texts with a blank line between them, null positions first, equal ones by text; null texts are left out.

    A result is cut into parts of at most ``rows_per_part`` texts and ``bytes_per_part`` UTF-8 bytes and one text more (see
    ``part_numbers``), so no cell and no task collects an unbounded group and a short result is one part; joining the parts in
    order gives the whole text.
    """
    size = F.octet_length(text) + 2
    placed = part_numbers(df, keys, [order, text], F.col(order), size, bytes_per_part, rows_per_part, "part", rows_per_task)
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).isNotNull().alias("n"), F.col(order).alias("o"), F.col(text).alias("t"))))
    return (
        placed.groupBy(*keys, "part")
        .agg(pieces.alias("__pieces"))
        .select(*keys, "part", F.array_join(F.transform("__pieces", lambda p: p["t"]), "\n\n").alias(name))
    )
