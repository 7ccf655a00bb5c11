"""Joins that keep working when a join key is very frequent on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Keys above ``rows_per_task`` rows with the number of salts each needs.

    There are at most as many as the rows divided by ``rows_per_task``: half a million for 10^12 rows.
    """
    counts = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).count()
    heavy = counts.where(F.col("count") > rows_per_task)
    return heavy.select(*keys, F.ceil(F.col("count") / rows_per_task).cast("int").alias("__salts"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Join a large ``left`` to ``right``; rows of heavy left keys go to several tasks, their right rows to each.

    Heavy keys are counted first; without any the join is a plain one, planned by Spark. The salt is a hash of
    ``spread_by`` (the left row's own identity), so a recomputed task gives the same rows.
    """
    found = heavy_keys(left, keys, rows_per_task)
    rows = found.collect()  # one row for every ``rows_per_task`` rows at most
    if not rows:
        return left.join(right, keys, how)
    heavy = F.broadcast(left.sparkSession.createDataFrame(rows, found.schema))
    spread_by = spread_by or [c for c in left.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*spread_by), F.col("__salts").cast("bigint"))
    salted_left = left.join(heavy, keys, "left").withColumn("__salt", F.coalesce(salt, F.lit(0)).cast("bigint"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__salts"), F.lit(1)).cast("bigint") - 1)
    salted_right = right.join(heavy, keys, "left").withColumn("__salt", F.explode(copies))
    return salted_left.drop("__salts").join(salted_right.drop("__salts"), [*keys, "__salt"], how).drop("__salt")


def sized_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most_rows: int = 200_000, **spread
) -> DataFrame:
    """Broadcast ``right`` when a count shows at most ``most_rows`` rows, else ``spread_join``."""
    if right.limit(most_rows + 1).count() <= most_rows:
        return left.join(F.broadcast(right), keys, how)
    return spread_join(left, right, keys, how, **spread)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the result has the columns of ``left`` and the other ones of ``right``."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    meet = [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]
    return left.join(renamed, meet, how).drop(*[f"__right_{k}" for k in keys])


def left_join_spreading_nulls(left: DataFrame, right: DataFrame, key: str, tasks: int = 4096) -> DataFrame:
    """Left join in which the rows without a key, which match nothing, do not all meet in one task."""
    plain = [f"`{c}`" for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*plain), F.lit(tasks).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    other = right.withColumn("__spread", F.lit(0).cast("bigint"))
    return left.withColumn("__spread", spread).join(other, [key, "__spread"], "left").drop("__spread")


def seen_before(done: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``work`` that are in ``done``. A short work list is broadcast, so the long table is scanned in place."""
    return sized_join(done.select(*keys), work.select(*keys).distinct(), keys, "left_semi").distinct()


def _marking_join(work: DataFrame, done: DataFrame, keys: list[str], how: str, unique: bool, spread: dict) -> DataFrame:
    """Join on keys that are unique on the right; unique left keys cannot be heavy and need no salt."""
    return work.join(done, keys, how) if unique else spread_join(work, done, keys, how, **spread)


def not_yet_done(work: DataFrame, done: DataFrame, keys: list[str], unique: bool = False, **spread) -> DataFrame:
    """Rows of ``work`` whose key is not in ``done``; ``unique`` says that ``work`` has each key once."""
    return _marking_join(work, done.select(*keys).distinct(), keys, "left_anti", unique, spread)


def with_status(
    work: DataFrame, done: DataFrame, keys: list[str], force: bool = False, unique: bool = False, **spread
) -> DataFrame:
    """Mark each row ``skipped`` when its key is already done (never under ``force``), else ``pending``."""
    if force:
        return work.withColumn("status", F.lit("pending"))
    seen = done.select(*keys).distinct().withColumn("__seen", F.lit(True))
    marked = _marking_join(work, seen, keys, "left", unique, spread)
    return marked.withColumn("status", F.when(F.col("__seen"), "skipped").otherwise("pending")).drop("__seen")
