"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import durable


def _beside_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``edges`` with the minimum ``m`` of their node ``u``; ``least`` has ``u``, ``m`` and the number ``n`` of links it was taken over.

    A node of more than ``most`` links is dealt to several tasks by its other ends, its one row of ``least`` to each. There are no more
    such nodes than the links divided by ``most``, which bounds what is broadcast.
    """
    parts = F.ceil(F.col("n") / most)
    hubs = least.where(F.col("n") > most).select("u", parts.alias("parts"))
    dealt = edges.join(F.broadcast(hubs), "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), "parts"), F.lit(0).cast("bigint")))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    return dealt.drop("parts").join(copies, ["u", "part"]).select("u", "v", "m")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node links its larger neighbours to the least node that it sees."""
    both = edges.union(edges.select("v", "u"))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    return _beside_least(both.where("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them; ``u > v`` in every row."""
    least = _least(edges)
    moved = _beside_least(edges, least, most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60, least_hub: int = 256) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``u``, ``v``, bigint): the least node that can be reached.

    Rows with a null end and loops are ignored; repeated links count once; no link gives no row. Every round is
    written to the shared folder, and the links never leave the executors. A round's minima are combined before the
    shuffle, and a node with more links than a task has on average (``least_hub`` at least) is dealt to several tasks.
    """
    clean = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    current = durable(clean.distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(current)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(most_rounds):
        most = max(least_hub, before[0] // tasks)
        current = durable(_small_star(_large_star(current, most), most))
        after = mark(current)
        if after == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
