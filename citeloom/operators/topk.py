"""Best rows per group without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int, tie: str, salts: int = 32, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in order, numbered from 1.

    Groups are first divided by a hash of the tie-breaking column and cut to k rows per part, so the second window sees
    at most k * salts rows of a group however large it is. order must end in a unique column. Null keys form a group.
    """
    part = F.pmod(F.xxhash64(tie), F.lit(salts))
    first = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_n") <= k)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k).drop("_part", "_n")


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], rank: str = "rank") -> DataFrame:
    """All rows with their place in their group, from 1, without a task that holds a group: a global sort, then positions.

    A row's place is its position in the sort less that of its group's first row. order must end in a unique column for a
    certain result. Only counts of sort partitions are sent to all tasks.
    """
    sorted_ = cut(rows.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    placed = sorted_.withColumn("_part", part).join(offsets, "_part").withColumn("_pos", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if not keys:
        return placed.withColumn(rank, F.col("_pos") + 1).drop("_at", "_part", "_before", "_pos")
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = placed.alias("a").join(first.alias("b"), same)
    return both.select("a.*", (F.col("_pos") - F.col("_first") + 1).alias(rank)).drop("_at", "_part", "_before", "_pos")


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by the order columns, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")
