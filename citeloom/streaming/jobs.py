"""Folds of event streams: job states, throttles, budgets and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_states(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The state each job ended in; jobs left active count as failed and can be retried."""
    last = events.groupBy(key).agg(F.max(F.struct(*order, state)).alias("m")).select(key, F.col(f"m.{state}").alias("state"))
    return last.select(key, F.when(F.col("state").isin("queued", "active", "running"), "failed").otherwise(F.col("state")).alias("state"), F.col("state").isin("queued", "active", "running").alias("retryable"))


def throttled(events: DataFrame, key: str, at: str, order: str, seconds: int) -> DataFrame:
    """At most one event per key and interval of time, the last of each: latest wins."""
    slot = F.floor(F.unix_timestamp(at) / seconds).alias("slot")
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key, slot).agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("r")).select(key, "r.*")


def within_budget(events: DataFrame, group: str, order: list[str], cost: str, budget: float, parts: int = 64) -> DataFrame:
    """Events whose running total of their group, in order, is still within the budget before them.

    Running sums in two levels: time is divided into ranges, their totals are summed first (few rows), and each range
    then sums its own events from its start, so a group of any size is spread over the ranges.
    """
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    bounds = events.groupBy(group).agg(F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    rows = events.join(bounds, group).withColumn("_part", F.floor((micros - F.col("_lo")) * parts / (F.col("_hi") - F.col("_lo") + 1)))
    totals = rows.groupBy(group, "_part").agg(F.sum(cost).alias("_sum"))
    before = totals.select(group, "_part", (F.sum("_sum").over(Window.partitionBy(group).orderBy("_part")) - F.col("_sum")).alias("_before"))
    own = F.sum(cost).over(Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(cost)
    spent = rows.join(before, [group, "_part"]).withColumn("spent", F.col("_before") + own)
    return spent.where(F.col("spent") < budget).select(*events.columns, F.round("spent", 4).alias("spent"))


def windowed_counts(stream: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and tumbling window; on a stream, rows later than the watermark are dropped."""
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(at, length), key).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), key, "events")
