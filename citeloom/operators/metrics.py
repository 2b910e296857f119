"""Evaluation metrics and order statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the normal quantile of a 95 % interval.
Z = 1.96


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Low and high end of the 95 % Wilson interval of a share; null without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    middle, spread = p + Z * Z / (2 * n), Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)
    return (middle - spread) / (1 + Z * Z / n), (middle + spread) / (1 + Z * Z / n)


def precision_recall(rows: DataFrame, key: str, truth: Column, guess: Column) -> DataFrame:
    """Hits, precision and recall per key. Without guesses precision is 1 if there is no truth, else 0; without truth recall is 1."""
    s = rows.groupBy(key).agg(F.count_if(truth & guess).alias("hit"), F.count_if(guess).alias("guessed"), F.count_if(truth).alias("true_"))
    precision = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).when(F.col("true_") == 0, 1.0).otherwise(0.0)
    return s.select(key, "hit", F.round(precision, 6).alias("precision_"), F.round(F.when(F.col("true_") > 0, F.col("hit") / F.col("true_")).otherwise(1.0), 6).alias("recall"))


def interval_iou(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    """Overlap of two closed intervals over their hull; 0 if they are apart."""
    inside = F.least(hi, other_hi) - F.greatest(lo, other_lo) + 1
    return F.when(inside > 0, inside / (F.greatest(hi, other_hi) - F.least(lo, other_lo) + 1)).otherwise(0.0)


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Element n // 2 of each group's sorted values. Nulls are left out.

    Works on counts of equal values, so a group of any size comes to a task only as its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    seen = counts.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    return seen.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def histogram_slots(rows: DataFrame, year: str, longest: int = 3) -> DataFrame:
    """(lo, hi, n): one slot per year with rows; runs of at most `longest` empty years get slots of their own, longer ones one slot.

    The window runs over distinct years, of which there are few whatever the data. Null years are the caller's lane.
    """
    y = rows.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("lo")).agg(F.count("*").alias("n"))
    g = y.withColumn("next", F.lead("lo").over(Window.orderBy("lo")))
    gap = F.col("next") - F.col("lo") - 1
    full = g.select("lo", F.col("lo").alias("hi"), "n")
    short = g.where((gap >= 1) & (gap <= longest)).select(F.explode(F.sequence(F.col("lo") + 1, F.col("next") - 1)).alias("lo")).select("lo", F.col("lo").alias("hi"), F.lit(0).cast("bigint").alias("n"))
    long = g.where(gap > longest).select((F.col("lo") + 1).alias("lo"), (F.col("next") - 1).alias("hi"), F.lit(0).cast("bigint").alias("n"))
    return full.unionByName(short).unionByName(long)
