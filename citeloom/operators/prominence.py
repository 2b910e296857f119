"""Scores of works from their graph signals, and the order works are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import ranked, top_k

# Weights of the components, and where they saturate.
WEIGHTS = {"degree": 0.30, "global": 0.25, "local": 0.15, "mentions": 0.10, "role": 0.10, "recency": 0.10}
DEGREE_FULL, MENTIONS_FULL, DECADES_FULL, RECENCY_YEARS = 8, 10, 5, 15
MARKS = ["pinned", None, "downplayed", "hidden"]


def mark_rank(mark: Column) -> Column:
    """pinned 0, no mark 1, downplayed 2, hidden 3; an unknown mark counts as none."""
    return F.when(mark == "pinned", 0).when(mark == "downplayed", 2).when(mark == "hidden", 3).otherwise(1)


def components(signals: DataFrame, this_year: int) -> DataFrame:
    """signals -> the six components in 0..1, null where unknown.

    signals has citing, cited, global_count, year, local, mentions, methods, backgrounds. A null count leaves its
    component unknown; a role is unknown without method and background labels.
    """
    log = lambda c, full: F.least(F.lit(1.0), F.log(1 + F.col(c)) / F.log(F.lit(1.0 + full)))
    return signals.withColumns({
        "c_degree": log("citing", DEGREE_FULL),
        "c_global": F.least(F.lit(1.0), F.log(1 + F.col("global_count")) / F.log(F.lit(10.0)) / DECADES_FULL),
        "c_local": F.col("local").cast("double"),
        "c_mentions": log("mentions", MENTIONS_FULL),
        "c_role": F.when(F.col("methods") > 0, 1.0).when(F.col("backgrounds") > 0, 0.3),
        "c_recency": F.exp(-F.greatest(F.lit(0), F.lit(this_year) - F.col("year")) / F.lit(float(RECENCY_YEARS))),
    })


def score(rows: DataFrame) -> DataFrame:
    """Adds score: the weighted mean of the known components to four decimals, null if none is known."""
    value, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        c = F.col(f"c_{name}")
        value = value + F.coalesce(c * w, F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), w).otherwise(0.0)
    mean = F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / weight)))
    return rows.withColumn("score", F.floor(mean * 10000 + 0.5) / 10000)


def rank_order() -> list[Column]:
    """Mark class, then score, then newest year, then title key, then id."""
    return [F.asc("mark_rank"), F.desc_nulls_last("score"), F.desc_nulls_last("year"), F.asc("title_key"), F.asc("id")]


def cluster_slot(mark: Column, tag: Column, year: Column) -> Column:
    """The cluster a work falls into when it isn't shown by itself: hidden, downplayed, its first tag, its decade, or unknown."""
    return (
        F.when(mark == "hidden", "hidden").when(mark == "downplayed", "downplayed").when(tag.isNotNull(), F.concat(F.lit("tag:"), tag))
        .when(year.isNotNull(), F.concat(F.lit("decade:"), (F.floor(year / 10) * 10).cast("string"))).otherwise("decade:unknown")
    )


def with_cache(scored: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """scored(id, score), cache(id, cached, version) -> (id, score, from_cache): cached scores of this version, else the computed ones."""
    hit = cache.where(F.col("version") == version).select("id", "cached")
    return scored.join(hit, "id", "left").select("id", F.coalesce("cached", "score").alias("score"), F.col("cached").isNotNull().alias("from_cache"))


def neighborhoods(neighbors: DataFrame, limit: int, expand: list[str]) -> DataFrame:
    """neighbors(center, id, score, mark, mark_rank, tag, year, title, title_key), once per pair -> with rank, slot, first, visible.

    Pinned and unmarked works are shown to the limit, pinned ones always; the others are members of their slot and shown
    only if that is expanded. Ranks come from one global sort, so a center's neighborhood is never one task's.
    """
    counts = neighbors.groupBy("center").agg(F.count_if(F.col("mark_rank") == 0).alias("pinned"), F.count_if(F.col("mark_rank") == 1).alias("unmarked"))
    top = F.least(F.greatest(F.lit(limit), "pinned"), F.col("pinned") + F.col("unmarked"))
    rows = ranked(neighbors, ["center"], rank_order()).join(counts, "center").withColumn("slot", cluster_slot(F.col("mark"), F.col("tag"), F.col("year"))).withColumn("first", F.col("rank") <= top)
    return rows.withColumn("visible", F.col("first") | F.col("slot").isin(*expand)).drop("pinned", "unmarked")


def clusters(ranked_: DataFrame, samples: int = 3) -> DataFrame:
    """neighborhoods() -> (center, slot, members, samples, place) of what isn't shown; a center has at most one slot per tag and decade."""
    rest = ranked_.where("not visible").select("center", "slot", "id", "title", "rank")
    first = top_k(rest.withColumnRenamed("rank", "r"), ["center", "slot"], [F.asc("r")], samples, "id").groupBy("center", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), " / ").alias("samples"))
    slot = F.col("slot")
    tag, decade = slot.startswith("tag:"), slot.startswith("decade:") & (slot != "decade:unknown")
    group = F.when(tag, 0).when(decade, 1).when(slot == "decade:unknown", 2).when(slot == "downplayed", 3).otherwise(4)
    order = [group, F.when(tag, F.lower(slot)).otherwise(F.lit("")), F.when(decade, -F.substring(slot, 8, 10).try_cast("int")).otherwise(0)]
    sized = rest.groupBy("center", "slot").agg(F.count("*").alias("members")).join(first, ["center", "slot"])
    return ranked(sized, ["center"], order, "place").select("center", "slot", "members", "samples", "place")
