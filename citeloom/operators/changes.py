"""Writes as functions from old tables and changes to new tables.

Each takes the stored table and a batch and gives the table as it is afterwards; applying a batch twice changes nothing
more. A write to storage is then one atomic overwrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import ranked


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same keys; of several new rows with one key the last by order counts.

    Nulls in keys equal each other. An anti join on the keys and a union: the old table is shuffled once by key.
    """
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(last.select(*keys).alias("n"), same, "left_anti")
    return kept.select(*old.columns).unionByName(last.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of new whose keys old doesn't have are added, the first by order of those with one key."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    fresh = first.alias("n").join(old.select(*keys).alias("o"), same, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def update_where(old: DataFrame, keys: DataFrame, on: str, changes: dict) -> DataFrame:
    """Sets columns of the rows whose key is among keys."""
    hit = keys.select(F.col(on)).distinct().withColumn("_hit", F.lit(True))
    rows = old.join(hit, on, "left")
    return rows.select(*(F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in old.columns))


def reconcile(old: DataFrame, scan: DataFrame, partial: bool = False) -> DataFrame:
    """old(path, sha), scan(path, sha) -> (path, sha, decision): unchanged, replaced, moved, added, duplicate or tombstoned.

    A new path whose content a vanished path had is a move; the first new path (by name) takes the first vanished one, the
    next the next. A new path with content that another present path has is a duplicate. With partial, paths missing from
    the scan stay as they are instead of being tombstoned. Matching is by rank within equal content, which a global sort gives,
    so content that many files share (empty ones) is no task of its own.
    """
    o = old.where("path is not null").select(F.col("path"), F.col("sha").alias("old_sha"))
    s = scan.where("path is not null").select(F.col("path"), F.col("sha").alias("new_sha"))
    both = o.join(s, "path", "full_outer")
    gone = ranked(both.where("new_sha is null").select("path", F.col("old_sha").alias("sha")), ["sha"], ["path"], "k").withColumnRenamed("path", "was")
    fresh = ranked(both.where("old_sha is null").select("path", F.col("new_sha").alias("sha")), ["sha"], ["path"], "k")
    moved = fresh.join(gone, ["sha", "k"], "left")
    present = both.where("old_sha is not null and new_sha is not null").select(F.col("new_sha").alias("sha")).distinct().withColumn("have", F.lit(True))
    new_rows = moved.join(present, "sha", "left").select("path", "sha", F.when(F.col("was").isNotNull(), "moved").when(F.col("have") | (F.col("k") > 1), "duplicate").otherwise("added").alias("decision"))
    stay = both.where("old_sha is not null and new_sha is not null").select("path", F.col("new_sha").alias("sha"), F.when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("replaced").alias("decision"))
    left = gone.join(moved.where("was is not null").select("was"), "was", "left_anti").select(F.col("was").alias("path"), "sha", F.lit("unchanged" if partial else "tombstoned").alias("decision"))
    return stay.unionByName(new_rows).unionByName(left)


def merge_works(redirects: DataFrame, facts: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """redirects(old, new), facts: each fact's work repointed; facts that become equal in keys are kept once (smallest id)."""
    moved = facts.join(redirects.select(F.col("old").alias(column), F.col("new").alias("_to")), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
    rest = [c for c in facts.columns if c not in keys]
    return moved.groupBy(*keys).agg(F.min_by(F.struct(*rest), "id").alias("_r")).select(*keys, "_r.*").select(*facts.columns)
