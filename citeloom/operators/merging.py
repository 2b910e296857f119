"""Merging works: which requests hold, and what every fact of a merged work becomes. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(requests: DataFrame, works: DataFrame, redirects: DataFrame, edges: DataFrame) -> DataFrame:
    """requests(old, new), works(id), redirects(old, new), edges(citing, cited) -> (old, new, decision), one row per distinct request.

    decision is the first guard that refuses (same, missing, redirected, citation) or merged. Redirected is a work that
    redirects already, or whose own merge is asked for: a batch merges only into works that stay. Requests with a null
    are missing.
    """
    asked = requests.select("old", "new").distinct()
    exists = works.select(F.col("id").alias("k")).distinct().withColumn("h", F.lit(True))
    leaving = asked.where("old <> new").select(F.col("old").alias("k")).unionByName(redirects.select(F.col("old").alias("k"))).where("k is not null").distinct().withColumn("h", F.lit(True))
    gone = redirects.select(F.col("old").alias("k")).where("k is not null").distinct().withColumn("h", F.lit(True))
    flag = lambda df, table, key, name: df.join(table.withColumnsRenamed({"k": key, "h": name}), key, "left")
    rows = flag(flag(flag(flag(asked, exists, "old", "has_old"), exists, "new", "has_new"), gone, "old", "gone_old"), leaving, "new", "gone_new")
    pairs = edges.select(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b")).distinct().withColumn("cites", F.lit(True))
    rows = rows.withColumn("a", F.least("old", "new")).withColumn("b", F.greatest("old", "new")).join(pairs, ["a", "b"], "left")
    decision = F.when(F.col("old") == F.col("new"), "same").when(F.col("has_old").isNull() | F.col("has_new").isNull(), "missing").when(F.col("gone_old") | F.col("gone_new"), "redirected").when(F.col("cites"), "citation").otherwise("merged")
    return rows.select("old", "new", decision.alias("decision"))


def flattened(redirects: DataFrame, merged: DataFrame) -> DataFrame:
    """Redirects after a batch of merges: new ones are added, older ones into a merged work lead to where it went."""
    moved = redirects.join(merged.select(F.col("old").alias("new"), F.col("new").alias("to")), "new", "left").select("old", F.coalesce("to", "new").alias("new"))
    return moved.unionByName(merged.select("old", "new"))


def repointed(facts: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """facts with column led to where its work went; moved says whether it was."""
    to = merged.select(F.col("old").alias(column), F.col("new").alias("_to"))
    rows = facts.join(to, column, "left").withColumn("moved", F.col("_to").isNotNull()).withColumn(column, F.coalesce("_to", column))
    return rows.drop("_to").select(*facts.columns, "moved")


def repointed_once(facts: DataFrame, merged: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """repointed(), and moved facts whose keys another fact of the target has already are dropped for it; of several moved ones the smallest id stays.

    survivor is the id of the fact that each dropped one is folded into. Facts that weren't moved all stay.
    """
    rows = repointed(facts, merged, column)
    best = rows.groupBy(column, *keys).agg(F.min(F.struct("moved", "id")).alias("s"), F.max("moved").alias("any"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (column, *keys)]
    both = rows.alias("r").join(best.where("any").alias("b"), same, "left")
    known = F.col("r.moved")
    for k in keys:
        known = known & F.col(f"r.{k}").isNotNull()
    dropped = F.coalesce(known & (F.col("b.s.id") != F.col("r.id")), F.lit(False))
    return both.select("r.*", F.when(dropped, F.col("b.s.id")).alias("survivor"))


def replaced_in(lists: DataFrame, merged: DataFrame, key: str, path: str) -> DataFrame:
    """Lists of works with each merged one replaced by its target, in place."""
    flat = lists.select(key, F.posexplode(path).alias("i", "old"))
    to = flat.join(merged.select("old", F.col("new").alias("_to")), "old", "left").select(key, "i", F.coalesce("_to", "old").alias("w"))
    return to.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias(path))
