"""Problem 4: consolidating pairwise matches into groups.

Method: vertices of degree one are stripped and chains of degree-two vertices are compressed by list ranking, again and
again while that takes away a fair share of the links; the core that remains is solved by alternating large and small
stars, whatever its size; the labels are then handed back to the removed vertices, last removed first.

Every step is a join or an aggregate with map-side combine; nothing but counts reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Keys holding more than one row in HOT are joined by broadcast, so there are fewer than HOT of them.
HOT = 256
#: Parts into which the members of one key are divided before a hub is chosen for the key.
SALTS = 64
#: Another round of stripping and compressing is made if the last one took away this share of the links.
WORTH = 0.1


def join_spread(many: DataFrame, one: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Joins many rows per key with at most one row per key, however uneven the keys are.

    A key with over 1/HOT of the rows meets its row by broadcast (fewer than HOT rows by construction); the rest are
    shuffled. how is inner or left. Rows whose key is null match nothing. total is the number of rows of many, if known.
    """
    total = many.count() if total is None else total
    if total < 200_000:  # one task could hold all of it
        return many.join(one, key, how)
    hot = F.broadcast(cut(many.groupBy(key).count().where(F.col("count") > total / HOT).select(key)))
    few = F.broadcast(one.join(hot, key, "left_semi"))
    return many.join(hot, key, "left_semi").join(few, key, how).unionByName(many.join(hot, key, "left_anti").join(one, key, how))


def links_by_key(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Links (a, b), a < b, that connect all members sharing equal keys: a star of stars, so one link per member at most.

    Members of one key are first divided by hash, so a key with any share of the rows is spread over SALTS tasks.
    Rows with a null in a key or in member link nothing.
    """
    rows = rows.select(*keys, F.col(member).alias("_m")).dropna()
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("_m"), F.lit(SALTS)))
    local = salted.groupBy(*keys, "_s").agg(F.min("_m").alias("_hub"))
    top = local.groupBy(*keys).agg(F.min("_hub").alias("_root"))
    spokes = salted.join(local, [*keys, "_s"]).select(F.col("_hub").alias("a"), F.col("_m").alias("b"))
    hubs = local.join(top, keys).select(F.col("_root").alias("a"), F.col("_hub").alias("b"))
    return spokes.unionByName(hubs).where("a < b").distinct()


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o")), F.struct(F.col("b").alias("v"), F.col("a").alias("o")))).alias("x")).select("x.*")


def _degrees(edges: DataFrame) -> DataFrame:
    return _arcs(edges).groupBy("v").agg(F.count("*").alias("d"), F.min("o").alias("n1"), F.max("o").alias("n2"))


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes away all vertices of degree one; of a lone pair the larger goes. Gives (removed child/parent, edges left)."""
    leaf = _degrees(edges).where("d = 1")
    ends = leaf.select(F.least("v", "n1").alias("a"), F.greatest("v", "n1").alias("b"), F.col("v").alias("leaf")).groupBy("a", "b").agg(F.max("leaf").alias("child"))
    removed = cut(ends.select("child", F.when(F.col("child") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent")))
    gone = removed.select(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b"))
    return removed, cut(edges.join(gone, ["a", "b"], "left_anti"))


def _compress(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Replaces each maximal chain of degree-two vertices by one edge between its ends.

    List ranking by pointer doubling over directed steps: (v, first) stands for leaving v towards first and has come as
    far as the step prev -> at. Chains end where at isn't a chain vertex; a bare cycle never ends and stays.
    """
    degrees = _degrees(edges)
    chain = cut(degrees.where("d = 2").select("v", "n1", "n2"))
    if chain.isEmpty():
        return None, edges
    inner = chain.select(F.col("v").alias("at"), F.lit(True).alias("inner"))
    steps = chain.select("v", F.explode(F.array("n1", "n2")).alias("first")).withColumn("prev", F.col("v")).withColumn("at", F.col("first"))
    steps = cut(steps.join(inner, "at", "left").select("v", "first", "prev", "at", F.coalesce("inner", F.lit(False)).alias("open")))
    left = steps.where("open").count()
    while left:
        ahead = steps.select(F.col("v").alias("at"), F.col("first").alias("f2"), F.col("prev").alias("p2"), F.col("at").alias("a2"), F.col("open").alias("o2"))
        moved = steps.where("open").join(ahead, "at").where("f2 <> prev").select("v", "first", F.col("p2").alias("prev"), F.col("a2").alias("at"), F.col("o2").alias("open"))
        steps = cut(steps.where("not open").unionByName(moved))
        before, left = left, steps.where("open").count()
        if left == before:  # only bare cycles are left: chains shorter than the last reach would have ended
            break
    ends = steps.where("not open").groupBy("v").agg(F.count("*").alias("n"), F.min("at").alias("parent"), F.max("at").alias("other")).where("n = 2")
    ends = cut(ends)
    removed = ends.select(F.col("v").alias("child"), "parent")
    inside = ends.select("v")
    kept = edges.join(inside.withColumnRenamed("v", "a"), "a", "left_anti").join(inside.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
    bridges = ends.where("parent < other").select(F.col("parent").alias("a"), F.col("other").alias("b"))
    return removed, cut(kept.unionByName(bridges).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """(child, parent) of the core: alternating large and small stars until every vertex hangs on its group's smallest."""
    before = edges.count()
    while True:
        arcs = cut(_arcs(edges))
        low = arcs.groupBy("v").agg(F.min("o").alias("m")).withColumn("m", F.least("m", "v"))
        large = cut(join_spread(arcs.where("o > v"), low, "v", total=before).select(F.col("m").alias("a"), F.col("o").alias("b")).where("a < b").distinct())
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = join_spread(large, down, "b")
        small = pairs.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(down.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        small = cut(small)
        left = small.count()
        if left == before and small.join(edges, ["a", "b"], "left_anti").isEmpty():
            return small.select(F.col("b").alias("child"), F.col("a").alias("parent"))
        edges, before = small, left


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of one comparable type -> (vertex, group), group the smallest vertex reached from it.

    Loops, repeated links and either direction are allowed; links with a null are ignored. An empty table gives none.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").isNotNull().alias("l"), F.col("b").isNotNull().alias("r")).where("l and r and a < b").select("a", "b").distinct())
    levels: list[tuple[DataFrame, int]] = []
    left = edges.count()
    while left:
        before = left
        for shrink in (_strip, _compress):
            removed, rest = shrink(edges)
            gone = removed.count() if removed is not None else 0
            if gone:
                levels.append((removed, gone))
                edges, left = rest, rest.count()
            if not left:
                break
        if left and left > before * (1 - WORTH):
            core = cut(_stars(edges))
            levels.append((core, left))
            break
    schema = links.select(F.col("a").alias("child"), F.col("a").alias("parent")).schema
    if not levels:
        return links.sparkSession.createDataFrame([], schema).toDF("vertex", "group")
    labels, known = levels[-1]  # (vertex as child, its root as parent)
    for level, n in reversed(levels[:-1]):
        roots = labels.select(F.col("child").alias("parent"), F.col("parent").alias("root"))
        found = join_spread(level, roots, "parent", "left", total=n).select("child", F.coalesce("root", "parent").alias("parent"))
        labels, known = cut(labels.unionByName(found)), known + n
    smallest = labels.groupBy(F.col("parent").alias("root")).agg(F.min("child").alias("m")).select("root", F.least("m", "root").alias("group"))
    smallest = cut(smallest)
    named = join_spread(labels.select(F.col("child").alias("vertex"), F.col("parent").alias("root")), smallest, "root", total=known).select("vertex", "group")
    return named.unionByName(smallest.select(F.col("root").alias("vertex"), "group"))


def attach(rows: DataFrame, vertex: str, groups: DataFrame) -> DataFrame:
    """rows with a column group: their component, or themselves when nothing is linked to them."""
    return rows.join(groups.select(F.col("vertex").alias(vertex), "group"), vertex, "left").withColumn("group", F.coalesce("group", vertex))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
