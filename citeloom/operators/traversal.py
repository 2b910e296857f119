"""Traversal of a citation graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def resolve_redirects(redirects: DataFrame, hops: int = 8) -> DataFrame:
    """redirects(old, new), one per old -> (old, target, hops): where a chain leads within so many hops.

    Pointer doubling: after k rounds each pointer spans two to the power of k steps, so hops must be a power of two.
    A cycle ends after the last hop; nulls redirect nothing.
    """
    at = redirects.where("old is not null and new is not null").select("old", F.col("new").alias("target"), F.lit(1).alias("hops"))
    done = 1
    while done < hops:
        ahead = at.select(F.col("old").alias("target"), F.col("target").alias("t2"), F.col("hops").alias("h2"))
        at = at.join(ahead, "target", "left").select("old", F.coalesce("t2", "target").alias("target"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"))
        done *= 2
    return at


def levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """edges(citing, cited), seeds(node) -> (node, depth): least number of steps from any seed, up to depth.

    One join per level; each level is cut from the plan, and stops early when it reaches nothing new.
    """
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for step in range(1, depth + 1):
        level = cut(edges.join(level.select(F.col("node").alias("citing")), "citing").select(F.col("cited").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def plan_frontier(candidates: DataFrame, group: str, fanout: int, budget: int) -> DataFrame:
    """candidates(group, parent, work, score, year, mark) -> (group, parent, work, place): what each walk opens next.

    Parents come in ascending order; each takes its best works (score, newest year, id) that are neither hidden nor
    downplayed nor taken by an earlier parent; a group stops at its budget. The choice depends on earlier ones, so a
    group is one task, but a parent with more candidates than parents before it can have taken is cut to those first.
    NaN scores count as highest.
    """
    from .topk import top_k

    order = [F.desc_nulls_last("score"), F.desc_nulls_last("year"), F.asc("work")]
    open_ = candidates.where("(mark is null or mark not in ('hidden', 'downplayed')) and work is not null and parent is not null").dropDuplicates([group, "parent", "work"])
    # a parent needs at most its fanout plus what a whole budget has taken before it
    kept = top_k(open_, [group, "parent"], order, fanout + budget, "work", salts=8)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["parent", "rank"])
        taken: set = set()
        out: list[tuple] = []
        for parent, own in rows.groupby("parent", sort=True):
            n = 0
            for work in own["work"]:
                if n == fanout or len(out) == budget:
                    break
                if work not in taken:
                    taken.add(work)
                    out.append((rows[group].iloc[0], parent, work, n + 1))
                    n += 1
        return pd.DataFrame(out, columns=[group, "parent", "work", "place"])

    kind = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return kept.select(group, "parent", "work", "rank").groupBy(group).applyInPandas(plan, f"{group} {kind[group]}, parent {kind['parent']}, work {kind['work']}, place int")


def planned(parents: list[tuple], children: dict, fanout: int, remaining: int, visited: set) -> tuple[list[tuple], bool]:
    """One walk's next level: (parent, work) in order, and whether the budget cut any.

    parents in order; children[parent] are its works, best first. A work taken by an earlier parent doesn't use up a later
    one's fanout.
    """
    taken: set = set()
    out: list[tuple] = []
    for parent in parents:
        n = 0
        for work in children.get(parent, ()):
            if n == fanout:
                break
            if work in visited or work in taken:
                continue
            taken.add(work)
            out.append((parent, work))
            n += 1
    return out[:remaining], len(out) > remaining


def walk(edges: DataFrame, works: DataFrame, seeds: DataFrame, depth: int = 3, fanout: int = 10, budget: int = 40) -> DataFrame:
    """edges(citing, cited), works(id, score, year, mark), seeds(seed) -> (seed, level, place, parent, work, truncated): what each walk expands.

    Level 0 is the seed. Of every expanded work the best children (score, newest year, id) that are neither hidden nor
    downplayed nor visited are expanded next, at most fanout of a work and budget of a walk in all; truncated says whether
    the budget cut the level. All walks go level by level together, a join per level. A walk's plan is made from at most
    fanout + budget children of each of its at most budget parents, so no task holds a hub.
    """
    from .topk import top_k

    kind = {f.name: f.dataType.simpleString() for f in works.schema}["id"]
    schema = f"seed {kind}, level int, place int, parent {kind}, work {kind}, truncated boolean"
    level = cut(seeds.where("seed is not null").select("seed", F.lit(0).alias("level"), F.lit(0).alias("place"), F.lit(None).cast(kind).alias("parent"), F.col("seed").alias("work"), F.lit(False).alias("truncated")).distinct())
    seen = level
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("year"), F.asc("child")]
    for step in range(1, depth):
        children = level.select("seed", "place", F.col("work").alias("citing")).join(edges, "citing").select("seed", "place", F.col("citing").alias("parent"), F.col("cited").alias("child")).distinct()
        open_ = children.join(works.where("mark is null or mark not in ('hidden', 'downplayed')").select(F.col("id").alias("child"), "score", "year"), "child")
        open_ = open_.join(seen.select("seed", F.col("work").alias("child")), ["seed", "child"], "left_anti")
        best = top_k(open_, ["seed", "parent"], order, fanout + budget, "child", salts=8)
        own = best.groupBy("seed").agg(F.collect_list(F.struct("place", "parent", "rank", "child")).alias("c")).join(seen.groupBy("seed").agg(F.count("*").alias("used")), "seed")

        def plan(batches: Iterator[pd.DataFrame], step: int = step) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for seed, rows, used in zip(batch["seed"], batch["c"], batch["used"], strict=True):
                    rows = sorted(rows, key=lambda r: (r["place"], r["rank"]))
                    lists: dict = {}
                    for r in rows:
                        lists.setdefault(r["parent"], []).append(r["child"])
                    chosen, cut_ = planned(list(lists), lists, fanout, max(0, budget - used), set())
                    out += [(seed, step, i, p, w, cut_) for i, (p, w) in enumerate(chosen)]
                yield pd.DataFrame(out, columns=["seed", "level", "place", "parent", "work", "truncated"])

        level = cut(own.mapInPandas(plan, schema))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def paths(walked: DataFrame, depth: int) -> DataFrame:
    """walk() -> (seed, work, path array from the seed): one join per level over the walk's own links."""
    at = walked.where("level = 0").select("seed", "work", F.array("work").alias("path"))
    out = at
    for step in range(1, depth):
        at = walked.where(F.col("level") == step).join(at.select("seed", F.col("work").alias("parent"), "path"), ["seed", "parent"]).select("seed", "work", F.concat("path", F.array("work")).alias("path"))
        out = out.unionByName(at)
    return out


def collapsed(walked: DataFrame, closed: DataFrame, depth: int) -> DataFrame:
    """walk() without what hangs below closed(seed, work): a closed work stays, its children and theirs go."""
    gone = closed.select("seed", F.col("work").alias("parent"))
    lost = None
    for step in range(1, depth):
        below = walked.where(F.col("level") == step).join(gone, ["seed", "parent"], "left_semi").select("seed", "level", "work")
        gone = gone.unionByName(below.select("seed", F.col("work").alias("parent")))
        lost = below if lost is None else lost.unionByName(below)
    return walked if lost is None else walked.join(lost, ["seed", "level", "work"], "left_anti")


def reading_order(items: DataFrame, cites: DataFrame, group: str) -> DataFrame:
    """items(group, id, depth, score, year, title_key, is_seed), cites(group, citing, cited) -> (group, id, position).

    Repeatedly the best item none of whose cited items is left comes next; if only cycles are left, the best of all; the
    seed comes last. Best: deeper, higher score, older (unknown last), title key, id. A list is bounded (a ramp has at
    most 500 items), so one task holds one list.
    """
    edges = cites.groupBy(group).agg(F.collect_list(F.struct("citing", "cited")).alias("edges"))
    rows = items.groupBy(group).agg(F.collect_list(F.struct("id", "depth", "score", "year", "title_key", "is_seed")).alias("items")).join(edges, group, "left")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, its, es in zip(batch[group], batch["items"], batch["edges"], strict=True):
                out += [(g, x, i) for i, x in enumerate(suggest_order(its, [] if es is None else [(e["citing"], e["cited"]) for e in es]))]
            yield pd.DataFrame(out, columns=[group, "id", "position"])

    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    return rows.mapInPandas(order, f"{group} {kind[group]}, id {kind['id']}, position int")


def suggest_order(items: list[dict], edges: list[tuple]) -> list:
    """The order of reading_order for one list."""

    def key(x: dict) -> tuple:
        year = x["year"]
        return (-x["depth"], -x["score"], year is None or year != year, 0 if year is None or year != year else year, x["title_key"], x["id"])

    left = {x["id"]: x for x in items if not x["is_seed"]}
    needs = {i: {b for a, b in edges if a == i and b != i} for i in left}
    out = []
    while left:
        free = [x for i, x in left.items() if not (needs[i] & left.keys())]
        best = min(free or left.values(), key=key)
        out.append(best["id"])
        del left[best["id"]]
    return out + [x["id"] for x in items if x["is_seed"]]
