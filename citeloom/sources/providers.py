"""Answers of citation providers: payloads as columns, and caches of them as tables. Nothing here calls a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import CROSSREF, WORK, parse_crossref, parse_work

SEMANTIC = "paperId string, title string, year int, venue string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>, citationCount bigint"
#: What an answer "there is no such record" is stored as.
NOT_FOUND = '{"not_found":true}'


def _identifiers(*pairs: tuple[str, Column]) -> Column:
    """Array of (scheme, value) of the values that are known."""
    return F.filter(F.array(*(F.when(v.isNotNull() & (v != ""), F.struct(F.lit(s).alias("scheme"), v.alias("value"))) for s, v in pairs)), lambda x: x.isNotNull())


def version_kind(doi: Column) -> Column:
    """preprint for DOIs of preprint servers, published for others, unknown without one."""
    return F.when(doi.isNull(), "unknown").when(F.lower(doi).rlike(r"^10\.(48550|1101|31219|21203|2139)/"), "preprint").otherwise("published")


def _candidate(source: str, key: Column, title: Column, authors: Column, year: Column, venue: Column, ids: Column, kind: Column, cited: Column) -> Column:
    return F.when(key.isNotNull() & (key != ""), F.struct(
        F.lit(source).alias("source"), key.alias("source_id"), title.alias("title"), F.coalesce(authors, F.expr("cast(array() as array<string>)")).alias("authors"), year.cast("int").alias("year"),
        venue.cast("string").alias("venue"), ids.alias("identifiers"), kind.alias("version_kind"), cited.cast("bigint").alias("cited_by_count"),
    ))


def openalex_candidates(payload: Column) -> Column:
    """A search answer {"results": [...]} as candidates; items without an id are left out, another shape gives none."""

    def one(item: Column) -> Column:
        w = parse_work(item)
        return _candidate("openalex", w["id"], w["title"], w["authors"], w["year"], F.lit(None), _identifiers(("openalex", w["id"]), ("doi", w["doi"])), version_kind(w["doi"]), F.lit(None))

    return _each(F.from_json(payload, f"results array<struct<{_struct(WORK)}>>")["results"], one)


def crossref_candidates(payload: Column) -> Column:
    """A search answer {"message": {"items": [...]}}; items without a DOI are left out."""

    def one(item: Column) -> Column:
        w = parse_crossref(item)
        kind = F.get_json_object(item, "$.type")
        return _candidate("crossref", w["doi"], w["title"], w["authors"], w["year"], w["venue"], _identifiers(("doi", w["doi"])), F.when(kind == "posted-content", "preprint").when(kind.isNotNull(), "published").otherwise("unknown"), F.lit(None))

    return _each(F.from_json(payload, f"message struct<items:array<struct<{_struct(CROSSREF)},type:string>>>")["message"]["items"], one)


def semantic_scholar_candidates(payload: Column) -> Column:
    """A search answer {"data": [...]}; items without an id are left out."""

    def one(item: Column) -> Column:
        j = F.from_json(item, SEMANTIC)
        key, doi, arxiv = F.trim(j["paperId"]), F.lower(j["externalIds"]["DOI"]), j["externalIds"]["ArXiv"]
        kind = F.when(doi.isNull() & arxiv.isNotNull(), "preprint").otherwise(version_kind(doi))
        return _candidate("semantic_scholar", key, F.nullif(F.trim(j["title"]), F.lit("")), F.transform(j["authors"], lambda a: a["name"]), j["year"], F.nullif(F.trim(j["venue"]), F.lit("")), _identifiers(("semantic_scholar", key), ("doi", doi), ("arxiv", arxiv)), kind, j["citationCount"])

    return _each(F.from_json(payload, f"data array<struct<{_struct(SEMANTIC)}>>")["data"], one)


def _struct(schema: str) -> str:
    """A table schema as the fields of a struct."""
    import re

    out, depth = [], 0
    for part in re.split(r"(, (?![^<]*>)|[<>])", schema):
        depth += (part == "<") - (part == ">")
        out.append("," if part == ", " and depth == 0 else re.sub(r"^([\w`-]+) ", r"\1:", part) if depth == 0 else part)
    return "".join(out)


def _each(items: Column, one) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array()), lambda x: one(F.to_json(x))), lambda c: c.isNotNull())


def cached(keys: DataFrame, cache: DataFrame, key: str, refresh: bool = False, readable=None, fetch=None) -> DataFrame:
    """keys(key), cache(key, payload) -> (key, payload, source): cache, provider or miss, once per key.

    With refresh no cached answer counts. readable is a condition on payload; an answer that fails it is asked again. A
    stored NOT_FOUND is an answer with a null payload. fetch turns a table of keys into (key, payload); without it the
    keys come out as misses.
    """
    ok = F.coalesce(readable(F.col("payload")) if readable is not None else F.col("payload").isNotNull(), F.lit(False)) | F.coalesce(F.col("payload") == NOT_FOUND, F.lit(False))
    rows = keys.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key, "payload"), key, "left")
    hit = rows.where(ok & F.lit(not refresh)).select(key, "payload", F.lit("cache").alias("source"))
    miss = rows.where(~(ok & F.lit(not refresh))).select(key)
    got = miss.join(fetch(miss).select(key, "payload"), key, "left").select(key, "payload", F.when(F.col("payload").isNull(), "miss").otherwise("provider").alias("source")) if fetch else miss.select(key, F.lit(None).cast("string").alias("payload"), F.lit("miss").alias("source"))
    return hit.unionByName(got).select(key, F.nullif("payload", F.lit(NOT_FOUND)).alias("payload"), "source")


def collected(pages: DataFrame, limit: int) -> DataFrame:
    """pages(work, page, total, ids array) -> (work, neighbor, place, coverage): distinct neighbors in page order, at most limit of a work.

    coverage is complete if as many were listed as the provider counts, capped if the limit cut them, else partial. A null total counts as
    unknown and complete. Every work's neighbors are ranked by one global sort.
    """
    from ..operators.topk import ranked

    flat = pages.select("work", "page", "total", F.posexplode("ids").alias("i", "neighbor")).where("neighbor is not null and neighbor <> work")
    first = flat.groupBy("work", "neighbor").agg(F.min(F.struct("page", "i")).alias("at"), F.max("total").alias("total"))
    sizes = first.groupBy("work").agg(F.count("*").alias("n"))
    rows = ranked(first, ["work"], ["at", "neighbor"], "place").join(sizes, "work")
    coverage = F.when(F.col("n") > limit, "capped").when(F.col("total").isNull() | (F.col("n") >= F.col("total")), "complete").otherwise("partial")
    return rows.where(F.col("place") <= limit).select("work", "neighbor", "place", coverage.alias("coverage"))
