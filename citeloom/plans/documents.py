"""Parsers and sources over payloads that stand in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from ..session import table
from .catalog import query


@query("select sha256(text) as sha, strlen(text) as bytes, count(*) as copies from documents where text is not null group by 1, 2")
def s02_hash_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes")).agg(F.count("*").alias("copies"))


@query("select id, display_authors[1] as author, display_year as year, display_title as title from graph_work where display_title is not null and display_year between 1400 and 2199 and display_authors[1] is not null and not contains(display_title, ' - ') and not contains(display_authors[1], ' - ') and trim(display_title) = display_title and trim(display_authors[1]) = display_authors[1]")
def s05_metadata_from_filename(spark: SparkSession, d: str) -> DataFrame:
    """File names written from works and read back."""
    a, t = F.get("display_authors", F.lit(0)), F.col("display_title")
    rows = table(spark, d, "graph_work").where(t.isNotNull() & F.col("display_year").between(1400, 2199) & a.isNotNull() & ~t.contains(" - ") & ~a.contains(" - ") & (F.trim(t) == t) & (F.trim(a) == a))
    m = S.metadata_from_filename(F.concat_ws(" - ", a, F.col("display_year").cast("string"), t))
    return rows.select("id", m.alias("m")).select("id", "m.author", "m.year", "m.title")


PAYLOAD = "select openalex_id, to_json({'id': 'https://openalex.org/' || openalex_id, 'doi': 'https://doi.org/' || doi, 'title': title, 'publication_year': year}) as payload from openalex_work"


@query("select event_id, case when event_id % 5 = 0 then null when event_id % 7 = 0 then null else cast(floor(value) as bigint) end as count from events")
def s12_parse_cited_by_count(spark: SparkSession, d: str) -> DataFrame:
    """Numbers count, strings and negative numbers don't."""
    v = F.format_string("%.4f", F.col("value"))
    k = F.col("event_id")
    json = F.when(k % 5 == 0, F.concat(F.lit('{"cited_by_count": "'), v, F.lit('"}'))).when(k % 7 == 0, F.concat(F.lit('{"cited_by_count": -1'), F.lit("}"))).otherwise(F.concat(F.lit('{"cited_by_count": '), v, F.lit("}")))
    return table(spark, d, "events").select("event_id", S.parse_cited_by_count(json).alias("count"))


@query("select paper_id, unnest(range(1, len(pages) + 1)) as number from reading_index where len(pages) > 0")
def s25_split_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages joined by form feeds and divided again."""
    text = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("p"), p["page_number"].cast("string"))), "\f")
    return table(spark, d, "reading_index").where("size(pages) > 0").select("paper_id", F.explode(S.split_pages(text)).alias("p")).select("paper_id", F.col("p.number").cast("bigint").alias("number"))
