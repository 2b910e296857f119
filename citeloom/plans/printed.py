"""Printed references, headings, pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import reference as R
from ..session import table
from .catalog import query


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bibliography_entry").where("raw_text is not null")


LINES = r"select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line, unnest(string_split(text, chr(10))) as x from documents where text is not null"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("line", (F.col("line") + 1).cast("bigint"))


@query(f"select doc_id, line from ({LINES}) where lower(trim(x)) in ('references', 'bibliography', 'works cited', 'literature cited', 'literatur', 'références', 'referencias')")
def f10_references_heading(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.trim("x").rlike(r"^\p{L}[\p{L} ]*$")).where(R.is_references_heading(F.col("x"))).select("doc_id", "line")


@query(rf"select doc_id, count(*) as leaders from ({LINES}) where regexp_matches(x, '(\.\s?){{4,}}\s*[0-9]+\s*$') group by doc_id")
def f83_dot_leaders(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(R.has_dot_leader(F.col("x"))).groupBy("doc_id").agg(F.count("*").alias("leaders"))


@query("with n as (select l_orderkey as k, l_linenumber as a, l_linenumber + cast(l_quantity as int) % 25 as b from lineitem) select k, a, len(case when b > a and b - a <= 20 then range(a + 1, b + 1) else [] end) as tail from n")
def f81_range_tail(spark: SparkSession, d: str) -> DataFrame:
    """How many numbers ranges stand for beyond their first."""
    a, b = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int") % 25
    label = F.concat(a.cast("string"), F.lit("–"), b.cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), a.alias("a"), F.size(R.range_tail(label)).cast("bigint").alias("tail"))


@query("select 'https://x.org/a/' || p_partkey as url, case when p_partkey % 2 = 0 then 'https://x.org/b/' || p_size else 'https://x.org/a/' || p_size end as link from part")
def f55_page_links(spark: SparkSession, d: str) -> DataFrame:
    """The one distinct link of pages built from parts: entities, fragments, upper-case tags and other schemes are dealt with."""
    base = F.concat(F.lit("https://x.org/a/"), F.col("p_partkey").cast("string"))
    href = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/b/"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    page = F.concat(F.lit("<p><A class=x href='"), href, F.lit("#top'>one</A> <a href=\"mailto:a@b.c\">m</a><a href=\""), href, F.lit('">&amp; two</a>'))
    return table(spark, d, "part").select(base.alias("url"), F.explode(H.page_links(base, page)).alias("link"))


@query("select 'https://x.org/a/' || p_partkey as url, case p_partkey % 3 when 0 then 'https://x.org/f' || p_size || '.pdf' when 1 then 'https://x.org/a/only.pdf' end as pdf from part")
def f56_pdf_link(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("https://x.org/a/"), F.col("p_partkey").cast("string"))
    meta = F.concat(F.lit('<META content="/f'), F.col("p_size").cast("string"), F.lit('.pdf" name="citation_pdf_url">'))
    page = F.when(F.col("p_partkey") % 3 == 0, meta).when(F.col("p_partkey") % 3 == 1, F.lit("<a href=only.pdf>x</a>")).otherwise(F.lit("<a href=a.pdf>x</a><a href=b.pdf>y</a>"))
    return table(spark, d, "part").select(base.alias("url"), H.pdf_link(base, page).alias("pdf"))


@query()
def k22_fuzzy_score(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy scores of a fixed needle in all titles that contain it as a subsequence."""
    s = R.subsequence_score(F.lit("latrec"), F.col("display_title"))
    return table(spark, d, "graph_work").where("display_title is not null").select("id", s.alias("score")).where("score is not null")
