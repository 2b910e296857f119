"""Audits of reading indexes and of runs, rectangles and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .catalog import query

PAGES = "p as (select r.paper_id, length(r.text) as n, u.p.page_number as page, u.p.provenance as provenance, u.p.confidence as confidence, u.p.text_start as lo, u.p.text_end as hi, trim(substr(r.text, u.p.text_start + 1, u.p.text_end - u.p.text_start), E' \\t\\n\\r') = '' as blank from reading_index r, unnest(r.pages) as u(p) where r.text is not null)"
TOKENS = "t as (select paper_id, page, count(*) as tokens, count(*) filter (regexp_full_match(text, '[0-9]+')) as numbers, count(*) filter (length(text) = 1) as singles, max(length(text)) as longest from reading_token group by 1, 2)"
SENTENCES = "s as (select r.paper_id, count(*) as sentences, count(*) filter (s.s.range_end - s.s.range_start > 400) as long_sentences, count(*) filter (s.s.range_end <= s.s.range_start) as empty_sentences from reading_index r, unnest(r.sentence) as s(s) where r.text is not null group by 1)"


@query(f"""with {PAGES}, {TOKENS}, {SENTENCES}, g as (select p.paper_id, count(*) as pages, count(*) filter (provenance = 'native') as native, count(*) filter (provenance = 'ocr') as ocr, count(*) filter (provenance = 'unavailable') as unavailable, count(*) filter (blank) as blank, count(*) filter (provenance = 'ocr' and confidence is null) as unknown_confidence, count(*) filter (confidence < 0.7) as weak,
  round(avg(confidence), 4) as mean_confidence, count(*) filter (hi < lo or hi > n) as bad_ranges, cast(sum(coalesce(t.tokens, 0)) as bigint) as tokens, cast(sum(coalesce(t.numbers, 0)) as bigint) as numbers, cast(sum(coalesce(t.singles, 0)) as bigint) as singles, max(t.longest) as longest_token, count(*) filter (t.tokens is null) as pages_without_tokens, max(n) as chars from p left join t on t.paper_id = p.paper_id and t.page = p.page group by p.paper_id)
 select g.*, coalesce(s.sentences, 0) as sentences, coalesce(s.long_sentences, 0) as long_sentences, coalesce(s.empty_sentences, 0) as empty_sentences from g left join s using (paper_id)""")
def a08_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Nineteen counters of every index: pages by kind, confidence, ranges, tokens, sentences."""
    r = table(spark, d, "reading_index").where("text is not null")
    p = r.select("paper_id", "text", F.explode("pages").alias("p")).select("paper_id", F.length("text").alias("n"), F.col("p.page_number").alias("page"), "p.provenance", "p.confidence", F.col("p.text_start").alias("lo"), F.col("p.text_end").alias("hi"), (F.regexp_replace(F.substr("text", F.col("p.text_start") + 1, F.col("p.text_end") - F.col("p.text_start")), r"[ \t\n\r]", "") == "").alias("blank"))
    t = table(spark, d, "reading_token").groupBy("paper_id", "page").agg(F.count("*").alias("tokens"), F.count_if(F.col("text").rlike("^[0-9]+$")).alias("numbers"), F.count_if(F.length("text") == 1).alias("singles"), F.max(F.length("text")).alias("longest"))
    s = r.select("paper_id", F.explode("sentence").alias("s")).select("paper_id", (F.col("s.range_end") - F.col("s.range_start")).alias("size")).groupBy("paper_id").agg(F.count("*").alias("sentences"), F.count_if(F.col("size") > 400).alias("long_sentences"), F.count_if(F.col("size") <= 0).alias("empty_sentences"))
    kind = lambda k: F.count_if(F.col("provenance") == k).alias(k)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    g = p.join(t, ["paper_id", "page"], "left").groupBy("paper_id").agg(
        F.count("*").alias("pages"), kind("native"), kind("ocr"), kind("unavailable"), F.count_if("blank").alias("blank"), F.count_if((F.col("provenance") == "ocr") & F.col("confidence").isNull()).alias("unknown_confidence"), F.count_if(F.col("confidence") < F.lit(0.7)).alias("weak"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if((F.col("hi") < F.col("lo")) | (F.col("hi") > F.col("n"))).alias("bad_ranges"), total("tokens"), total("numbers"), total("singles"), F.max("longest").cast("bigint").alias("longest_token"), F.count_if(F.col("tokens").isNull()).alias("pages_without_tokens"), F.max("n").cast("bigint").alias("chars"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("sentences", "long_sentences", "empty_sentences")]
    return g.join(s, "paper_id", "left").select(*g.columns, *zero)


@query(r"with m as (select document_version_id, lower(regexp_extract(passage, '(?i)\b(fig|tab|eq)[a-z]*\.? ?S?[0-9]{1,4}\b', 1)) as kind, upper(regexp_extract(passage, '(?i)\b(?:fig|tab|eq)[a-z]*\.? ?(S?[0-9]{1,4})\b', 1)) as number from citation_mention where regexp_matches(passage, '(?i)\b(fig|tab|eq)[a-z]*\.? ?S?[0-9]{1,4}\b')) select document_version_id, kind, count(*) as mentions, count(distinct number) as numbers, max(try_cast(number as int)) as highest from m group by 1, 2")
def a12_count_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures, tables and equations that the passages of each document name."""
    pattern = r"(?i)\b(fig|tab|eq)[a-z]*\.? ?(S?[0-9]{1,4})\b"
    rows = table(spark, d, "citation_mention").where(F.col("passage").rlike(pattern)).select("document_version_id", F.lower(F.regexp_extract("passage", pattern, 1)).alias("kind"), F.upper(F.regexp_extract("passage", pattern, 2)).alias("number"))
    return rows.groupBy("document_version_id", "kind").agg(F.count("*").alias("mentions"), F.countDistinct("number").alias("numbers"), F.max(F.col("number").try_cast("int")).alias("highest"))


BLOCKS = r"b as (select r.paper_id, generate_subscripts(string_split_regex(r.text, '\n[ \t]*\n'), 1) as i, unnest(string_split_regex(r.text, '\n[ \t]*\n')) as b from reading_index r where r.text is not null), k as (select paper_id, i, length(b) as size, case when regexp_matches(b, '^\s*(\[[0-9]+\]|[-•*–] )') then 'list' when not contains(b, chr(10)) and length(b) <= 90 and not regexp_matches(b, '[.,;:!?。！？।؟]\s*$') then 'heading' when regexp_matches(b, '^\s*\(?[0-9]+\)?\s*$') then 'number' else 'body' end as kind from b where trim(b, E' \t\n\r') <> '')"


@query(f"with {BLOCKS} select paper_id, kind, count(*) as blocks, max(size) as longest, count(*) filter (size > 4000) as oversize from k group by 1, 2")
def a11_count_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each paper by kind: lists, headings, numbers, body."""
    return _blocks(spark, d).groupBy("paper_id", "kind").agg(F.count("*").alias("blocks"), F.max("size").alias("longest"), F.count_if(F.col("size") > 4000).alias("oversize"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "reading_index").where("text is not null").select("paper_id", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("i", "b")).where(F.regexp_replace("b", r"[ \t\n\r]", "") != "")
    head = ~F.contains("b", F.lit("\n")) & (F.length("b") <= 90) & ~F.col("b").rlike(r"[.,;:!?。！？।؟]\s*\z")
    kind = F.when(F.col("b").rlike(r"^\s*(\[[0-9]+\]|[-•*–] )"), "list").when(head, "heading").when(F.col("b").rlike(r"^\s*\(?[0-9]+\)?\s*\z"), "number").otherwise("body")
    return b.select("paper_id", (F.col("i") + 1).cast("bigint").alias("i"), F.length("b").cast("bigint").alias("size"), kind.alias("kind"))


@query(f"with {BLOCKS} select paper_id, i, kind, size from k")
def f106_parse_page(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of each paper in order."""
    return _blocks(spark, d)


RECTS = "r as (select l_suppkey as page, l_orderkey * 10 + l_linenumber as id, l_quantity * 10 as lo, l_quantity * 10 + l_discount * 60 as hi from lineitem)"


@query(f"with {RECTS}, s as (select *, case when lo <= max(hi) over (partition by page order by lo, id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from r), g as (select *, sum(fresh) over (partition by page order by lo, id) as grp from s) select page, min(lo) as lo, max(hi) as hi, count(*) as parts from g group by page, grp")
def f69_merged_rects(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of a page that overlap vertically merged by a sweep. A page's rectangles are one window; a page is bounded."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 10).alias("lo"), (F.col("l_quantity") * 10 + F.col("l_discount") * 60).alias("hi"))
    w = Window.partitionBy("page").orderBy("lo", "id")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(F.col("lo") <= reach, 0).otherwise(1))
    return fresh.withColumn("grp", F.sum("fresh").over(w)).groupBy("page", "grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parts")).drop("grp")


@query("with b as (select id, citing_version_id as doc, page, lower(trim(raw_text)) as k, ordinal from bibliography_entry), f as (select *, case when k is null or k = '' then 'empty' when page is null or page < 0 then 'range' when row_number() over (partition by doc, k order by ordinal, id) > 1 then 'repeated' end as reason from b) select doc, count(*) filter (reason is null) as kept, count(*) filter (reason = 'repeated') as repeated, count(*) filter (reason = 'range') as out_of_range, count(*) filter (reason = 'empty') as empty from f group by doc")
def a28_merge(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of chunks merged: empty ones, ones out of range and repeats are rejected, each with its reason. Repeats are counted by key, not by a window."""
    b = table(spark, d, "bibliography_entry").select(F.col("citing_version_id").alias("doc"), "page", F.lower(F.trim("raw_text")).alias("k"), "ordinal", "id")
    empty = F.col("k").isNull() | (F.col("k") == "")
    bad = F.coalesce(F.col("page") < 0, F.lit(True))
    rows = b.withColumn("reason", F.when(empty, "empty").when(bad, "range"))
    per = rows.groupBy("doc", "k").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "empty").alias("e"), F.count_if(F.col("reason") == "range").alias("r"), F.min_by("reason", F.struct("ordinal", "id")).alias("first"))
    good = F.col("n") - F.col("e") - F.col("r")
    kept = F.when(F.col("first").isNull() & (good > 0), 1).otherwise(0)
    return per.groupBy("doc").agg(F.sum(kept).alias("kept"), F.sum(good - kept).alias("repeated"), F.sum("r").alias("out_of_range"), F.sum("e").alias("empty"))
