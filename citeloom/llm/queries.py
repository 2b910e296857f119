"""Registered queries of this subpackage and, where SQL can state them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import components, leaks, linkage, names, ocr, oneform, packing, quality, sentences, survivor


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.native_sentences(table(spark, d, "reading_index"))


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "reading_index"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return oneform.found(table(spark, d, "reading_token"), table(spark, d, "citation_mention"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return oneform.groups(oneform.records_of(table(spark, d, "reading_token"), table(spark, d, "citation_mention")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noise(table(spark, d, "reading_index"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(table(spark, d, "reading_index"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "work_identifier").where("(status is null or status <> 'retracted') and value_normalized <> ''")
    return components.links_by_key(rows, ["scheme", "value_normalized"], "work_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(_linked(spark, d)).select(F.col("vertex").alias("work_id"), F.col("group").alias("group_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "field_claim")).select("work_id", "field", "claim_id")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "field_claim"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return names.author_names(table(spark, d, "graph_work"), table(spark, d, "openalex_work"), table(spark, d, "bibliography_entry"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.resolve(_names(spark, d)))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.resolve(_names(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matches(table(spark, d, "title_query"), table(spark, d, "bibliography_entry")).select("query_id", "entry_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matches(table(spark, d, "title_query"), table(spark, d, "bibliography_entry"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents")).where("text_type <> 'prose'").select("doc_id")


def p10_types(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"))


ALL = [p1_found, p1_sentences, p2_found, p2_groups, p3_found, p3_repaired, p4_found, p5_found, p5_survivors, p6_found, p6_entities, p7_found, p7_matches, p8_pack, p8_fill, p9_found, p10_found, p10_types, p10_statistics]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


P4_SQL = """
with recursive live as (
  select distinct work_id, scheme, value_normalized as v from work_identifier
  where status is distinct from 'retracted' and value_normalized <> '' and work_id is not null and scheme is not null
), hub as (select scheme, v, min(work_id) as h from live group by all having count(*) > 1),
edge as (select work_id as a, h as b from live join hub using (scheme, v) union select h, work_id from live join hub using (scheme, v)),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a)
select a as work_id, min(b) as group_id from reach group by a
"""

P5_SQL = r"""
with c as (
  select *, case when json_valid(value) then json_type(value) end as kind from field_claim
  where coalesce(review_state, '') <> 'rejected' and retracted_at is null and value is not null and work_id is not null and field is not null
), e as (
  select *, case when field = 'author' then cast(value as json)::varchar[] end as names, case when field in ('title', 'venue') then value::json ->> '$' end as txt from c
  where (field in ('title', 'venue') and kind = 'VARCHAR' and trim(value::json ->> '$', E' \t\n\r') <> '')
     or (field = 'year' and kind in ('BIGINT', 'UBIGINT'))
     or (field = 'author' and kind = 'ARRAY' and json_array_length(value) > 0 and list_bool_and(list_transform(json_extract(value, '$[*]'), lambda x: json_type(x) = 'VARCHAR')))
), k as (
  select *, coalesce(list_position(['user','publisher','paper','openalex','library_metadata','citing_bibliography'], origin), 7) * 4
       + coalesce(list_position(['explicit','heuristic','model'], confidence), 4) as tier,
    case when field = 'author' then array_to_string(list_transform(names, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), '|')
         when field = 'year' then trim(value) else regexp_replace(lower(txt), '[^\p{L}\p{N}]', '', 'g') end as agree,
    case when field <> 'author' then 0 when lower(trim(names[-1])) in ('et al', 'et al.') then -1 else len(names) end as complete
  from e
), s as (select *, count(*) over (partition by work_id, field, tier, agree) as support from k)
select work_id, field, id as claim_id from s
qualify row_number() over (partition by work_id, field order by tier, support desc, complete desc, created_at, id) = 1
"""


P10_SQL = r"""
with t as (select doc_id, text, length(text) as n, list_filter(string_split_regex(text, '[\t-\r ]+'), lambda w: w <> '') as words, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents)
select doc_id, cast(len(words) as bigint) as n_words,
  round(case when text is null then null when len(words) > 0 then coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::double / len(words) else 0.0 end, 6) as mean_word_length,
  round(case when text is null then null when n > 0 then length(regexp_replace(text, '[A-Za-z0-9\t-\r ]', '', 'g'))::double / n else 0.0 end, 6) as symbol_ratio,
  round(case when text is null then null when n > 0 then length(regexp_replace(text, '[^0-9]', '', 'g'))::double / n else 0.0 end, 6) as digit_ratio,
  cast(len(lines) as bigint) as n_lines,
  round(case when text is null then null when len(lines) > 0 then len(list_filter(lines, lambda x: regexp_matches(x, '[.!?。！？][\t-\r ]*$')))::double / len(lines) else 0.0 end, 6) as punctuated_share,
  round(case when text is null then null when len(words) > 0 then len(list_filter(words, lambda w: list_contains(%s, lower(w))))::double / len(words) else 0.0 end, 6) as common_share
from t
""" % sorted(quality.KNOWN)


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL, "p10_statistics": P10_SQL}
