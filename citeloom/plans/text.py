"""Scalar functions over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from .catalog import query


@query(r"select id, case when regexp_full_match(lower(trim(value_normalized)), '10\.[0-9]{4,9}/[^\s]+') then lower(trim(value_normalized)) end as doi from work_identifier where scheme = 'doi'")
def f04_normalize_doi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_identifier").where("scheme = 'doi'").select("id", T.normalize_doi(F.concat(F.lit("https://doi.org/"), F.trim("value_normalized"))).alias("doi"))


@query(r"select id, case when regexp_full_match(lower(trim(value_normalized)), '[0-9]{4}\.[0-9]{4,5}') then lower(trim(value_normalized)) end as arxiv from work_identifier where scheme = 'arxiv'")
def f05_normalize_arxiv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_identifier").where("scheme = 'arxiv'").select("id", T.normalize_arxiv(F.concat(F.lit("arXiv:"), F.trim("value_normalized"), F.lit("v2"))).alias("arxiv"))


@query(r"select id, coalesce(regexp_full_match(value_normalized, '10\.[0-9]{4,9}/.+'), false) as shaped from work_identifier")
def f06_doi_has_shape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_identifier").select("id", F.coalesce(F.col("value_normalized").rlike(r"^10\.[0-9]{4,9}/.+$"), F.lit(False)).alias("shaped"))


@query(r"select id, coalesce(regexp_full_match(value_normalized, '[0-9]{4}\.[0-9]{4,5}|[a-z-]+(\.[a-z]{2})?/[0-9]{7}'), false) as valid from work_identifier")
def f07_is_valid_arxiv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_identifier").select("id", F.coalesce(F.col("value_normalized").rlike(f"^({T.ARXIV_NEW}|{T.ARXIV_OLD})$"), F.lit(False)).alias("valid"))


@query("select id, list_position(['user','publisher','paper','openalex','library_metadata','citing_bibliography'], origin) - 1 as origin_rank, list_position(['explicit','heuristic','model'], confidence) - 1 as confidence_rank from field_claim")
def f16_selection_rank(spark: SparkSession, d: str) -> DataFrame:
    o, c = (F.array(*map(F.lit, x)) for x in (["user", "publisher", "paper", "openalex", "library_metadata", "citing_bibliography"], ["explicit", "heuristic", "model"]))
    return table(spark, d, "field_claim").select("id", (F.array_position(o, F.col("origin")) - 1).cast("int").alias("origin_rank"), (F.array_position(c, F.col("confidence")) - 1).cast("int").alias("confidence_rank"))


@query(r"select id, try_cast(regexp_extract(fields ->> '$.year.value', '^([0-9]{4})[a-z]?', 1) as int) as year from bibliography_entry")
def f38_leading_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bibliography_entry").select("id", T.leading_year(F.get_json_object("fields", "$.year.value")).alias("year"))


@query("select openalex_id, regexp_replace('https://openalex.org/' || openalex_id, '^https?://(api\\.)?openalex\\.org/', '') as short from openalex_work")
def f42_short_openalex_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "openalex_work").select("openalex_id", F.regexp_replace(F.concat(F.lit("https://openalex.org/"), "openalex_id"), r"^https?://(api\.)?openalex\.org/", "").alias("short"))


@query("select openalex_id, doi is not null and not starts_with(lower(doi), '10.48550/') as crossref from openalex_work")
def f50_is_crossref_doi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "openalex_work").select("openalex_id", (F.col("doi").isNotNull() & ~F.coalesce(F.lower("doi").startswith("10.48550/"), F.lit(False))).alias("crossref"))


@query("select doc_id, case when text like '<%' then 'html' when text like '%PDF-%' then 'pdf' else 'text' end as class from documents where text is not null")
def f61_classify_content(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(t.startswith("<"), "html").when(t.contains("PDF-"), "pdf").otherwise("text").alias("class"))


@query("select doc_id, 'sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' as key from documents where text is not null")
def f64_blob_storage_key(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("text", 256)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("sha256/"), F.left(h, F.lit(2)), F.lit("/"), h, F.lit(".txt")).alias("key"))


@query(r"select item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as canonical from eval_item")
def f66_canonical_chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item").select("item_id", T.compact(F.col("text")).alias("canonical"))


@query(r"select doc_id, regexp_replace(text, '([a-z])([,;:])([a-z])', '\1\2 \3', 'g') as repaired from documents where text is not null")
def f104_repair_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "([a-z])([,;:])([a-z])", "$1$2 $3").alias("repaired"))


@query("select id, upper(regexp_replace(printed_key, '[\\s\\[\\]()]', '', 'g')) as number from bibliography_entry where printed_key is not null")
def f114_normalized_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bibliography_entry").where("printed_key is not null").select("id", F.upper(F.regexp_replace("printed_key", r"[\s\[\]()]", "")).alias("number"))


@query("select event_id, round(value * 0.000002 + coalesce(try_cast(props ->> '$.k' as bigint), 0) * 0.00001, 9) as cost from events")
def f122_completion_cost(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    return table(spark, d, "events").select("event_id", F.round(F.col("value") * 0.000002 + tokens * 0.00001, 9).alias("cost"))


@query("select id, regexp_extract_all(lower(display_title), '[a-z]{2,}') as words from graph_work where display_title is not null")
def f126_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_work").where("display_title is not null").select("id", F.regexp_extract_all(F.lower("display_title"), F.lit("([a-z]{2,})"), F.lit(1)).alias("words"))


@query("select id, case when display_year between 1 and 2200 then display_year end as year from graph_work")
def f130_histogram_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_work").select("id", F.when(F.col("display_year").between(1, 2200), F.col("display_year")).alias("year"))


@query("select p_partkey, case when p_size <= 5 then 0 when p_size between 41 and 45 then 2 when p_size >= 46 then 3 else 1 end as mark_rank from part")
def f131_mark_rank(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.prominence import mark_rank

    s = F.col("p_size")
    mark = F.when(s <= 5, "pinned").when(s.between(41, 45), "downplayed").when(s >= 46, "hidden")
    return table(spark, d, "part").select("p_partkey", mark_rank(mark).alias("mark_rank"))


@query("select n_nationkey, '#' || repeat(substr(lower(to_hex(n_nationkey)), -1), 6) as color from nation")
def f133_tag_color(spark: SparkSession, d: str) -> DataFrame:
    short = F.concat(F.lit("#"), F.repeat(F.right(F.hex("n_nationkey"), F.lit(1)), F.lit(3)))
    return table(spark, d, "nation").select("n_nationkey", T.color(short).alias("color"))


@query("select p_partkey, round(3.5 + 3.5 * greatest(0, least(1, p_retailprice / 2000)), 6) as radius from part")
def f134_node_radius(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(3.5 + 3.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_retailprice") / 2000)), 6).alias("radius"))


@query("select doc_id, len(regexp_extract_all(lower(text), 'lattice')) as hits from documents where text is not null")
def f135_regex_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_count(F.lower("text"), F.lit("lattice")).cast("bigint").alias("hits"))


@query("select id, case when scheme in ('doi', 'openalex', 'isbn') then 'work' else 'version' end as level from work_identifier")
def f139_identifier_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_identifier").select("id", F.when(F.col("scheme").isin("doi", "openalex", "isbn"), "work").otherwise("version").alias("level"))


@query("select id, case scheme when 'arxiv' then 'doi:10.48550/arxiv.' || value_normalized else scheme || ':' || value_normalized end as key from work_identifier where value_normalized <> ''")
def f140_provider_key(spark: SparkSession, d: str) -> DataFrame:
    s, v = F.col("scheme"), F.col("value_normalized")
    return table(spark, d, "work_identifier").where("value_normalized <> ''").select("id", F.when(s == "arxiv", F.concat(F.lit("doi:10.48550/arxiv."), v)).otherwise(F.concat(s, F.lit(":"), v)).alias("key"))


@query("select id, case when scheme = 'arxiv' or starts_with(value_normalized, '10.48550/') then 'preprint' when scheme = 'doi' then 'published' else 'unknown' end as kind from work_identifier where value_normalized is not null")
def f147_infer_version_kind(spark: SparkSession, d: str) -> DataFrame:
    s, v = F.col("scheme"), F.col("value_normalized")
    return table(spark, d, "work_identifier").where("value_normalized is not null").select("id", F.when((s == "arxiv") | v.startswith("10.48550/"), "preprint").when(s == "doi", "published").otherwise("unknown").alias("kind"))


@query("select paper_id, sha256(text) as fingerprint from reading_index where text is not null")
def f152_source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reading_index").where("text is not null").select("paper_id", F.sha2("text", 256).alias("fingerprint"))


@query("select paper_id, cast(ceil(len(pages) / 4.0) as bigint) as low, cast(ceil(len(pages) / 2.0) as bigint) as high from reading_index where pages is not null")
def f156_sections_guidance(spark: SparkSession, d: str) -> DataFrame:
    n = F.size("pages")
    return table(spark, d, "reading_index").where("pages is not null").select("paper_id", F.ceil(n / 4).alias("low"), F.ceil(n / 2).alias("high"))


@query("select user_id as job, cast(floor(avg(case event_type when 'purchase' then 100 when 'error' then 50 when 'click' then 50 else 0 end)) as bigint) as progress from events group by user_id")
def f159_progress(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.floor(F.avg(F.when(e == "purchase", 100).when(e.isin("error", "click"), 50).otherwise(0))).alias("progress"))


@query("select doc_id, case when length(text) >= 4500 then 3 when length(text) >= 1200 then 2 else 1 end as width from documents where text is not null")
def f160_tile_width(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(n >= 4500, 3).when(n >= 1200, 2).otherwise(1).alias("width"))
