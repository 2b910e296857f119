"""Provider payloads written from the tables and read back, and caches of provider answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import providers as P
from ..session import table
from .catalog import query



def _works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "openalex_work").withColumn("num", F.substring("openalex_id", 2, 20).cast("bigint"))


def _work_json() -> Column:
    """A record as its provider writes it; every ninth has no id."""
    return F.struct(
        F.when(F.col("num") % 9 != 0, F.concat(F.lit("https://openalex.org/"), "openalex_id")).alias("id"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.concat(F.lit(" "), "title").alias("title"), F.col("year").cast("int").alias("publication_year"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), "referenced_works",
    )


@query("select openalex_id as id, lower(doi) as doi, nullif(trim(title), '') as title, cast(\"year\" as int) as \"year\", coalesce(array_to_string(list_filter(authors, lambda x: x <> ''), '|'), '') as authors, len(coalesce(referenced_works, [])) as referenced from openalex_work where cast(substr(openalex_id, 2) as bigint) % 9 <> 0")
def s10_parse_work(spark: SparkSession, d: str) -> DataFrame:
    """Provider records as JSON and parsed back, with authors and references; those without an id are errors."""
    w = _works(spark, d).select(S.parse_work(F.to_json(_work_json())).alias("w")).where("w is not null")
    return w.select("w.id", "w.doi", "w.title", "w.year", F.array_join("w.authors", "|").alias("authors"), F.size("w.referenced").cast("bigint").alias("referenced"))


@query("select openalex_id as id, lower(doi) as doi, nullif(trim(title), '') as title, cast(\"year\" as int) as \"year\", list_filter(authors, lambda x: x <> '')[1] as first_author, len(coalesce(referenced_works, [])) as referenced from openalex_work where cast(substr(openalex_id, 2) as bigint) % 9 <> 0")
def s11_parse_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of provider records; fields of a wrong type are null, not errors."""
    w = _works(spark, d).select(S.parse_work(F.to_json(_work_json())).alias("w")).where("w is not null")
    return w.select("w.id", "w.doi", "w.title", "w.year", F.get("w.authors", F.lit(0)).alias("first_author"), F.size("w.referenced").cast("bigint").alias("referenced"))


def _crossref_json() -> Column:
    return F.struct(
        F.upper("doi").alias("DOI"), F.array(F.concat(F.lit("<i>"), "title", F.lit("</i>"))).alias("title"), F.transform("authors", lambda a: F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), a.alias("name"))).alias("author"),
        F.array(F.lit("Journal of Tests")).alias("container-title"), F.struct(F.array(F.array(F.col("year").cast("int"), F.lit(3))).alias("date-parts")).alias("issued"), F.when(F.col("num") % 4 == 0, "posted-content").when(F.col("num") % 4 == 1, "journal-article").alias("type"),
    )


@query("select openalex_id as id, lower(doi) as doi, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, array_to_string(authors, '|') as authors, 'Journal of Tests' as venue, cast(\"year\" as int) as \"year\" from openalex_work")
def s13_parse_crossref_work(spark: SparkSession, d: str) -> DataFrame:
    """Records as the other provider writes them, markup stripped."""
    w = _works(spark, d).select("openalex_id", S.parse_crossref(F.to_json(_crossref_json())).alias("w"))
    return w.select(F.col("openalex_id").alias("id"), "w.doi", "w.title", F.array_join("w.authors", "|").alias("authors"), "w.venue", "w.year")


def _pages(spark: SparkSession, d: str, item: Column) -> DataFrame:
    """Answers of 25 records each."""
    return _works(spark, d).select((F.col("num") / 25).cast("bigint").alias("page"), item.alias("x")).groupBy("page").agg(F.collect_list("x").alias("xs"))


def _shown(c: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("c.identifiers", lambda x: F.concat(x["scheme"], F.lit(":"), x["value"])), "|")
    return c.select("c.source_id", "c.title", F.array_join("c.authors", "|").alias("authors"), "c.year", "c.venue", ids.alias("identifiers"), "c.version_kind", "c.cited_by_count")


_PREPRINT = "regexp_matches(lower(doi), '^10[.](48550|1101|31219|21203|2139)/')"


@query(f"select openalex_id as source_id, nullif(trim(title), '') as title, coalesce(array_to_string(list_filter(authors, lambda x: x <> ''), '|'), '') as authors, cast(\"year\" as int) as \"year\", null::varchar as venue, 'openalex:' || openalex_id || coalesce('|doi:' || lower(doi), '') as identifiers, case when doi is null then 'unknown' when {_PREPRINT} then 'preprint' else 'published' end as version_kind, null::bigint as cited_by_count from openalex_work where cast(substr(openalex_id, 2) as bigint) % 9 <> 0")
def s14_parse_openalex_candidates(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, _work_json()).select(F.to_json(F.struct(F.col("xs").alias("results"))).alias("payload"))
    return _shown(pages.select(F.explode(P.openalex_candidates(F.col("payload"))).alias("c")))


@query("select lower(doi) as source_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) as title, coalesce(array_to_string(authors, '|'), '') as authors, cast(\"year\" as int) as \"year\", 'Journal of Tests' as venue, 'doi:' || lower(doi) as identifiers, case cast(substr(openalex_id, 2) as bigint) % 4 when 0 then 'preprint' when 1 then 'published' else 'unknown' end as version_kind, null::bigint as cited_by_count from openalex_work where doi is not null and doi <> ''")
def s15_parse_crossref_candidates(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, _crossref_json()).select(F.to_json(F.struct(F.struct(F.col("xs").alias("items")).alias("message"))).alias("payload"))
    return _shown(pages.select(F.explode(P.crossref_candidates(F.col("payload"))).alias("c")))


@query(f"select 'p' || openalex_id as source_id, nullif(trim(title), '') as title, coalesce(array_to_string(authors, '|'), '') as authors, cast(\"year\" as int) as \"year\", 'Tests' as venue, 'semantic_scholar:p' || openalex_id || coalesce('|doi:' || lower(doi), '') || case when cast(substr(openalex_id, 2) as bigint) % 2 = 0 then '|arxiv:2101.00001' else '' end as identifiers, case when doi is null then case when cast(substr(openalex_id, 2) as bigint) % 2 = 0 then 'preprint' else 'unknown' end when {_PREPRINT} then 'preprint' else 'published' end as version_kind, cast(len(coalesce(referenced_works, [])) as bigint) as cited_by_count from openalex_work where cast(substr(openalex_id, 2) as bigint) % 9 <> 0")
def s16_parse_semantic_scholar_candidates(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(
        F.when(F.col("num") % 9 != 0, F.concat(F.lit(" p"), "openalex_id")).otherwise(F.lit("  ")).alias("paperId"), "title", F.col("year").cast("int").alias("year"), F.lit("Tests").alias("venue"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
        F.struct(F.upper("doi").alias("DOI"), F.when(F.col("num") % 2 == 0, "2101.00001").alias("ArXiv")).alias("externalIds"), F.coalesce(F.size("referenced_works"), F.lit(0)).alias("citationCount"),
    )
    pages = _pages(spark, d, item).select(F.to_json(F.struct(F.col("xs").alias("data"))).alias("payload"))
    return _shown(pages.select(F.explode(P.semantic_scholar_candidates(F.col("payload"))).alias("c")))


ASKED = "k as (select distinct value_normalized as key from work_identifier where scheme = 'openalex' and value_normalized <> '' union select 'W' || i from range(5) as r(i) union select openalex_id from openalex_work where cast(substr(openalex_id, 2) as bigint) % 7 <> 0), s as (select openalex_id as key, cast(substr(openalex_id, 2) as bigint) as num, title from openalex_work)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "work_identifier").where("scheme = 'openalex' and value_normalized <> ''").select(F.col("value_normalized").alias("key"))
    keys = keys.unionByName(_works(spark, d).where("num % 7 <> 0").select(F.col("openalex_id").alias("key")))
    return keys.unionByName(spark.range(5).select(F.concat(F.lit("W"), F.col("id").cast("string")).alias("key"))).distinct()


def _store(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers: of every third record none, of some one that can't be read, of some that there is no record."""
    n = F.col("num") % 6
    payload = F.when(n == 1, P.NOT_FOUND).when(n == 2, "{broken").otherwise(F.to_json(F.struct(F.col("openalex_id").alias("id"), "title")))
    return _works(spark, d).where("num % 3 <> 0 or num % 6 = 3").select(F.col("openalex_id").alias("key"), payload.alias("payload"))


def _provider(spark: SparkSession, d: str):
    """A stand-in for the provider: it knows all records."""
    known = _works(spark, d).select(F.col("openalex_id").alias("key"), F.to_json(F.struct(F.col("openalex_id").alias("id"), "title")).alias("payload"))
    return lambda miss: miss.join(known, "key")


READABLE = lambda p: F.get_json_object(p, "$.id").isNotNull()


@query(f"with {ASKED} select k.key, case when s.key is null then 'miss' when num % 6 = 0 then 'provider' else 'cache' end as source, case when s.key is null or num % 6 = 1 then false else true end as known from k left join s using (key)")
def s17_fetch_summaries_cached(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers as they are, the rest from the provider, unknown keys as misses."""
    rows = P.cached(_asked(spark, d), _store(spark, d), "key", fetch=_provider(spark, d))
    return rows.select("key", "source", F.col("payload").isNotNull().alias("known"))


@query(f"with {ASKED} select k.key, case when s.key is null then 'miss' else 'provider' end as source from k left join s using (key)")
def s18_fetch_counts_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """With refresh every key is asked anew."""
    return P.cached(_asked(spark, d), _store(spark, d), "key", refresh=True, fetch=_provider(spark, d)).select("key", "source")


@query(f"with {ASKED} select k.key, case when s.key is null then 'miss' when num % 6 in (0, 2) then 'provider' else 'cache' end as source from k left join s using (key)")
def s29_fetch_work_cached_record(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers that can't be read are asked again."""
    return P.cached(_asked(spark, d), _store(spark, d), "key", readable=READABLE, fetch=_provider(spark, d)).select("key", "source")


@query(f"with {ASKED} select k.key, case when s.key is null or num % 6 in (0, 2) then 'miss' else 'cache' end as source, s.key is not null and num % 6 = 1 as not_found from k left join s using (key)")
def s20_negative_cache(spark: SparkSession, d: str) -> DataFrame:
    """A stored "not found" is an answer; without a provider the rest are misses."""
    rows = P.cached(_asked(spark, d), _store(spark, d), "key", readable=READABLE)
    return rows.select("key", "source", ((F.col("source") == "cache") & F.col("payload").isNull()).alias("not_found"))


@query("with q as (select distinct lower(trim(title)) || '|' || coalesce(cast(\"year\" as varchar), '') as key from title_query where title is not null), s as (select lower(trim(title)) || '|' || cast(\"year\" as varchar) as key, min(openalex_id) as id from openalex_work where title is not null and \"year\" is not null group by 1) select q.key, s.id, case when s.id is null then 'miss' else 'cache' end as source from q left join s using (key)")
def s19_search_title_cached(spark: SparkSession, d: str) -> DataFrame:
    """Title searches answered from a cache by title and year."""
    key = lambda y: F.concat(F.lower(F.trim("title")), F.lit("|"), y)
    asked = table(spark, d, "title_query").where("title is not null").select(key(F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("key"))
    store = table(spark, d, "openalex_work").where("title is not null and year is not null").groupBy(key(F.col("year").cast("int").cast("string")).alias("key")).agg(F.min("openalex_id").alias("payload"))
    return P.cached(asked, store, "key").select("key", F.col("payload").alias("id"), "source")


COLLECT_LIMIT = 60


def _collect_sql(total: str) -> str:
    return f"""with e as (select l_orderkey % 200 as work, l_linenumber as page, l_orderkey as ok, l_partkey % 300 as neighbor from lineitem), f as (select work, neighbor, min(struct_pack(page := page, ok := ok)) as pos from e where work <> neighbor group by all),
 n as (select work, count(*) as n, {total} as total from f group by work), r as (select work, neighbor, row_number() over (partition by work order by pos, neighbor) as place from f)
 select r.work, r.neighbor, r.place, case when n > {COLLECT_LIMIT} then 'capped' when total is null or n >= total then 'complete' else 'partial' end as coverage from r join n using (work) where place <= {COLLECT_LIMIT}"""


def _collect(spark: SparkSession, d: str, total: Column) -> DataFrame:
    """Pages of answers made of order lines: the order's number stands for the place on the page."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("work"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("ok"), (F.col("l_partkey") % 300).alias("neighbor"))
    pages = rows.groupBy("work", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ok", "neighbor"))), lambda x: x["neighbor"]).alias("ids")).withColumn("total", total)
    return P.collected(pages, COLLECT_LIMIT)


@query(_collect_sql("case when work % 2 = 0 then count(*) else 1000 end"))
def s32_collect_paged(spark: SparkSession, d: str) -> DataFrame:
    """Neighbors of paged answers, distinct, to the limit, with what the pages cover."""
    return _collect(spark, d, F.when(F.col("work") % 2 == 0, F.lit(0)).otherwise(F.lit(1000)).cast("bigint"))


@query(_collect_sql("null::bigint"))
def s34_collect_unpaged(spark: SparkSession, d: str) -> DataFrame:
    """The same from answers that count nothing: what is listed is complete."""
    return _collect(spark, d, F.lit(None).cast("bigint"))


@query("select openalex_id as work, r.ref as neighbor, cast(r.i as bigint) as place, case when len(referenced_works) = 0 then 'unavailable' else 'complete' end as coverage from openalex_work w, (select openalex_id as oid, unnest(referenced_works) as ref, generate_subscripts(referenced_works, 1) as i from openalex_work) r where r.oid = w.openalex_id union all select openalex_id, null, null, 'unavailable' from openalex_work where referenced_works is null or len(referenced_works) = 0")
def s33_collect_references(spark: SparkSession, d: str) -> DataFrame:
    """Deposited lists of references in order; a record without one is unavailable in this direction."""
    w = table(spark, d, "openalex_work")
    rows = w.select(F.col("openalex_id").alias("work"), F.posexplode_outer("referenced_works").alias("i", "neighbor"))
    return rows.select("work", "neighbor", (F.col("i") + 1).cast("bigint").alias("place"), F.when(F.col("i").isNull(), "unavailable").otherwise("complete").alias("coverage"))


@query("select r.i as place, r.ref as neighbor, w.openalex_id as work, t.openalex_id is not null as resolved, r.i % 2 = 1 as influential from openalex_work w, (select openalex_id as oid, unnest(referenced_works) as ref, generate_subscripts(referenced_works, 1) as i from openalex_work) r left join openalex_work t on t.openalex_id = r.ref where r.oid = w.openalex_id")
def s35_collect_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their flags; neighbors that no record resolves are kept."""
    w = table(spark, d, "openalex_work")
    json = F.to_json(F.struct(F.transform("referenced_works", lambda r, i: F.struct(r.alias("paperId"), ((i + 1) % 2 == 1).alias("isInfluential"))).alias("data")))
    rows = w.select(F.col("openalex_id").alias("work"), F.posexplode(F.from_json(json, "data array<struct<paperId:string,isInfluential:boolean>>")["data"]).alias("i", "x"))
    known = w.select(F.col("openalex_id").alias("neighbor"), F.lit(True).alias("k"))
    return rows.select("work", (F.col("i") + 1).cast("bigint").alias("place"), F.col("x.paperId").alias("neighbor"), F.col("x.isInfluential").alias("influential")).join(known, "neighbor", "left").select("work", "place", "neighbor", F.coalesce("k", F.lit(False)).alias("resolved"), "influential")


@query("select openalex_id, array_to_string(list_slice(referenced_works, 1, 12), '|') as edges from openalex_work where length(to_json(list_slice(referenced_works, 1, 12))) <= 100000")
def s36_research_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each report cut to its first twelve edges (the operator's own limit); reports of over 100,000 characters are dropped."""
    cut = F.slice("referenced_works", 1, 12)
    return table(spark, d, "openalex_work").where(F.length(F.to_json(cut)) <= 100_000).select("openalex_id", F.array_join(cut, "|").alias("edges"))


@query("select p_partkey as page, cast(p_size as bigint) as words, 0.5::double as confidence from part where p_size > 0")
def s22_parse_tsv(spark: SparkSession, d: str) -> DataFrame:
    """OCR words of level 5 and a score of 25 or more; other levels, low scores and short lines don't count."""
    row = lambda level, score: F.concat(F.lit(f"{level}\t1\t1\t1\t1\t1\t0\t0\t9\t9\t{score}\tword"))
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.explode(F.concat(F.array_repeat(row(5, 50), F.col("p_size")), F.array(row(4, 90), row(5, 10), F.lit("5\t1")))).alias("line"))
    return S.parse_ocr_tsv(lines).select("page", "words", "confidence")


@query("select p_partkey as id, p_name as title, 'A: ' || p_brand as author, cast(p_size as varchar) as pages from part")
def s24_parse_pdf_info(spark: SparkSession, d: str) -> DataFrame:
    """Lines of key and value; values may hold colons, keys differ in case."""
    text = F.concat(F.lit("Title:  "), "p_name", F.lit("\nAUTHOR: A: "), "p_brand", F.lit("\nno key\nPages:"), F.col("p_size").cast("string"), F.lit("\nTitle: second"))
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.parse_pdf_info(text).alias("m"))
    return m.select("id", F.col("m")["title"].alias("title"), F.col("m")["author"].alias("author"), F.col("m")["pages"].alias("pages"))


@query("select p_partkey as page, cast(i as int) as place, p_brand || '&' || i as word, cast(i * 10 as double) as \"xMin\" from part, range(3) as r(i)")
def s21_parse_page_words(spark: SparkSession, d: str) -> DataFrame:
    """Words and boxes of page XML."""
    word = lambda i: F.concat(F.lit(f'<word xMin="{i * 10}" yMin="1" xMax="{i * 10 + 8}" yMax="9">'), "p_brand", F.lit(f"&amp;{i}</word>"))
    xml = F.concat(F.lit("<page>"), word(0), F.lit("<line>"), word(1), word(2), F.lit("</line></page>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.posexplode(S.page_words(xml)).alias("place", "w")).select("page", "place", F.col("w.text").alias("word"), F.col("w.xMin").alias("xMin"))


@query("select doc_id, source, length(text) as n from documents where length(text) between 500 and 5000 qualify row_number() over (partition by source, lang order by doc_id) <= 10")
def s27_select(spark: SparkSession, d: str) -> DataFrame:
    """A sample's documents: of fitting length, the first ten of each source and language (the operator samples)."""
    from ..operators.topk import top_k

    rows = table(spark, d, "documents").where(F.length("text").between(500, 5000)).select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("n"))
    return top_k(rows, ["source", "lang"], [F.asc("doc_id")], 10, "doc_id").select("doc_id", "source", "n")
