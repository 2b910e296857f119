"""Links, addresses, codes and HTML, from the tables and from literal rows that show each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import links as L
from ..session import table
from .catalog import query


def _sql(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def literals(rows: list[tuple], names: str) -> str:
    """Literal rows in SQL."""
    return "select * from (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") as l({names})"


def _case(spark: SparkSession, rows: list[tuple], kind: str, out: Column) -> DataFrame:
    """The inputs of literal rows with what the function makes of them."""
    return spark.createDataFrame([(r[0],) for r in rows], f"x {kind}").select("x", out.alias("y"))


@query("select distinct id, replace(replace(rtrim(to_base64(unhex(replace(id, '-', ''))), '='), '+', '-'), '/', '_') as code from graph_work")
def f20_encode_uuid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_work").select("id", L.encode_uuid(F.col("id")).alias("code")).distinct()


CODES = [("AAAAAAAAAAAAAAAAAAAAAB", None), ("short", None), ("AAAAAAAAAAAAAAAAAAAAAA", "00000000-0000-0000-0000-000000000000"), ("AAAAAAAAAA+AAAAAAAAAAA", None)]


@query("select replace(replace(rtrim(to_base64(unhex(replace(id, '-', ''))), '='), '+', '-'), '/', '_') as code, id from graph_work union " + literals(CODES, "code, id"))
def f21_decode_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Codes back to ids; literal ones that are none give null."""
    rows = table(spark, d, "graph_work").select(L.encode_uuid(F.col("id")).alias("code")).unionByName(spark.createDataFrame([(c,) for c, _ in CODES], "code string")).distinct()
    return rows.select("code", L.decode_uuid(F.col("code")).alias("id"))


@query("select openalex_id, lower(doi) as doi from openalex_work where doi is not null")
def f43_normalize_doi(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import normalize_doi

    return table(spark, d, "openalex_work").where("doi is not null").select("openalex_id", normalize_doi(F.concat(F.lit(" HTTPS://dx.doi.org/"), F.upper("doi"), F.lit(" "))).alias("doi"))


@query("select openalex_id, 'https://api.openalex.org/works/' || coalesce(openalex_id, 'doi:' || doi) as url, 'https://api.crossref.org/works/' || replace(doi, '/', '%2F') as crossref_url, 'https://api.unpaywall.org/v2/' || replace(doi, '/', '%2F') || '?email=a%40b.org' as unpaywall_url from openalex_work")
def f45_work_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of a record at three providers, identifiers percent-encoded."""
    doi = F.url_encode("doi")
    return table(spark, d, "openalex_work").select(
        "openalex_id", F.concat(F.lit("https://api.openalex.org/works/"), F.coalesce("openalex_id", F.concat(F.lit("doi:"), "doi"))).alias("url"), F.concat(F.lit("https://api.crossref.org/works/"), doi).alias("crossref_url"),
        F.concat(F.lit("https://api.unpaywall.org/v2/"), doi, F.lit("?email="), F.url_encode(F.lit("a@b.org"))).alias("unpaywall_url"),
    )


@query("with n as (select openalex_id, row_number() over (order by openalex_id) - 1 as i from openalex_work), b as (select i // 50 as batch, string_agg(openalex_id, '|' order by openalex_id) as ids, count(*) as n from n group by 1) select batch, 'https://api.openalex.org/works?filter=openalex:' || ids || '&per-page=' || n as url, 'https://api.openalex.org/works?filter=openalex:' || ids || '&select=id,cited_by_count&per-page=' || n as metrics_url from b")
def f142_works_batch_url(spark: SparkSession, d: str) -> DataFrame:
    """Requests for fifty records at a time, whole and for their counts only."""
    from ..operators.topk import ranked

    rows = ranked(table(spark, d, "openalex_work").select("openalex_id"), [], ["openalex_id"], "i").withColumn("batch", F.floor((F.col("i") - 1) / 50))
    b = rows.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("openalex_id")), "|").alias("ids"), F.count("*").alias("n"))
    url = F.concat(F.lit("https://api.openalex.org/works?filter=openalex:"), "ids")
    return b.select("batch", F.concat(url, F.lit("&per-page="), F.col("n").cast("string")).alias("url"), F.concat(url, F.lit("&select=id,cited_by_count&per-page="), F.col("n").cast("string")).alias("metrics_url"))


@query("select id, lower(trim(coalesce(scheme, ''))) || ':' || lower(trim(coalesce(value_normalized, ''))) as key from work_identifier")
def f46_source_key(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return table(spark, d, "work_identifier").select("id", F.concat(part("scheme"), F.lit(":"), part("value_normalized")).alias("key"))


DATES = ["published-print", "published-online", "published", "issued"]


@query("select openalex_id, case when cast(substr(openalex_id, 2) as bigint) % 5 = 4 then null else cast(\"year\" as int) end as \"year\" from openalex_work")
def f48_first_date_year(spark: SparkSession, d: str) -> DataFrame:
    """The year of the first of four dates that a record has."""
    n = F.substring("openalex_id", 2, 20).cast("bigint") % 5
    part = lambda y: F.struct(F.array(F.array(y, F.lit(1))).alias("date-parts"))
    later = F.col("year").cast("int") + 7
    fields = [F.when(n == i, part(F.col("year").cast("int"))).when(n < i, part(later)).alias(k) for i, k in enumerate(DATES)]
    rows = table(spark, d, "openalex_work").select("openalex_id", F.to_json(F.struct(*fields)).alias("j"))
    return rows.select("openalex_id", F.coalesce(*(F.get_json_object("j", f"$['{k}']['date-parts'][0][0]") for k in DATES)).try_cast("int").alias("year"))


NAMES = [('{"given":"Jane","family":"Doe"}', "Jane Doe"), ('{"family":"Doe"}', "Doe"), ('{"given":"Jane"}', "Jane"), ('{"name":"The Group"}', "The Group"), ("{}", None)]


@query(literals(NAMES, "x, y") + " union select to_json({'given': n_name, 'family': 'R' || n_regionkey}) as x, n_name || ' R' || n_regionkey as y from nation")
def f49_author_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_name").alias("given"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("family"))).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(a,) for a, _ in NAMES], "x string"))
    j = F.from_json("x", "given string, family string, name string")
    return rows.select("x", F.coalesce(F.nullif(F.trim(F.concat_ws(" ", j["given"], j["family"])), F.lit("")), j["name"]).alias("y"))


URLS = [("HTTP://Example.ORG/A?b#c", "http://example.org/A?b"), ("https://arxiv.org/abs/2101.00001v2", "https://arxiv.org/pdf/2101.00001v2"), ("http://www.arxiv.org/pdf/hep-th/9901001.pdf", "https://arxiv.org/pdf/hep-th/9901001"), ("ftp://x.org/a", None), (" https://x.org ", "https://x.org/"), ("not a url", None), ("https://arxiv.org/list/cs", "https://arxiv.org/list/cs")]


@query(literals(URLS, "x, y"))
def f51_normalize_candidate_url(spark: SparkSession, d: str) -> DataFrame:
    return _case(spark, URLS, "string", L.normalize_link(F.col("x")))


def _oa(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    at = lambda p: F.concat(F.lit(f"https://x.org/{p}/"), k)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.to_json(F.struct(
            F.when(F.col("p_partkey") % 2 == 0, F.struct(at("best").alias("pdf_url"), at("land").alias("landing_page_url"))).alias("best_oa_location"), F.struct(F.when(F.col("p_partkey") % 3 == 0, F.lit("ftp://no")).otherwise(at("oa")).alias("oa_url")).alias("open_access"),
            F.array(F.struct(at("loc").alias("pdf_url"), F.lit(None).cast("string").alias("landing_page_url"), F.lit(True).alias("is_oa")), F.struct(at("closed").alias("pdf_url"), at("c").alias("landing_page_url"), F.lit(False).alias("is_oa"))).alias("locations"),
        )).alias("payload"),
    )


@query("select p_partkey as id, concat_ws('|', case when p_partkey % 2 = 0 then 'openalex_best=https://x.org/best/' || p_partkey end, case when p_partkey % 3 <> 0 then 'openalex_oa_url=https://x.org/oa/' || p_partkey end, 'openalex_location=https://x.org/loc/' || p_partkey, case when p_partkey % 2 = 0 then 'openalex_landing=https://x.org/land/' || p_partkey end) as links from part")
def f52_parse_openalex_oa(spark: SparkSession, d: str) -> DataFrame:
    """Links of open-access records in order; closed locations and other schemes are left out."""
    found = L.openalex_links(F.col("payload"))
    return _oa(spark, d).select("id", F.array_join(F.transform(found, lambda x: F.concat(x["origin"], F.lit("="), x["url"])), "|").alias("links"))


@query("select p_partkey as id, concat_ws('|', case when p_partkey % 2 = 0 then 'unpaywall_best=https://x.org/b/' || p_partkey end, 'unpaywall_location=https://x.org/p/' || p_partkey, case when p_partkey % 2 = 1 then 'unpaywall_landing=https://x.org/best/' || p_partkey end, 'unpaywall_landing=https://x.org/l/' || p_partkey) as links from part")
def f53_parse_unpaywall(spark: SparkSession, d: str) -> DataFrame:
    """Landing pages count only where there is no PDF."""
    k = F.col("p_partkey").cast("string")
    at = lambda p: F.concat(F.lit(f"https://x.org/{p}/"), k)
    none = F.lit(None).cast("string")
    payload = F.to_json(F.struct(F.struct(at("best").alias("url"), F.when(F.col("p_partkey") % 2 == 0, at("b")).alias("url_for_pdf")).alias("best_oa_location"), F.array(F.struct(at("x").alias("url"), at("p").alias("url_for_pdf")), F.struct(at("l").alias("url"), none.alias("url_for_pdf"))).alias("oa_locations")))
    found = L.unpaywall_links(payload)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(found, lambda x: F.concat(x["origin"], F.lit("="), x["url"])), "|").alias("links"))


@query("with u as (select p_partkey as id, unnest([struct_pack(o := 2, u := case when p_partkey % 2 = 0 then 'https://x.org/best/' || p_partkey end), struct_pack(o := 10, u := 'https://x.org/loc/' || p_partkey), struct_pack(o := 4, u := 'https://x.org/loc/' || p_partkey), struct_pack(o := 3, u := case when p_partkey % 3 <> 0 then 'https://x.org/oa/' || p_partkey end)]) as c from part) select id, c.u as url, min(c.o) as rank from u where c.u is not null group by 1, 2")
def k15_rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Links of every record by the rank of their origin; equal ones, once normalised, keep the best."""
    more = _oa(spark, d).select("id", F.concat(F.lit("HTTPS://X.org/loc/"), F.col("id").cast("string"), F.lit("#page")).alias("url"), F.lit("model").alias("origin"))
    found = _oa(spark, d).select("id", F.explode(L.openalex_links(F.col("payload"))).alias("x")).select("id", "x.url", "x.origin").where("origin <> 'openalex_landing'").unionByName(more)
    order = F.array(*map(F.lit, L.LINK_ORIGINS))
    rows = found.select("id", L.normalize_link(F.col("url")).alias("url"), F.array_position(order, F.col("origin")).cast("int").alias("rank")).where("url is not null")
    return rows.groupBy("id", "url").agg(F.min("rank").alias("rank"))


@query("with i as (select work_id, scheme, lower(trim(value_normalized)) as v, created_at, id from work_identifier where status = 'active' and work_id is not null and trim(value_normalized) <> ''), f as (select work_id, arg_min(v, struct_pack(c := created_at, i := id, v := v)) filter (scheme = 'doi') as doi, arg_min(v, struct_pack(c := created_at, i := id, v := v)) filter (scheme = 'arxiv') as arxiv, arg_min(upper(v), struct_pack(c := created_at, i := id, v := v)) filter (scheme = 'openalex') as openalex from i group by work_id) select work_id, doi, coalesce(arxiv, case when starts_with(doi, '10.48550/arxiv.') then substr(doi, 16) end) as arxiv, openalex from f")
def f54_identifiers_from(spark: SparkSession, d: str) -> DataFrame:
    """The first active identifier of each scheme; an arXiv id also from a registered DOI."""
    v = F.lower(F.trim("value_normalized"))
    rows = table(spark, d, "work_identifier").where("status = 'active' and work_id is not null and trim(value_normalized) <> ''").select("work_id", "scheme", v.alias("v"), "created_at", "id")
    first = lambda s: F.min(F.when(F.col("scheme") == s, F.struct("created_at", "id", "v")))["v"].alias(s)
    g = rows.groupBy("work_id").agg(first("doi"), first("arxiv"), first("openalex"))
    derived = F.when(F.col("doi").startswith(L.DATACITE_ARXIV), F.substring("doi", len(L.DATACITE_ARXIV) + 1, 100))
    return g.select("work_id", "doi", F.coalesce("arxiv", derived).alias("arxiv"), F.upper("openalex").alias("openalex"))


TAGS = [('<a HREF="x?a=1&amp;b=2" class=y>', "x?a=1&b=2"), ("<a href='it''s'>".replace("''", ""), "its"), ("<a title=z>", None), ("<a href = bare>", "bare"), ('<a href="">', None)]


@query(literals(TAGS, "x, y"))
def f57_attributes(spark: SparkSession, d: str) -> DataFrame:
    """An attribute of literal tags, quoted either way or bare."""
    return _case(spark, TAGS, "string", H.attribute(F.col("x"), "href"))


ANCHORS = [("<a href=x><b>Down</b>\n load &amp; read</a>", "Down load & read"), ("<a href=x></a>", ""), ("<a href=x>&lt;pdf&gt;</a>", "<pdf>")]


@query(literals(ANCHORS, "x, y").replace("\n", "' || chr(10) || '"))
def f58_anchor_text(spark: SparkSession, d: str) -> DataFrame:
    return _case(spark, ANCHORS, "string", F.get(H.anchors(F.col("x")), F.lit(0))["text"])


ENTITIES = [("a &amp;lt; b", "a &lt; b"), ("&lt;&gt;&quot;&apos;&#39;&nbsp;", "<>\"'' "), ("&unknown; &amp", "&unknown; &amp"), ("", "")]


@query(literals(ENTITIES, "x, y"))
def f59_decode_entities(spark: SparkSession, d: str) -> DataFrame:
    """Named entities once, the ampersand last."""
    from ..functions.text import decode_entities

    return _case(spark, ENTITIES, "string", decode_entities(F.col("x")))


LINKS = [("b.html", "https://x.org/a/b.html"), ("/c", "https://x.org/c"), ("//y.org/d", "https://y.org/d"), ("mailto:a@b", None), ("http://z.org/#t", "http://z.org/"), ("", "https://x.org/a/page?q=1")]


@query(literals(LINKS, "x, y"))
def f60_resolve_http(spark: SparkSession, d: str) -> DataFrame:
    return _case(spark, LINKS, "string", H.resolve_http(F.lit("https://x.org/a/page?q=1#here"), F.col("x")))


@query("select p_partkey as id, case when s between 200 and 299 then 'ok' when s = 429 then 'throttled' when s in (401, 403, 451) then 'denied' when s in (404, 410) then 'gone' when s >= 500 then 'retry' else 'failed' end as class from (select p_partkey, 200 + p_partkey % 320 as s from part)")
def f62_classify_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.status_class(200 + F.col("p_partkey") % 320).alias("class"))


@query("select doc_id, contains(substr(text, 1, 1024), '%PDF-') or doc_id % 7 = 0 as pdf from documents where text is not null and text <> '' and length(text) = strlen(text)")
def f63_has_pdf_magic(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mark of the format stands in the first 1,024 bytes; every seventh text gets one there, every eleventh behind them."""
    t = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("junk %PDF-1.7"), "text")).when(F.col("doc_id") % 11 == 0, F.concat(F.rpad("text", 1100, " "), F.lit("%PDF-1.4"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null and text <> '' and length(text) = octet_length(text)")
    return rows.select("doc_id", F.contains(F.left(t, F.lit(1024)), F.lit("%PDF-")).alias("pdf"))


FILES = [("A: B/C?", "A B C.pdf"), ("...", "untitled.pdf"), ("x" * 200, "x" * 116 + ".pdf"), (" a  b. ", "a b.pdf"), ("", "untitled.pdf")]


@query(literals(FILES, "x, y") + " union select distinct display_title as x, trim(substr(trim(regexp_replace(regexp_replace(display_title, '[\\\\/:*?\"<>|]+', ' ', 'g'), ' +', ' ', 'g')), 1, 116)) || '.pdf' as y from graph_work where display_title is not null and not regexp_matches(display_title, '^[. ]|[. ]$') and display_title <> ''")
def f65_fetched_filename(spark: SparkSession, d: str) -> DataFrame:
    """File names of literal and of all titles."""
    rows = table(spark, d, "graph_work").where("display_title is not null and display_title <> ''").where(~F.col("display_title").rlike("^[. ]|[. ]$")).select(F.col("display_title").alias("x"))
    return rows.unionByName(spark.createDataFrame([(a,) for a, _ in FILES], "x string")).distinct().select("x", L.safe_filename(F.col("x")).alias("y"))
