"""Readers of files and payloads; every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPEND = "at timestamp, stage string, model string, prompt_tokens bigint, completion_tokens bigint, cost_usd double"
HIGHLIGHT = "id string, paper_id string, page int, quote string, note string, created_at timestamp"
JOB = "id string, paper_id string, status struct<state:string,stage:string,message:string>, progress int, tasks array<struct<id:string,status:string,detail:string>>"
WORK = "id string, doi string, title string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, referenced_works array<string>, cited_by_count string"
CROSSREF = "DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, `container-title` array<string>, issued struct<`date-parts`:array<array<int>>>"


def library_files(spark: SparkSession, root: str, pattern: str = "*.{pdf,epub}", content: bool = False) -> DataFrame:
    """(relative_path, bytes, format) of the library's files; with content also sha256, which reads every file.

    Hidden files and files of no bytes are left out by the file source; rows come in no order.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    out = [path.alias("relative_path"), F.col("length").alias("bytes"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("format")]
    return rows.select(*out, *([F.sha2("content", 256).alias("sha256")] if content else []))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON; lines that can't be read are dropped, a missing path gives an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def metadata_from_filename(stem: Column) -> Column:
    """Author - Year - Title, Date - Title, Author - Title or a bare title -> struct(author, year, title)."""
    parts = F.split(stem, " - ")
    n = F.size(parts)
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    rest = lambda i: F.trim(F.array_join(F.slice(parts, i + 1, F.greatest(n - i, F.lit(0))), " - "))
    year = lambda c: F.regexp_extract(c, r"^((?:1[4-9]|20|21)\d\d)(?:-\d\d(?:-\d\d)?)?$", 1)
    author_year = (n >= 3) & (year(at(1)) != "")
    date = (n >= 2) & (year(at(0)) != "")
    return F.struct(
        F.when(author_year, at(0)).when((n >= 2) & ~date, at(0)).alias("author"),
        F.when(author_year, year(at(1))).when(date, year(at(0))).try_cast("int").alias("year"),
        F.when(author_year, rest(2)).when(n >= 2, rest(1)).otherwise(F.trim(stem)).alias("title"),
    )


def parse_work(payload: Column) -> Column:
    """Provider JSON -> struct(id, doi, title, year, authors, referenced); only a missing id makes it null."""
    j = F.from_json(payload, WORK)
    authors = F.filter(F.transform(j["authorships"], lambda a: a["author"]["display_name"]), lambda x: x.isNotNull() & (x != ""))
    return F.when(j["id"].isNotNull(), F.struct(
        F.regexp_replace(j["id"], r"^https?://(api\.)?openalex\.org/", "").alias("id"), F.regexp_replace(F.lower(j["doi"]), r"^https?://doi\.org/", "").alias("doi"), F.nullif(F.trim(j["title"]), F.lit("")).alias("title"), j["publication_year"].alias("year"),
        F.coalesce(authors, F.expr("cast(array() as array<string>)")).alias("authors"), F.coalesce(j["referenced_works"], F.expr("cast(array() as array<string>)")).alias("referenced"),
    ))


def parse_cited_by_count(payload: Column) -> Column:
    """A JSON number, not negative and below 9e18, without its fraction; null otherwise (a string is no number)."""
    raw = F.regexp_extract(payload, r"\"cited_by_count\"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*[,}]", 1)
    value = F.nullif(raw, F.lit("")).try_cast("decimal(38,10)")
    return F.when((value >= 0) & (value < 9 * 10**18), F.floor(value).cast("bigint"))


def parse_crossref(payload: Column) -> Column:
    from ..functions.text import strip_markup

    j = F.from_json(payload, CROSSREF)
    names = F.transform(j["author"], lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"]))
    return F.struct(F.lower(j["DOI"]).alias("doi"), strip_markup(F.get(j["title"], F.lit(0))).alias("title"), F.filter(names, lambda x: x.isNotNull()).alias("authors"), F.get(j["container-title"], F.lit(0)).alias("venue"), F.get(F.get(j["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"))


def split_pages(text: Column) -> Column:
    """Pages between form feeds, numbered from 1; empty ones at the end are left out."""
    pages = F.split(F.regexp_replace(text, "\f+$", ""), "\f")
    return F.transform(pages, lambda p, i: F.struct((i + 1).alias("number"), p.alias("text")))


def parse_pdf_info(info: Column) -> Column:
    """Lines of key: value as a map with lower-case keys; the first of equal keys counts."""
    rows = F.filter(F.transform(F.split(info, "\n"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"), x.contains(":").alias("ok"))), lambda r: r["ok"] & (r["key"] != ""))
    keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.get(F.filter(rows, lambda r: r["key"] == k), F.lit(0))["value"].alias("value"))))


def parse_ocr_tsv(rows: DataFrame, least: float = 25.0) -> DataFrame:
    """rows(page, line): OCR lines of twelve tab-separated columns -> (page, words, confidence) of words with level 5 and a score of at least `least`."""
    f = F.split("line", "\t")
    w = rows.where(F.size(f) == 12).select("page", F.get(f, F.lit(0)).try_cast("int").alias("level"), F.get(f, F.lit(10)).try_cast("double").alias("score"), F.get(f, F.lit(11)).alias("word"))
    return w.where((F.col("level") == 5) & (F.col("score") >= least) & (F.trim("word") != "")).groupBy("page").agg(F.count("*").alias("words"), F.avg(F.col("score") / 100).alias("confidence"))


def read_through(keys: DataFrame, cache: DataFrame, key: str, fetch=None) -> DataFrame:
    """Cached payloads by key; keys without one go to fetch (a DataFrame function), or come out as misses without it.

    A cached payload of {"not_found":true} is an answer, not a miss.
    """
    rows = keys.select(key).distinct().join(cache.select(key, "payload"), key, "left")
    hit = rows.where("payload is not null").select(key, "payload", F.lit("cache").alias("source"))
    miss = rows.where("payload is null").select(key)
    got = fetch(miss).select(key, "payload", F.lit("provider").alias("source")) if fetch else miss.select(key, F.lit(None).cast("string").alias("payload"), F.lit("miss").alias("source"))
    return hit.unionByName(got)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in parallel by ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def page_words(xml: Column) -> Column:
    """Boxes of words of one page's XML (<word xMin= yMin= xMax= yMax=>text</word>) as an array of structs."""
    from ..functions.text import decode_entities

    boxes = F.regexp_extract_all(xml, F.lit(r"(<word [^>]*>[^<]*</word>)"), F.lit(1))
    at = lambda w, k: F.regexp_extract(w, k + r'="([^"]*)"', 1).try_cast("double").alias(k)
    return F.transform(boxes, lambda w: F.struct(*(at(w, k) for k in ("xMin", "yMin", "xMax", "yMax")), decode_entities(F.regexp_extract(w, r">([^<]*)<", 1)).alias("text")))
