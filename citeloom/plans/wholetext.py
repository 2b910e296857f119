"""Text functions over whole tables, in SQL as in Spark: both spell out the classes of characters they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from .catalog import query
from .whole import _folded, expanded_keys, marker_parts

#: White space of any script, for Java and for RE2.
BLANK, BLANK_SQL = "[\\t-\\r\\x1C-\\x20\\x85\\p{Z}]", r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{N}_]+"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def collapsed(text: Column) -> Column:
    """White space of any script collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


@query(f"select doc_id, trim(regexp_replace(text, '{BLANK_SQL}+', ' ', 'g')) as cleaned from documents where text is not null")
def f35_clean(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", collapsed(F.col("text")).alias("cleaned"))


@query(f"select doc_id, substr(trim(regexp_replace(text, '{BLANK_SQL}+', ' ', 'g')), 1, 200) as shown from documents where text is not null")
def f39_shown_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.left(collapsed(F.col("text")), F.lit(200)).alias("shown"))


@query(rf"""select paper_id, len(regexp_extract_all(text, '{WORD}')) as words, len(regexp_extract_all(text, '[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]+')) as big_words, len(list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: regexp_matches(p, '[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]'))) as paragraphs, length(text) as chars from reading_index where text is not null""")
def f73_objects(spark: SparkSession, d: str) -> DataFrame:
    """Text objects of each paper: words, words between blanks, paragraphs."""
    rows = table(spark, d, "reading_index").where("text is not null")
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).cast("bigint")
    full = F.filter(F.split("text", r"\n[ \t]*\n"), lambda p: p.rlike(BLANK.replace("[", "[^", 1)))
    return rows.select("paper_id", count(WORD).alias("words"), count(BLANK.replace("[", "[^", 1) + "+").alias("big_words"), F.size(full).cast("bigint").alias("paragraphs"), F.length("text").cast("bigint").alias("chars"))


@query(r"""with p as (select id, list_filter(list_transform(regexp_split_to_array(regexp_replace(marker_text, '^[\s\[(]+|[\s\])]+$', '', 'g'), '[,;]'), lambda x: trim(x)), lambda x: x <> '') as parts from (select id, marker_text from citation_mention where style = 'numeric' and marker_text is not null union all select * from (values ('literal 1', '[1, 3–5]'), ('literal 2', '(9-4; 2)'), ('literal 3', '[1-99]'), ('literal 4', '[2 − 4, 7]')) as l(id, m))),
 e as (select id, list_transform(parts, lambda x: struct_pack(r := regexp_full_match(x, '\d+\s*[-–−]\s*\d+'), a := try_cast(regexp_extract(x, '^\d+') as int), b := try_cast(regexp_extract(x, '\d+$') as int), n := list_transform(regexp_extract_all(x, '[0-9]+'), lambda y: try_cast(y as int)))) as s from p)
 select id, array_to_string(list_sort(list_distinct(flatten(list_transform(s, lambda x: case when x.r and x.b >= x.a and x.b - x.a <= 30 then range(x.a, x.b + 1) when x.r then [] else x.n end)))), ',') as keys from e""")
def f89_citation_keys(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of numeric markers, ranges of at most 31 numbers expanded; literal markers with ranges stand beside the table's."""
    rows = table(spark, d, "citation_mention").where("style = 'numeric' and marker_text is not null").select("id", "marker_text")
    rows = rows.unionByName(spark.createDataFrame([("literal 1", "[1, 3–5]"), ("literal 2", "(9-4; 2)"), ("literal 3", "[1-99]"), ("literal 4", "[2 − 4, 7]")], "id string, marker_text string"))
    return rows.select("id", F.array_join(F.array_sort(expanded_keys(marker_parts(F.col("marker_text")))).cast("array<string>"), ",").alias("keys"))


@query(r"select doc_id, case when length(text) <= 120 then text else rtrim(case when regexp_matches(substr(text, 1, 119), '[\t-\r ]') then regexp_replace(substr(text, 1, 119), '[\t-\r ]+[^\t-\r ]*$', '') else substr(text, 1, 119) end) || '…' end as short from documents where text is not null")
def f102_shorten(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.shorten(F.col("text"), 120).alias("short"))


@query(r"select doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\*_\[\]])', '\\\1', 'g') as escaped from documents where text is not null")
def f109_escape_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.escape_markdown(F.col("text")).alias("escaped"))


_APART = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe"}


def _replaced(x: str) -> str:
    for a, b in _APART.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"select id, regexp_replace({_replaced('strip_accents(lower(display_title))')}, '[^a-z0-9]', '', 'g') as compact from graph_work where display_title is not null")
def f125_compact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_work").where("display_title is not null").select("id", _folded("display_title").alias("compact"))


@query(r"select v as arxiv, 'https://arxiv.org/pdf/' || v as url from (select distinct value_normalized as v from work_identifier where scheme = 'arxiv' union select unnest(['2101.00001', '0704.1234', 'math.GT/0309136', 'hep-th/9901001', 'junk', '']))  where regexp_full_match(lower(v), '[0-9]{4}\.[0-9]{4,5}|[a-z-]+(\.[a-z]{2})?/[0-9]{7}')")
def f141_arxiv_pdf_url(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of valid identifiers, of the table and literal ones of both forms."""
    v = F.col("v")
    rows = table(spark, d, "work_identifier").where("scheme = 'arxiv'").select(F.col("value_normalized").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(x,) for x in ("2101.00001", "0704.1234", "math.GT/0309136", "hep-th/9901001", "junk", "")], "v string")).distinct()
    return rows.where(F.lower("v").rlike(f"^({T.ARXIV_NEW}|{T.ARXIV_OLD})$")).select(v.alias("arxiv"), F.concat(F.lit("https://arxiv.org/pdf/"), v).alias("url"))
