"""Printed references. References are printed from the tables' own fields, so SQL knows what reading them must give back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import bibliography as B
from ..functions import reference as R
from ..operators.topk import ranked
from ..session import table
from .catalog import query
from .selection import udf

_NAME = "trim(regexp_replace(regexp_replace(x, '[.,;:/&]', '', 'g'), '\\s+(and|et al|others)(\\s|$)', ' ', 'g'))"
RECORDS = f"r as (select openalex_id as id, doi, \"year\" as y, list_slice(list_filter(list_transform(authors, lambda x: {_NAME}), lambda x: length(x) > 3 and regexp_matches(x, '^\\p{{L}}')), 1, 3) as names, trim(regexp_replace(title, '[.?!:]', '', 'g')) as t from openalex_work where title is not null and \"year\" is not null and doi is not null), p as (select * from r where len(names) > 0 and t <> '')"


def records(spark: SparkSession, d: str) -> DataFrame:
    """(id, doi, y, names, t): records with plain names and titles."""
    name = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[.,;:/&]", ""), "\\s+(and|et al|others)(\\s|$)", " "))
    names = F.slice(F.filter(F.transform("authors", name), lambda x: (F.length(x) > 3) & x.rlike("^\\p{L}")), 1, 3)
    rows = table(spark, d, "openalex_work").where("title is not null and year is not null and doi is not null")
    return rows.select(F.col("openalex_id").alias("id"), "doi", F.col("year").cast("int").alias("y"), names.alias("names"), F.trim(F.regexp_replace("title", "[.?!:]", "")).alias("t")).where("size(names) > 0 and t <> ''")


def printed(quoted: bool) -> Column:
    """A record as a reference prints it, the title in quotation marks or ended by a full stop."""
    title = F.concat(F.lit("“"), "t", F.lit("” ")) if quoted else F.concat("t", F.lit(". "))
    return F.concat(F.lit("[7] "), F.array_join("names", " and "), F.lit(" ("), F.col("y").cast("string"), F.lit("). "), title, F.lit("Journal of Tests, 5(3), 1-9. doi:"), "doi")


FIELDS = StructType([StructField(n, ArrayType(StringType()) if n == "authors" else StringType()) for n in ("printed_key", "authors", "title", "year", "venue", "doi", "arxiv_id")])


@F.pandas_udf(FIELDS)
def parsed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([B.parse_fields(x or "") for x in raw], columns=FIELDS.names)


@query(f"with {RECORDS} select id, '7' as printed_key, array_to_string(names, '|') as authors, t as title, cast(y as varchar) as year, 'Journal of Tests, 5(3), 1-9' as venue, doi from p")
def f25_parse_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of references printed from the records."""
    rows = records(spark, d).select("id", parsed(printed(True)).alias("f"))
    return rows.select("id", "f.printed_key", F.array_join("f.authors", "|").alias("authors"), "f.title", "f.year", "f.venue", "f.doi")


@query()
def f25_parse_fields_whole(spark: SparkSession, d: str) -> DataFrame:
    """All fields of the entries as they stand in the table."""
    return table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", parsed("raw_text").alias("f")).select("id", "f.*")


@query(f"with {RECORDS} select id, cast(length(array_to_string(names, ' and ')) + 1 as int) as author_end, cast(length(array_to_string(names, ' and ')) + 7 as int) as year_end from p")
def f26_author_year_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Where the authors and the year that open a reference end."""
    kind = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])

    @F.pandas_udf(kind)
    def span(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([B.author_year_prefix(x) or (None, None) for x in raw], columns=["a", "b"])

    return records(spark, d).select("id", span(F.regexp_replace(printed(True), "^\\[7\\] ", "")).alias("s")).select("id", F.col("s.a").alias("author_end"), F.col("s.b").alias("year_end"))


BOUNDARIES = [("A. B. Doe and C. Roe. On things. J", 20), ("Doe et al. say so. Next", 17), ("J.-P. Roe. X", 9), ("no stop here", None), ("U.S. output. More", 11), ("", None), ("One. Two", 3)]


@query("select * from (values " + ", ".join(f"('{a}', {'null' if b is None else b})" for a, b in BOUNDARIES) + ") as l(txt, place) union select t || '. Rest of it' as txt, length(t) as place from (select trim(regexp_replace(title, '[.]', '', 'g')) as t from openalex_work where title is not null) where not regexp_matches(t, '(?:^|[\\s,])(?:\\p{L}|[\\p{L}-]*-[\\p{L}-]*|\\p{L})$')")
def f27_sentence_boundary(spark: SparkSession, d: str) -> DataFrame:
    """The first full stop that ends a part: of literal texts, and of all titles followed by another part."""
    t = F.trim(F.regexp_replace("title", "[.]", ""))
    rows = table(spark, d, "openalex_work").where("title is not null").select(t.alias("t")).where(~F.col("t").rlike(r"(?:^|[\s,])(?:\p{L}|[\p{L}-]*-[\p{L}-]*)$")).select(F.concat("t", F.lit(". Rest of it")).alias("txt"))
    rows = rows.unionByName(spark.createDataFrame([(a,) for a, _ in BOUNDARIES], "txt string")).distinct()

    @F.pandas_udf(IntegerType())
    def stop(x: pd.Series) -> pd.Series:
        return pd.Series([B.sentence_boundary(v) for v in x], dtype="Int64")

    return rows.select("txt", stop("txt").alias("place"))


LISTS = [("Doe, J. A., Roe, K. & van der Waals, J.", "Doe, J. A.|Roe, K.|van der Waals, J."), ("A. Doe; B. Roe", "A. Doe|B. Roe"), ("Doe, J., Roe", "Doe, J.|Roe"), ("", ""), ("One, Two and Three", "One|Two|Three")]


@query(f"with {RECORDS} select array_to_string(names, '; ') as txt, array_to_string(names, '|') as authors from p union select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in LISTS) + ") as l(txt, authors)")
def f28_split_authors(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).select(F.array_join("names", "; ").alias("txt")).unionByName(spark.createDataFrame([(a,) for a, _ in LISTS], "txt string")).distinct()
    return rows.select("txt", udf(lambda v: "|".join(B.split_authors(v)), StringType())("txt").alias("authors"))


@query(f"with {RECORDS} select id, t as title, 'Journal of Tests, 5(3)' as venue from p")
def f29_title_venue(spark: SparkSession, d: str) -> DataFrame:
    kind = StructType([StructField("title", StringType()), StructField("venue", StringType())])

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([B.title_venue(v) for v in x], columns=["title", "venue"])

    text = F.concat(F.lit("“"), "t", F.lit("” Journal of Tests, 5(3), 1999."))
    return records(spark, d).select("id", run(text).alias("v")).select("id", "v.title", "v.venue")


VENUES = [("J. of X, 12(3) (2001) 1-9", "J. of X, 12(3)"), ("In: Proc. Y [", "In: Proc. Y"), (", Press. doi:10.1/x", "Press"), ("https://x.org", None), ("Arch. 1999a", "Arch")]


@query("select * from (values " + ", ".join(f"('{a}', {'null' if b is None else repr(b)})" for a, b in VENUES) + ") as l(txt, venue) union select distinct fields ->> '$.venue.value' || ', 1987' as txt, regexp_replace(fields ->> '$.venue.value', '^[\\s.,;:]+|[\\s.,;:]+$', '', 'g') as venue from bibliography_entry where fields ->> '$.venue.value' is not null and not regexp_matches(fields ->> '$.venue.value', '(?i)doi|http|arxiv|(18|19|20)[0-9]{2}')")
def f30_clean_venue(spark: SparkSession, d: str) -> DataFrame:
    v = F.get_json_object("fields", "$.venue.value")
    rows = table(spark, d, "bibliography_entry").select(v.alias("v")).where(F.col("v").isNotNull() & ~F.col("v").rlike("(?i)doi|http|arxiv|(18|19|20)[0-9]{2}")).select(F.concat("v", F.lit(", 1987")).alias("txt"))
    rows = rows.unionByName(spark.createDataFrame([(a,) for a, _ in VENUES], "txt string")).distinct()
    return rows.select("txt", udf(B.clean_venue, StringType())("txt").alias("venue"))


DOIS = [("10.1234/ab-\ncd.5 and", "10.1234/ab-cd.5"), ("10.1234/abc.\nThe next", "10.1234/abc"), ("10.1234/abc\nword", None), ("10.1234/abc\n12", "10.1234/abc12"), ("10.1234/a(b)c)", "10.1234/a(b)c"), ("10.1/x", None)]
_DOI_VALUES = ", ".join("('{}', {})".format(a.replace("\n", "' || chr(10) || '"), "null" if b is None else f"'{b}'") for a, b in DOIS)


@query(f"select * from (values {_DOI_VALUES}) as l(txt, doi) union select doi || '. More' as txt, doi from openalex_work where doi is not null and regexp_full_match(doi, '10[.][0-9]{{4,9}}/[a-z0-9./-]*[a-z0-9]')")
def f32_read_doi(spark: SparkSession, d: str) -> DataFrame:
    """A DOI at a text's start, also where it is broken over lines."""
    rows = table(spark, d, "openalex_work").where(F.col("doi").rlike("^10[.][0-9]{4,9}/[a-z0-9./-]*[a-z0-9]$")).select(F.concat("doi", F.lit(". More")).alias("txt"))
    rows = rows.unionByName(spark.createDataFrame([(a,) for a, _ in DOIS], "txt string")).distinct()
    return rows.select("txt", udf(B.read_doi, StringType())("txt").alias("doi"))


@query(r"with x as (select id, list_distinct(list_transform(regexp_extract_all(regexp_replace(raw_text, '([/_-])[ \t]*\n\s*|[ \t]*\n\s*([0-9])', '\1\2', 'g'), '(?i)\b10\.[0-9]{4,9}/[^\s\"“”<>]*'), lambda d: regexp_replace(d, '[.,;:'')\]}]+$', ''))) as dois from bibliography_entry where raw_text is not null) select id, case when len(list_filter(dois, lambda d: regexp_full_match(d, '10\.[0-9]{4,9}/\S+'))) = 1 then list_filter(dois, lambda d: regexp_full_match(d, '10\.[0-9]{4,9}/\S+'))[1] end as doi from x")
def f31_extract_doi(spark: SparkSession, d: str) -> DataFrame:
    """The DOI of every entry that prints exactly one, also where it is broken over lines."""
    return table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", udf(B.extract_doi, StringType())("raw_text").alias("doi"))


@query("select id, case when id % 3 = 0 then '2' || lpad(cast(id % 1000 as varchar), 3, '0') || '.0' || lpad(cast(id % 10000 as varchar), 4, '0') when id % 3 = 1 then 'hep-th/99' || lpad(cast(id % 100000 as varchar), 5, '0') end as arxiv from (select row_number() over (order by o_orderkey) as id from orders)")
def f33_extract_arxiv(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers printed in references of three kinds: new form, old form, two different ones."""
    n = F.col("id")
    rows = ranked(table(spark, d, "orders").select("o_orderkey"), [], ["o_orderkey"], "id")
    new = F.concat(F.lit("2"), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(".0"), F.lpad((n % 10000).cast("string"), 4, "0"))
    old = F.concat(F.lit("hep-th/99"), F.lpad((n % 100000).cast("string"), 5, "0"))
    raw = F.when(n % 3 == 0, F.concat(F.lit("A. Doe. Title. arXiv:"), new, F.lit(", 2001."))).when(n % 3 == 1, F.concat(F.lit("B. Roe. https://arxiv.org/abs/"), old)).otherwise(F.concat(F.lit("arXiv:"), new, F.lit(" and arXiv: 9999.12345")))
    return rows.select("id", udf(B.extract_arxiv, StringType())(raw).alias("arxiv"))


@query(r"select id, list_distinct([lower(value_normalized)]) as dois from work_identifier where scheme = 'doi' and regexp_full_match(lower(value_normalized), '10\.[0-9]{4,9}/[a-z0-9./-]*[a-z0-9]')")
def f03_extract_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct DOIs of running text, each once however it is printed."""
    from ..functions import text as T

    v = F.lower("value_normalized")
    rows = table(spark, d, "work_identifier").where((F.col("scheme") == "doi") & v.rlike(r"^10\.[0-9]{4,9}/[a-z0-9./-]*[a-z0-9]$"))
    text = F.concat(F.lit("See https://doi.org/"), v, F.lit(", (DOI:"), F.upper(v), F.lit(") and 10.12/short."))
    return rows.select("id", T.all_dois(text).alias("dois"))


@query(r"with e as (select citing_version_id as doc, ordinal, id, trim(regexp_replace(raw_text, '\s+', ' ', 'g')) as raw from bibliography_entry where raw_text is not null and trim(raw_text) <> ''), l as (select doc, row_number() over (partition by doc order by ordinal, id) as n, raw from e), x as (select doc, n, '[' || n || '] ' || raw as line from l) select doc, cast(n as varchar) as key, cast(sum(length(line) + 1) over (partition by doc order by n) - length(line) - 1 as bigint) as start, cast(length(line) as bigint) as chars from x")
def f85_split_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each document's list of references, put together from its entries with running numbers."""
    kind = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("key", StringType())]))
    rows = table(spark, d, "bibliography_entry").where("raw_text is not null").select(F.col("citing_version_id").alias("doc"), "ordinal", "id", F.trim(F.regexp_replace("raw_text", r"\s+", " ")).alias("raw")).where("raw <> ''")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "raw")
    lists = ranked(rows, ["doc"], ["ordinal", "id"], "n").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))

    @F.pandas_udf(kind)
    def split(text: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "key": k} for a, b, k in B.split_entries(x)] for x in text])

    found = lists.select("doc", F.explode(split("text")).alias("e"))
    return found.select("doc", F.col("e.key").alias("key"), F.col("e.start").cast("bigint").alias("start"), (F.col("e.end") - F.col("e.start")).cast("bigint").alias("chars"))


LABELS = [("(1)", True), ("(A.3)", True), ("(12.4b)", True), ("x (1)", False), ("(1999)", False), ("()", False), ("  (B7)  ", True)]


@query("select * from (values " + ", ".join(f"('{a}', {str(b).lower()})" for a, b in LABELS) + ") as l(line, label) union select '(' || p_size || ')' as line, true as label from part")
def f111_is_equation_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("line")).unionByName(spark.createDataFrame([(a,) for a, _ in LABELS], "line string")).distinct()
    return rows.select("line", R.is_equation_label(F.col("line")).alias("label"))
