"""In-text markers resolved to the entries of their own document: by printed number, or by family name and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import bibliography as B
from ..functions.titlekey import key_of
from ..session import table
from .catalog import query
from .entries import RECORDS, parsed, printed, records
from .selection import families_sql, family_sql, key_sql, udf
from .whole import expanded_keys, marker_parts

_NAME, _YEAR = (rf"regexp_extract(marker_text, '^\((.+), ([0-9]{{4}})[a-z]?\)$', {i})" for i in (1, 2))
_FIRST = "(cast(fields -> '$.authors.value' as varchar[]))[1]"
ENTRIES = rf"""e as (select id, citing_version_id as doc, upper(regexp_replace(printed_key, '[\s\[\]().]', '', 'g')) as number, {key_sql('coalesce(' + family_sql(f'trim({_FIRST})') + f', trim({_FIRST}))')} as family, regexp_extract(fields ->> '$.year.value', '^[0-9]{{4}}') as y from bibliography_entry),
 m as (select id, document_version_id as doc, style, marker_text from citation_mention where marker_text is not null and document_version_id is not null),
 n as (select id, doc, 'number' as how, unnest(regexp_extract_all(marker_text, '[0-9]+')) as k, null as y from m where style in ('numeric', 'superscript')),
 a as (select id, doc, 'name' as how, {key_sql('coalesce(' + family_sql('trim(' + _NAME + ')') + ', trim(' + _NAME + '))')} as k, {_YEAR} as y from m where style = 'author_year' and {_NAME} <> ''),
 asked as (select distinct * from n union all select distinct * from a),
 hit as (select q.id, q.how, q.k, q.y, count(e.id) as hits, min(e.id) as entry_id from asked q left join e on e.doc = q.doc and ((q.how = 'number' and e.number = q.k) or (q.how = 'name' and e.family = q.k and e.y = q.y)) group by all)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, doc, number, family, y) of the printed entries; number and family are null where they aren't printed."""
    first = F.trim(F.get(F.from_json(F.get_json_object("fields", "$.authors.value"), "array<string>"), F.lit(0)))
    family = udf(lambda v: B.citation_family(v) or v.strip(), StringType())(first)
    year = F.regexp_extract(F.get_json_object("fields", "$.year.value"), "^[0-9]{4}", 0)
    return table(spark, d, "bibliography_entry").select(F.col("id").alias("entry_id"), F.col("citing_version_id").alias("doc"), F.upper(F.regexp_replace("printed_key", r"[\s\[\]().]", "")).alias("number"), key_of(family).alias("family"), year.alias("y"))


def asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What numeric and author-year markers name: (id, doc, k) and (id, doc, k, y)."""
    m = table(spark, d, "citation_mention").where("marker_text is not null and document_version_id is not null").select("id", F.col("document_version_id").alias("doc"), "style", "marker_text")
    numbers = m.where("style in ('numeric', 'superscript')").select("id", "doc", F.explode(expanded_keys(marker_parts(F.col("marker_text"))).cast("array<string>")).alias("k")).distinct()
    pattern = r"^\((.+), ([0-9]{4})[a-z]?\)$"
    names = m.where("style = 'author_year'").select("id", "doc", F.trim(F.regexp_extract("marker_text", pattern, 1)).alias("name"), F.regexp_extract("marker_text", pattern, 2).alias("y")).where("name <> ''")
    family = udf(lambda v: B.citation_family(v) or v.strip(), StringType())("name")
    return numbers, names.select("id", "doc", key_of(family).alias("k"), "y").distinct()


def resolved(asked_: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Each asked key with its entry, if its document has exactly one such; keys are counted before the join, so a marker meets one row."""
    one = keys.groupBy(*on).agg(F.count("*").alias("hits"), F.min("entry_id").alias("entry_id"))
    rows = asked_.join(one, on, "left")
    state = F.when(F.col("hits") == 1, "resolved").when(F.col("hits") > 1, "ambiguous").otherwise("unresolved")
    return rows.withColumn("state", state).withColumn("entry_id", F.when(F.col("hits") == 1, F.col("entry_id")))


_OUT = "case when hits = 1 then entry_id end as entry_id, case when hits = 1 then 'resolved' when hits > 1 then 'ambiguous' else 'unresolved' end as state from hit"


@query(f"with {ENTRIES} select id, how, k as key, {_OUT}")
def f88_resolve_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Markers of all styles with the one entry that each of their keys names, or why there is none."""
    numbers, names = asked(spark, d)
    e = entries(spark, d)
    by_number = resolved(numbers, e.where("number is not null").select("doc", F.col("number").alias("k"), "entry_id"), ["doc", "k"]).withColumn("how", F.lit("number"))
    by_name = resolved(names, e.where("family is not null").select("doc", F.col("family").alias("k"), "y", "entry_id"), ["doc", "k", "y"]).withColumn("how", F.lit("name"))
    out = ["id", "how", F.col("k").alias("key"), "entry_id", "state"]
    return by_number.select(*out).unionByName(by_name.select(*out))


@query(f"with {ENTRIES} select id, k as family, y as \"year\", {_OUT} where how = 'name'")
def f92_resolve_author_year(spark: SparkSession, d: str) -> DataFrame:
    """Author-year markers as family and year, with the entry they name."""
    e = entries(spark, d).where("family is not null").select("doc", F.col("family").alias("k"), "y", "entry_id")
    return resolved(asked(spark, d)[1], e, ["doc", "k", "y"]).select("id", F.col("k").alias("family"), F.col("y").alias("year"), "entry_id", "state")


@query(f"with {RECORDS} select id, t as title, y as \"year\", array_to_string(({families_sql('names')}).fam, '|') as families, doi from p")
def f36_from_raw(spark: SparkSession, d: str) -> DataFrame:
    """Printed references as records to be matched: title, year as a number, family keys, identifier."""
    rows = records(spark, d).select("id", parsed(printed(True)).alias("f"))
    families = udf(lambda v: "|".join(B.author_list_key(v)[0]), StringType())
    return rows.select("id", "f.title", F.left("f.year", F.lit(4)).try_cast("int").alias("year"), families("f.authors").alias("families"), "f.doi")
