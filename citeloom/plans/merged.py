"""Candidates and names merged, and sentences of token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.titlekey import key_of
from ..session import table
from .catalog import query
from .links import _case, literals
from .selection import key_sql

# Words whose stop ends no sentence.
STOPPED = ["e.g.", "i.e.", "mr.", "mrs.", "dr.", "prof.", "fig.", "sec.", "etc.", "vs."]
LONGEST = 120


def ends_sentence(token):
    """Whether a token ends a sentence: a terminator before closing quotes and brackets, but no known abbreviation."""
    t = F.lower(F.regexp_replace(token, "['\"’”)\\]]+\\z", ""))
    return t.rlike(r"[.?!]\z") & ~t.rlike("(?:" + "|".join(x.replace(".", "[.]") for x in STOPPED) + r")\z")


ENDINGS = [("end.", True), ("al.", True), ("Fig.", False), ("Why?", True), ("word", False), ("so.”)", True), ("(e.g.", False), ("A.", True), ("", False), ("etc.", False)]


@query(literals(ENDINGS, "x, y"))
def f68_ends_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _case(spark, ENDINGS, "string", ends_sentence(F.col("x")))


_ENDS = "regexp_matches(regexp_replace(text, '[''\"’”)\\]]+$', ''), '[.?!]$') and not regexp_matches(lower(regexp_replace(text, '[''\"’”)\\]]+$', '')), '(" + "|".join(x.replace(".", "[.]") for x in STOPPED) + ")$')"


@query(f"with t as (select *, row_number() over w - 1 as i, {_ENDS} as stop from reading_token where text is not null window w as (partition by paper_id, page order by token_start, token_id)), s as (select *, coalesce(sum(stop::int) over (partition by paper_id, page order by i rows between unbounded preceding and 1 preceding), 0) as seg from t), p as (select *, (i - min(i) over (partition by paper_id, page, seg)) // {LONGEST} as piece from s) select paper_id, page, min(token_start) as start, max(token_end) as finish, count(*) as tokens from p group by paper_id, page, seg, piece")
def f67_segment_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each page's tokens, at most 120 tokens each. A window holds the tokens of one page."""
    page = Window.partitionBy("paper_id", "page").orderBy("token_start", "token_id")
    rows = table(spark, d, "reading_token").where("text is not null").withColumn("stop", ends_sentence(F.col("text")).cast("int")).withColumn("i", F.row_number().over(page))
    rows = rows.withColumn("seg", F.coalesce(F.sum("stop").over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min("i").over(Window.partitionBy("paper_id", "page", "seg"))
    cut = rows.withColumn("piece", F.floor((F.col("i") - first) / LONGEST))
    return cut.groupBy("paper_id", "page", "seg", "piece").agg(F.min("token_start").alias("start"), F.max("token_end").alias("finish"), F.count("*").alias("tokens")).drop("seg", "piece")


CANDIDATES = """c as (select 1 as place, openalex_id as id, lower(doi) as doi, title, cast("year" as int) as y, len(coalesce(authors, [])) > 0 as named, null::varchar as venue, 'openalex:' || openalex_id as ident from openalex_work where doi is not null union all
 select 2, id, lower(fields ->> '$.doi.value'), fields ->> '$.title.value', try_cast(regexp_extract(fields ->> '$.year.value', '^[0-9]{4}') as int), cast(fields -> '$.authors.value' as varchar) is not null and cast(fields -> '$.authors.value' as varchar) <> 'null', fields ->> '$.venue.value', 'entry:' || entry_key from bibliography_entry where fields ->> '$.doi.value' is not null),
 k as (select *, (title is not null)::int + named::int + (y is not null)::int + (venue is not null)::int as full_ from c)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "openalex_work").where("doi is not null").select(F.lit(1).alias("place"), F.col("openalex_id").alias("id"), F.lower("doi").alias("doi"), "title", F.col("year").cast("int").alias("y"), (F.coalesce(F.size("authors"), F.lit(0)) > 0).alias("named"), F.lit(None).cast("string").alias("venue"), F.concat(F.lit("openalex:"), "openalex_id").alias("ident"))
    v = lambda n: F.get_json_object("fields", f"$.{n}.value")
    year = F.nullif(F.regexp_extract(v("year"), "^[0-9]{4}", 0), F.lit("")).try_cast("int")
    e = table(spark, d, "bibliography_entry").where(v("doi").isNotNull()).select(F.lit(2).alias("place"), "id", F.lower(v("doi")).alias("doi"), v("title").alias("title"), year.alias("y"), v("authors").isNotNull().alias("named"), v("venue").alias("venue"), F.concat(F.lit("entry:"), "entry_key").alias("ident"))
    known = F.col("title").isNotNull().cast("int") + F.col("named").cast("int") + F.col("y").isNotNull().cast("int") + F.col("venue").isNotNull().cast("int")
    return o.unionByName(e).withColumn("full", known)


@query(f"with {CANDIDATES} select doi, arg_min(id, struct_pack(a := place, b := id)) as first_id, count(*) as candidates, string_agg(distinct ident, '|' order by ident) as identifiers from k group by doi")
def d01_dedup_versions(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of several sources that share a version identifier are one, in the place of the first, with all identifiers."""
    g = _candidates(spark, d).groupBy("doi")
    return g.agg(F.min_by("id", F.struct("place", "id")).alias("first_id"), F.count("*").alias("candidates"), F.array_join(F.array_sort(F.collect_set("ident")), "|").alias("identifiers"))


@query(f"with {CANDIDATES} select doi, arg_min(id, struct_pack(a := -full_, b := place, c := id)) as best_id, max(full_) as completeness, arg_min(struct_pack(v := title), struct_pack(a := -full_, b := place, c := id)).v as title from k group by doi")
def d02_merge_into(spark: SparkSession, d: str) -> DataFrame:
    """The record that a merged candidate takes its fields from: the most complete, the first of equals."""
    order = F.struct((-F.col("full")).alias("a"), F.col("place").alias("b"), F.col("id").alias("c"))
    best = _candidates(spark, d).groupBy("doi").agg(F.min_by(F.struct("id", "title"), order).alias("x"), F.max("full").alias("completeness"))
    return best.select("doi", F.col("x.id").alias("best_id"), "completeness", F.col("x.title").alias("title"))


@query("with n as (select id, unnest(display_authors) as name, generate_subscripts(display_authors, 1) as i from graph_work), f as (select id, lower(trim(name)) as key, min(i) as i from n where trim(name) <> '' group by 1, 2), r as (select *, row_number() over (partition by id order by i) as place from f) select r.id, r.place, n.name from r join n on n.id = r.id and n.i = r.i where place <= 32")
def d06_deduplicate_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Names of a work by lower-case key, the first spelling of each, at most 32 (the operator's own limit)."""
    rows = table(spark, d, "graph_work").select("id", F.posexplode("display_authors").alias("i", "name")).where("trim(name) <> ''")
    first = rows.groupBy("id", F.lower(F.trim("name")).alias("key")).agg(F.min(F.struct("i", "name")).alias("f"))
    kept = first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("f")), 1, 32).alias("s"))
    return kept.select("id", F.posexplode("s").alias("place", "x")).select("id", (F.col("place") + 1).cast("bigint").alias("place"), "x.name")


@query("select c.id, case when c.origin = 'user' then 'conflict' else 'updated' end as outcome, case when c.origin = 'user' then c.review_state else 'accepted' end as review_state from field_claim c where c.work_id in (select work_id from work_identifier where status = 'conflicting')")
def w14_set_review_state(spark: SparkSession, d: str) -> DataFrame:
    """A review state set on a batch of claims: a user's own claim is a conflict and stays."""
    asked = table(spark, d, "work_identifier").where("status = 'conflicting' and work_id is not null").select("work_id")
    own = F.col("origin") == "user"
    return table(spark, d, "field_claim").join(asked, "work_id", "left_semi").select("id", F.when(own, "conflict").otherwise("updated").alias("outcome"), F.when(own, F.col("review_state")).otherwise("accepted").alias("review_state"))


@query(f"select id, display_title, nullif({key_sql('display_title')}, '') as title_key from graph_work where display_year % 2 = 0")
def w39_set_display_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles set with their derived keys; an empty key is null."""
    return table(spark, d, "graph_work").where("display_year % 2 = 0").select("id", "display_title", F.nullif(key_of(F.col("display_title")), F.lit("")).alias("title_key"))
