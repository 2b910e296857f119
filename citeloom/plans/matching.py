"""Matching references to works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import titles
from ..operators.topk import top_k
from ..session import table
from .catalog import query

# All pairs of a query and a work whose titles have a Dice coefficient of at least the floor, however they begin.
SHARED = r"""{a}g as (select t, substr(chr(1) || chr(1) || t || chr(1) || chr(1), i, 3) as g, count(*) as c from (select distinct t from {a} where t <> ''), unnest(range(1, length(t) + 3)) as u(i) group by all),
 {b}g as (select t, substr(chr(1) || chr(1) || t || chr(1) || chr(1), i, 3) as g, count(*) as c from (select distinct t from {b} where t <> ''), unnest(range(1, length(t) + 3)) as u(i) group by all),
 dice as (select x.t as qt, y.t as wt, case when x.t = y.t then 1.0::double else 2.0::double * sum(least(x.c, y.c)) / (length(x.t) + length(y.t) + 4) end as similarity from {a}g x join {b}g y using (g) group by 1, 2)"""
PAIRS = rf"""w as (select id, lower(display_title) as t, display_year as y from graph_work where display_title is not null), q as (select query_id, lower(title) as t, "year" as y from title_query where title is not null),
 {SHARED.format(a="q", b="w")}, p as (select q.query_id, w.id, qt, wt, q.y as qy, w.y as wy, similarity from dice join q on q.t = qt join w on w.t = wt where similarity >= 0.55)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Queries and works with near titles."""
    w = table(spark, d, "graph_work").where("display_title is not null").select("id", F.lower("display_title").alias("wt"), F.col("display_year").alias("wy"))
    q = table(spark, d, "title_query").where("title is not null").select("query_id", F.lower("title").alias("qt"), F.col("year").alias("qy"))
    return titles.close(q, w)


@query(rf"with {PAIRS} select query_id, id, round(similarity, 6) as similarity from p")
def m01_title_similarity(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("select id, length(display_title) + 2 as grams from graph_work where display_title <> ''")
def m02_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_work").where("display_title <> ''").select("id", F.size(M.trigrams(F.col("display_title"))).cast("bigint").alias("grams"))


_FAMILIES = "list_distinct(list_transform({}, lambda x: lower(string_split(trim(string_split(trim(x), ',')[1]), ' ')[-1])))"
# Printed entries meet the records of a provider: candidates share the identifier or have a near title.
SCORES = rf"""w as (select openalex_id as cid, lower(title) as t, "year" as y, lower(doi) as doi, {_FAMILIES.format("authors")} as f from openalex_work),
 q as (select id, lower(fields ->> '$.title.value') as t, try_cast(fields ->> '$.year.value' as int) as y, lower(fields ->> '$.doi.value') as doi, {_FAMILIES.format("cast(fields -> '$.authors.value' as varchar[])")} as f from bibliography_entry),
 {SHARED.format(a="q", b="w")},
 cand as (select q.id, w.cid from dice join q on q.t = qt join w on w.t = wt where similarity >= 0.55 union select q.id, w.cid from q join w on q.doi = w.doi),
 parts as (select c.id, c.cid, case when q.t is null or w.t is null then null else coalesce(d.similarity, 0.0::double) end as title, q.y as qy, w.y as wy,
   case when q.doi = w.doi then 'match' when q.doi is not null and w.doi is not null then 'conflict' else 'unknown' end as agreement,
   case when len(q.f) > 0 and len(w.f) > 0 then 2.0::double * len(list_intersect(q.f, w.f)) / (len(q.f) + len(w.f)) end as authors,
   case abs(q.y - w.y) when 0 then 1.0::double when 1 then 0.7::double when 2 then 0.3::double else case when q.y is not null and w.y is not null then 0.0::double end end as yr
   from cand c join q using (id) join w using (cid) left join dice d on d.qt = q.t and d.wt = w.t),
 sc as (select *, case agreement when 'match' then 1.0::double when 'conflict' then 0.0::double else coalesce(floor((coalesce(title * 0.62, 0) + coalesce(authors * 0.22, 0) + coalesce(yr * 0.10, 0)) / nullif((case when title is null then 0 else 0.62::double end + case when authors is null then 0 else 0.22::double end + case when yr is null then 0 else 0.10::double end), 0) * 1000000 + 0.5) / 1000000, 0.0::double) end as total from parts)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, cid, title, qy, wy, agreement, total) of every printed entry and each candidate record."""
    from ..functions.text import family_name

    families = lambda c: F.array_distinct(F.transform(c, lambda x: family_name(F.trim(x))))
    value = lambda n: F.get_json_object("fields", f"$.{n}.value")
    q = table(spark, d, "bibliography_entry").select("id", F.lower(value("title")).alias("qt"), value("year").try_cast("int").alias("qy"), F.lower(value("doi")).alias("qd"), families(F.from_json(value("authors"), "array<string>")).alias("qf"))
    w = table(spark, d, "openalex_work").select(F.col("openalex_id").alias("cid"), F.lower("title").alias("wt"), F.col("year").alias("wy"), F.lower("doi").alias("wd"), families(F.col("authors")).alias("wf"))
    found = titles.near(q.select(F.col("qt").alias("t")), w.select(F.col("wt").alias("t")))
    by_title = q.join(found, "qt").join(w, "wt")
    by_key = q.where("qd is not null").join(w.where("wd is not null"), F.col("qd") == F.col("wd")).join(found.select("qt", "wt"), ["qt", "wt"], "left_anti")
    by_key = by_key.withColumn("similarity", titles.dice("qt", "wt"))
    both = by_title.unionByName(by_key)
    year, authors = M.year_agreement(F.col("qy"), F.col("wy")), M.family_overlap(F.col("qf"), F.col("wf"))
    total = M.weighted_mean([(F.col("similarity"), M.SCORE["title"]), (authors, M.SCORE["authors"]), (year, M.SCORE["year"])])
    agreement = F.when(F.col("qd") == F.col("wd"), "match").when(F.col("qd").isNotNull() & F.col("wd").isNotNull(), "conflict").otherwise("unknown")
    mean = F.coalesce(F.floor(total * 1000000 + 0.5) / 1000000, F.lit(0.0))
    return both.select("id", "cid", F.col("similarity").alias("title"), "qy", "wy", agreement.alias("agreement"), F.when(agreement == "match", 1.0).when(agreement == "conflict", 0.0).otherwise(mean).alias("total"))


@query(f"with {SCORES} select id, cid, total from sc")
def m03_score_candidate(spark: SparkSession, d: str) -> DataFrame:
    """1 for an identifier that matches, 0 for one that conflicts, else the weighted mean of title, authors and year as far as they are known; no provider record here has a venue."""
    return scores(spark, d).select("id", "cid", "total")


@query(f"""with {SCORES}, r as (select *, row_number() over (partition by id order by total desc, cid) as n,
   title >= 0.55 and agreement <> 'conflict' and coalesce(abs(qy - wy) <= 2, true) and total >= 0.45 as fits, title >= 0.55 and agreement <> 'conflict' and abs(qy - wy) > 2 as off from sc),
 e as (select id, cid, total, row_number() over (partition by id order by total desc, cid) as n, lead(total) over (partition by id order by total desc, cid) as second from r where fits),
 g as (select id, arg_min(cid, n) filter (agreement = 'match') as hit, bool_or(n = 1 and agreement = 'conflict') as conflict, bool_or(coalesce(off, false)) as off from r group by id)
 select q.id, case when g.id is null or q.t is null or trim(q.t) = '' then null when hit is not null then hit when conflict then null else e.cid end as cid,
   case when g.id is null or q.t is null or trim(q.t) = '' then 'rejected' when hit is not null then 'accepted' when conflict or e.id is null then 'rejected' when e.total >= 0.72 and (second is null or e.total - second >= 0.06) then 'accepted' else 'ambiguous' end as verdict,
   case when g.id is null then 'no_candidates' when q.t is null or trim(q.t) = '' then 'no_title' when hit is not null then 'identifier' when conflict then 'identifier_conflict' when e.id is not null then 'score' when off then 'year_disagrees' else 'title_disagrees' end as reason
 from q left join g using (id) left join e on e.id = q.id and e.n = 1""")
def m04_decide(spark: SparkSession, d: str) -> DataFrame:
    """The decision on every printed entry and its reason: an identifier that matches, else one that conflicts with the best, else the best above the floors if it leads clearly."""
    return decisions(table(spark, d, "bibliography_entry").select("id", F.lower(F.get_json_object("fields", "$.title.value")).alias("qt")), scores(spark, d))


def decisions(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """asked(id, qt), scored(id, cid, title, qy, wy, agreement, total) -> (id, cid, verdict, reason), one row per asked row."""
    right = F.coalesce((F.col("title") >= M.TITLE_FLOOR) & (F.col("agreement") != "conflict"), F.lit(False))
    scored = scored.withColumn("fits", right & M.year_compatible(F.col("qy"), F.col("wy")) & (F.col("total") >= M.TOTAL_FLOOR)).withColumn("off", right & ~M.year_compatible(F.col("qy"), F.col("wy")))
    rank = F.struct((-F.col("total")).alias("t"), "cid")
    g = scored.groupBy("id").agg(F.min(F.when(F.col("agreement") == "match", rank)).alias("hit"), F.min(F.struct((-F.col("total")).alias("t"), "cid", "agreement")).alias("top"), F.max("off").alias("off"))
    two = top_k(scored.where("fits").select("id", "cid", "total"), ["id"], [F.desc("total"), F.asc("cid")], 2, "cid")
    e = two.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.struct("cid", "total"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("total"))).alias("second"))
    rows = asked.join(g, "id", "left").join(e, "id", "left")
    void = F.col("top").isNull()
    untitled = F.col("qt").isNull() | (F.trim("qt") == "")
    hit, conflict = F.col("hit").isNotNull(), F.col("top.agreement") == "conflict"
    clear = (F.col("a.total") >= M.ACCEPT) & (F.col("second").isNull() | (F.col("a.total") - F.col("second") >= M.LEAD))
    return rows.select(
        "id",
        F.when(void | untitled, None).when(hit, F.col("hit.cid")).when(conflict, None).otherwise(F.col("a.cid")).alias("cid"),
        F.when(void | untitled, "rejected").when(hit, "accepted").when(conflict | F.col("a").isNull(), "rejected").when(clear, "accepted").otherwise("ambiguous").alias("verdict"),
        F.when(void, "no_candidates").when(untitled, "no_title").when(hit, "identifier").when(conflict, "identifier_conflict").when(F.col("a").isNotNull(), "score").when(F.col("off"), "year_disagrees").otherwise("title_disagrees").alias("reason"),
    )


@query(f"with {SCORES} select id, cid, agreement from sc")
def m05_identifier_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether an entry's DOI is that of the candidate record, another, or one of both is unknown."""
    return scores(spark, d).select("id", "cid", "agreement")


@query(f"with {SCORES}, r as (select id, cid, total, row_number() over (partition by id order by total desc, cid) as rank from sc) select id, cid, rank from r")
def k17_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of an entry by descending score. An entry's candidates are works of near titles, so a window holds no more than these."""
    from pyspark.sql import Window

    return scores(spark, d).select("id", "cid", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("total"), "cid")).cast("bigint").alias("rank"))


FAMILY = "list_distinct(list_transform({}, lambda x: lower(string_split(trim(string_split(trim(x), ',')[1]), ' ')[-1])))"


@query(f"""with p as (select g.id, o.openalex_id, {FAMILY.format('g.display_authors')} as a, {FAMILY.format('o.authors')} as b from graph_work g join openalex_work o on lower(o.title) = lower(g.display_title))
 select id, openalex_id, case when len(a) > 0 and len(b) > 0 then round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) end as overlap from p""")
def m06_family_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared family names of works and records with one title."""
    from ..functions.text import family_name

    names = lambda c: F.array_distinct(F.transform(c, lambda x: family_name(F.trim(x))))
    g = table(spark, d, "graph_work").select("id", F.lower("display_title").alias("k"), names("display_authors").alias("a"))
    o = table(spark, d, "openalex_work").select("openalex_id", F.lower("title").alias("k"), names("authors").alias("b"))
    return g.join(o, "k").select("id", "openalex_id", F.round(M.family_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(rf"with {PAIRS} select query_id, id, case abs(qy - wy) when 0 then 1.0::double when 1 then 0.7::double when 2 then 0.3::double else case when qy is not null and wy is not null then 0.0::double end end as agreement, coalesce(abs(qy - wy) <= 2, true) as compatible from p")
def m07_year_agreement(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("query_id", "id", M.year_agreement(F.col("qy"), F.col("wy")).alias("agreement"), M.year_compatible(F.col("qy"), F.col("wy")).alias("compatible"))


@query(rf"with {PAIRS}, x as (select query_id, id, list_distinct(regexp_extract_all(qt, '[a-z]{{2,}}')) as w, regexp_extract_all(wt, '[a-z]{{2,}}') as h from p) select query_id, id, case when len(w) >= 3 then len(list_intersect(w, h)) / len(w) >= 0.8 end as appears from x")
def m17_title_appears_in(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(c, F.lit("([a-z]{2,})"), F.lit(1))
    return pairs(spark, d).select("query_id", "id", (M.words_found(words(F.col("qt")), words(F.col("wt"))) >= 0.8).alias("appears"))


@query(rf"with {PAIRS}, x as (select query_id, id, regexp_extract_all(qt, '[a-z]{{2,}}') as a, regexp_extract_all(wt, '[a-z]{{2,}}') as b from p), n as (select *, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) as c from x) select query_id, id, round(case when c > 0 then 2.0 * c / (len(a) + len(b)) else 0.0::double end, 6) as f1 from n")
def m23_token_f1(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.regexp_extract_all(c, F.lit("([a-z]{2,})"), F.lit(1))
    return pairs(spark, d).select("query_id", "id", F.round(M.token_f1(words(F.col("qt")), words(F.col("wt"))), 6).alias("f1"))


@query("with p as (select a.paper_id, x.p.page_number as n, x.p.text_start as lo, x.p.text_end as hi from reading_index a, unnest(a.pages) as x(p)), s as (select paper_id, n, lo, hi, lead(lo) over (partition by paper_id order by n) as lo2, lead(hi) over (partition by paper_id order by n) as hi2 from p) select paper_id, n, round(greatest(0, least(hi, hi2) - greatest(lo, lo2) + 1) / (greatest(hi, hi2) - least(lo, lo2) + 1), 6) as iou from s where lo2 is not null")
def m26_interval_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each page with the next; pages of one paper are at most a few thousand."""
    from ..operators.metrics import interval_iou

    rows = table(spark, d, "reading_index").select("paper_id", F.explode("pages").alias("p")).select("paper_id", F.col("p.page_number").alias("n"), F.col("p.text_start").alias("lo"), F.col("p.text_end").alias("hi"))
    nxt = rows.select("paper_id", (F.col("n") - 1).alias("n"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return rows.join(nxt, ["paper_id", "n"]).select("paper_id", "n", F.round(interval_iou("lo", "hi", "lo2", "hi2"), 6).alias("iou"))


@query()
def m27_align(spark: SparkSession, d: str) -> DataFrame:
    """Where each printed marker's passage stands in its own document's other passages: least word edits with free ends."""
    from ..operators.alignment import align

    rows = table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", F.lower(F.get_json_object("fields", "$.title.value")).alias("needle"), F.lower("raw_text").alias("hay")).where("needle is not null")
    return rows.select("id", align("needle", "hay").alias("a")).select("id", "a.distance", "a.words")


@query("select id, case when passage is null then 'no passage' when instr(passage, marker_text) = 0 then 'not in passage' when marker_end - marker_start <> length(marker_text) then 'wrong span' else 'grounded' end as state from citation_mention where marker_text is not null")
def m31_ground_quote(spark: SparkSession, d: str) -> DataFrame:
    """Whether a quote stands in the passage it names; the first reason against it."""
    rows = table(spark, d, "citation_mention").where("marker_text is not null")
    state = F.when(F.col("passage").isNull(), "no passage").when(F.instr("passage", F.col("marker_text")) == 0, "not in passage").when(F.col("marker_end") - F.col("marker_start") != F.length("marker_text"), "wrong span").otherwise("grounded")
    return rows.select("id", state.alias("state"))


@query("select id, instr(passage, marker_text) - 1 as place from citation_mention where passage is not null and marker_text <> '' and instr(passage, marker_text) > 0")
def m32_locate_quote(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_mention").where("passage is not null and marker_text <> ''").select("id", (F.instr("passage", F.col("marker_text")) - 1).cast("bigint").alias("place")).where("place >= 0")


@query("select id, coalesce(fields ->> '$.authors.confidence', 'missing') <> 'explicit' or coalesce(fields ->> '$.year.confidence', 'missing') <> 'explicit' as needs from bibliography_entry")
def m46_needs_model(spark: SparkSession, d: str) -> DataFrame:
    weak = lambda n: F.coalesce(F.get_json_object("fields", f"$.{n}.confidence"), F.lit("missing")) != "explicit"
    return table(spark, d, "bibliography_entry").select("id", (weak("authors") | weak("year")).alias("needs"))
