"""Scores, rankings and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prominence as P
from ..operators.topk import ranked, top_k
from ..operators.traversal import reading_order
from ..session import table
from .catalog import query
from .views import ASSERTIONS, DOCUMENTS_OF, WORKS, documents_of, live, works

THIS_YEAR = 2025
SHOWN = 12

SIGNALS = f"""{ASSERTIONS}, {DOCUMENTS_OF}, {WORKS}, counted as (select cited as id, count(distinct citing) as citing, count(*) as mentions, count(*) filter (where label = 'uses_method') as methods, count(*) filter (where label = 'background') as backgrounds from live group by cited),
 signals as (select w.id, w.title, w.year, w.mark, w.tag, coalesce(c.citing, 0) as citing, cast(case when w.num % 7 <> 0 then w.num * 3 end as bigint) as global_count, exists (select 1 from documents_of x where x.work = w.id and x.state = 'present') as "local",
   coalesce(c.mentions, 0) as mentions, coalesce(c.methods, 0) as methods, coalesce(c.backgrounds, 0) as backgrounds from works w left join counted c on c.id = w.id)"""


@query(f'with {SIGNALS} select id, citing, global_count, year, "local", mentions, methods, backgrounds from signals')
def a01_compute_signals(spark: SparkSession, d: str) -> DataFrame:
    """Per-work signals: one scan of the assertions, one aggregate, one join."""
    return _signals(spark, d).select("id", "citing", "global_count", "year", "local", "mentions", "methods", "backgrounds")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    counted = live(spark, d).groupBy(F.col("cited").alias("id")).agg(F.countDistinct("citing").alias("citing"), F.count("*").alias("mentions"), F.count_if(F.col("label") == "uses_method").alias("methods"), F.count_if(F.col("label") == "background").alias("backgrounds"))
    present = documents_of(spark, d).where("state = 'present'").select(F.col("work").alias("id")).distinct().withColumn("here", F.lit(True))
    rows = works(spark, d).join(counted, "id", "left").join(present, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("id", "title", "year", "mark", "tag", zero("citing"), F.when(F.col("num") % 7 != 0, F.col("num") * 3).cast("bigint").alias("global_count"), F.coalesce("here", F.lit(False)).alias("local"), zero("mentions"), zero("methods"), zero("backgrounds"))


SCORED = SIGNALS + f""", parts as (select *, least(1.0, ln(1 + citing) / ln(9.0)) as c_degree, least(1.0, ln(1 + global_count) / ln(10.0) / 5) as c_global, case when "local" then 1.0::double else 0.0::double end as c_local, least(1.0, ln(1 + mentions) / ln(11.0)) as c_mentions,
   case when methods > 0 then 1.0::double when backgrounds > 0 then 0.3::double end as c_role, exp(-greatest(0, {THIS_YEAR} - year) / 15.0) as c_recency from signals),
 scored as (select *, floor(greatest(0.0, least(1.0, (0.30 * c_degree + coalesce(0.25 * c_global, 0) + 0.15 * c_local + 0.10 * c_mentions + coalesce(0.10 * c_role, 0) + coalesce(0.10 * c_recency, 0))
   / (0.55 + case when c_global is not null then 0.25 else 0 end + case when c_role is not null then 0.10 else 0 end + case when c_recency is not null then 0.10 else 0 end))) * 10000 + 0.5) / 10000 as score,
   case mark when 'pinned' then 0 when 'downplayed' then 2 when 'hidden' then 3 else 1 end as mark_rank, lower(title) as title_key from parts)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return P.score(P.components(_signals(spark, d), THIS_YEAR)).withColumn("mark_rank", P.mark_rank(F.col("mark"))).withColumn("title_key", F.lower("title"))


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query(f"with {SCORED} select id, round(c_degree, 6) as c_degree, round(c_global, 6) as c_global, round(c_local, 6) as c_local, round(c_mentions, 6) as c_mentions, round(c_role, 6) as c_role, round(c_recency, 6) as c_recency from scored")
def k01_prominence_components(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", *(_six(f"c_{n}") for n in P.WEIGHTS))


@query(f"with {SCORED} select id, score from scored")
def k02_prominence_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", "score")


@query(f"with {SCORED}, cache as (select id, round(cast(substr(id, 2) as int) % 1000 / 1000.0, 3)::double as score, cast(substr(id, 2) as int) % 3 as version from works where cast(substr(id, 2) as int) % 5 <> 0) select s.id, coalesce(case when c.version = 2 then c.score end, s.score) as score, coalesce(c.version = 2, false) as from_cache from scored s left join cache c on c.id = s.id")
def k03_prominence_for(spark: SparkSession, d: str) -> DataFrame:
    """Cached scores at the current version, the others computed anew, and those without a cached one too."""
    n = F.substr("id", F.lit(2)).cast("int")
    cache = works(spark, d).where(n % 5 != 0).select("id", F.round(n % 1000 / 1000.0, 3).alias("cached"), (n % 3).alias("version"))
    return P.with_cache(scored(spark, d), cache, version=2)


@query(f"with {SCORED}, cache as (select id, round(cast(substr(id, 2) as int) % 1000 / 1000.0, 3)::double as score, cast(substr(id, 2) as int) % 3 as version from works where cast(substr(id, 2) as int) % 5 <> 0) select id, score from cache where version = 2")
def k04_cached(spark: SparkSession, d: str) -> DataFrame:
    """Cached scores of the current version only."""
    n = F.substr("id", F.lit(2)).cast("int")
    return works(spark, d).where(n % 5 != 0).where(n % 3 == 2).select("id", F.round(n % 1000 / 1000.0, 3).alias("score"))


@query(f"with {SCORED} select id, score, citing, mentions, 3 as version from scored")
def k05_refresh_prominence(spark: SparkSession, d: str) -> DataFrame:
    """All scores computed anew under a new version, in one pass instead of pages."""
    return scored(spark, d).select("id", "score", "citing", "mentions", F.lit(3).alias("version"))


NEIGHBORS = SCORED + """, edge as (select distinct citing as center, cited as id from live), nb as (select e.center, s.* from edge e join scored s on s.id = e.id)"""
RANK = "order by mark_rank, score desc nulls last, year desc nulls last, title_key, id"


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    edges = live(spark, d).select(F.col("citing").alias("center"), F.col("cited").alias("id")).distinct()
    return edges.join(scored(spark, d), "id")


@query(f"with {NEIGHBORS}, r as (select center, id, score, row_number() over (partition by center {RANK}) as rank from nb where mark is distinct from 'hidden') select center, id, score, rank from r where rank <= {SHOWN}")
def k06_rank_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """The first works of every neighborhood in rank order, hidden ones left out: the flagship query."""
    rows = neighbors(spark, d).where("mark is null or mark <> 'hidden'").select("center", "id", "score", "mark_rank", "year", "title_key")
    return top_k(rows, ["center"], P.rank_order(), SHOWN, "id").select("center", "id", "score", F.col("rank").cast("bigint").alias("rank"))


EXPANDED = ["decade:1990", "downplayed"]
FILTER = ["Brand#11", "Brand#12", "Brand#13", "Brand#21"]
# A third of the works have a tag; the others fall into decades.
TAGGED = NEIGHBORS.replace("scored as (select *,", "scored as (select *, case when cast(substr(id, 2) as bigint) % 3 = 0 then tag end as first_tag,")
SLOT = "case when mark = 'hidden' then 'hidden' when mark = 'downplayed' then 'downplayed' when first_tag is not null then 'tag:' || first_tag when year is not null then 'decade:' || cast(year // 10 * 10 as int) else 'decade:unknown' end"


def _ranked_sql(where: str = "true") -> str:
    return f"""{TAGGED}, kept as (select *, {SLOT} as slot from nb where {where}), t as (select center, count(*) as n, count(*) filter (where mark = 'pinned') as pinned, count(*) filter (where mark is null) as unmarked, count(*) filter (where mark = 'hidden') as hidden from kept group by center),
 r as (select k.*, row_number() over (partition by k.center {RANK}) as rank, least(greatest({SHOWN}, t.pinned), t.pinned + t.unmarked) as top from kept k join t using (center)),
 seen as (select *, rank <= top as first, rank <= top or slot in ({", ".join(f"'{x}'" for x in EXPANDED)}) as visible from r)"""


def tagged_neighbors(spark: SparkSession, d: str) -> DataFrame:
    rows = neighbors(spark, d).withColumn("first_tag", F.when(F.substring("id", 2, 20).cast("bigint") % 3 == 0, F.col("tag")))
    return rows.select("center", "id", "score", "mark", "mark_rank", F.col("first_tag").alias("tag"), "year", "title", "title_key")


@query(f"with {_ranked_sql()} select center, id, rank, first from seen where visible")
def k07_rank_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of every neighborhood: pinned and unmarked works to the limit, then the members of expanded clusters, all in rank order."""
    return P.neighborhoods(tagged_neighbors(spark, d), SHOWN, EXPANDED).where("visible").select("center", "id", "rank", "first")


TAG_LIST = ", ".join(f"'{x}'" for x in FILTER)


@query(f"with {_ranked_sql(f'first_tag in ({TAG_LIST})')}, a as (select center, count(*) as n from nb group by center) select a.center, coalesce(t.n - t.hidden, 0) as total, a.n - coalesce(t.n, 0) as filtered_out, coalesce(t.hidden, 0) as hidden, (select count(*) from seen where seen.center = a.center and visible) as shown from a left join t using (center)")
def k07_filtered_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of every neighborhood seen through a tag filter: works without the hidden, works filtered out, hidden ones, shown ones."""
    rows = tagged_neighbors(spark, d)
    every = rows.groupBy("center").agg(F.count("*").alias("n"))
    kept = P.neighborhoods(rows.where(F.col("tag").isin(*FILTER)), SHOWN, EXPANDED).groupBy("center").agg(F.count("*").alias("k"), F.count_if(F.col("mark") == "hidden").alias("h"), F.count_if("visible").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.join(kept, "center", "left").select("center", (zero("k") - zero("h")).alias("total"), (F.col("n") - zero("k")).alias("filtered_out"), zero("h").alias("hidden"), zero("s").alias("shown"))


@query(f"""with {_ranked_sql()}, c as (select center, slot, count(*) as members, min(rank) as first_rank from seen where not visible group by all), m as (select center, slot, title, rank, row_number() over (partition by center, slot order by rank) as n from seen where not visible),
 s as (select center, slot, string_agg(title, ' / ' order by rank) as samples from m where n <= 3 group by all)
 select c.center, c.slot, c.members, s.samples, row_number() over (partition by c.center order by case when c.slot like 'tag:%' then 0 when c.slot = 'decade:unknown' then 2 when c.slot like 'decade:%' then 1 when c.slot = 'downplayed' then 3 else 4 end, case when c.slot like 'tag:%' then lower(c.slot) else '' end, case when c.slot like 'decade:%' and c.slot <> 'decade:unknown' then -cast(substr(c.slot, 8) as int) else 0 end) as place from c join s using (center, slot)""")
def k07_clusters(spark: SparkSession, d: str) -> DataFrame:
    """What isn't shown of every neighborhood, as clusters in order: tags by name, decades from the newest, unknown years, downplayed, hidden; with size and first three titles."""
    return P.clusters(P.neighborhoods(tagged_neighbors(spark, d), SHOWN, EXPANDED))


@query(f"with {_ranked_sql()}, shown as (select center, id from seen where visible union select distinct center, center from nb) select distinct a.center, l.citing, l.cited from shown a join live l on l.citing = a.id join shown b on b.center = a.center and b.id = l.cited")
def j10_neighbors_response(spark: SparkSession, d: str) -> DataFrame:
    """The edges between what is shown of every neighborhood, its center included."""
    rows = tagged_neighbors(spark, d)
    shown = P.neighborhoods(rows, SHOWN, EXPANDED).where("visible").select("center", "id").unionByName(rows.select("center", F.col("center").alias("id")).distinct())
    edges = live(spark, d).select("citing", "cited").distinct()
    return edges.join(shown.withColumnRenamed("id", "citing"), "citing").join(shown.withColumnRenamed("id", "cited"), ["center", "cited"]).select("center", "citing", "cited").distinct()


@query(f"with {TAGGED} select distinct id, {SLOT} as slot from nb")
def k08_cluster_slot(spark: SparkSession, d: str) -> DataFrame:
    return tagged_neighbors(spark, d).select("id", P.cluster_slot(F.col("mark"), F.col("tag"), F.col("year")).alias("slot")).distinct()


@query("select p_name as work, arg_min(p_brand, lower(p_brand) || '|' || p_partkey) as tag from part group by p_name")
def k09_first_tag(spark: SparkSession, d: str) -> DataFrame:
    """The first tag by lower-case name, then id."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("work")).agg(F.min_by("p_brand", F.concat(F.lower("p_brand"), F.lit("|"), F.col("p_partkey").cast("string"))).alias("tag"))


@query()
def k10_suggest_order(spark: SparkSession, d: str) -> DataFrame:
    """Reading orders of all orders' parts: cited works first, cycles broken by priority, the seed last."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ramp"), F.col("l_partkey").alias("id")).distinct()
    w = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("depth"), (F.col("p_partkey") % 100 / 100).alias("score"), F.when(F.col("p_partkey") % 17 != 0, (1900 + F.col("p_partkey") % 120).cast("int")).alias("year"), F.lower("p_name").alias("title_key"))
    seeds = lines.groupBy("ramp").agg(F.min("id").alias("seed"))
    items = lines.join(w, "id").join(seeds, "ramp").withColumn("is_seed", F.col("id") == F.col("seed")).drop("seed")
    cites = lines.withColumnRenamed("id", "citing").join(lines.withColumnRenamed("id", "cited"), "ramp").where("citing < cited and (citing + cited) % 3 = 0")
    return reading_order(items, cites, "ramp")


@query(f"with {WORKS} select kind, id, row_number() over (partition by kind order by num % 5 desc, num % 100 desc, year asc nulls last, lower(title), id) as place from works")
def k11_priority(spark: SparkSession, d: str) -> DataFrame:
    """Reading priority: depth, score, oldest first, title, id."""
    rows = works(spark, d).withColumn("depth", F.col("num") % 5).withColumn("score", F.col("num") % 100).withColumn("key", F.lower("title"))
    order = [F.desc("depth"), F.desc("score"), F.asc_nulls_last("year"), F.asc("key"), F.asc("id")]
    return ranked(rows, ["kind"], order, "place").select("kind", "id", "place")


COLUMN = "order by case mark when 'pinned' then 0 when 'downplayed' then 2 when 'hidden' then 3 else 1 end, num % 100 desc, trim(lower(title)) = '', trim(lower(title)), id"


@query(f"with {WORKS} select year, id, row_number() over (partition by year {COLUMN}) as place from works")
def k13_histogram_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each histogram column in order: mark, score, untitled last, title, id."""
    rows = works(spark, d).withColumn("m", P.mark_rank(F.col("mark"))).withColumn("score", F.col("num") % 100).withColumn("key", F.trim(F.lower("title")))
    order = [F.asc("m"), F.desc("score"), F.asc(F.col("key") == ""), F.asc("key"), F.asc("id")]
    return ranked(rows, ["year"], order, "place").select("year", "id", "place")


@query(f"with {WORKS}, f as (select year, id, num, mark, title from works qualify row_number() over (partition by year {COLUMN}) = 1) select id from f {COLUMN} limit 1")
def k14_initial_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The best entry of all columns' first rows, which is the best of all."""
    rows = works(spark, d).withColumn("key", F.trim(F.lower("title")))
    return rows.agg(F.min(F.struct(P.mark_rank(F.col("mark")).alias("m"), (-(F.col("num") % 100)).alias("s"), (F.col("key") == "").alias("e"), "key", "id")).alias("b")).select("b.id")


@query("select lower(title) as key, count(*) as candidates, arg_min(openalex_id, struct_pack(a := -len(coalesce(referenced_works, [])), b := length(openalex_id), c := openalex_id)) as openalex_id from openalex_work where title is not null group by 1")
def k16_select_title_match(spark: SparkSession, d: str) -> DataFrame:
    """Of the records with one title the one that refers to most works, then the shortest and smallest id."""
    rows = table(spark, d, "openalex_work").where("title is not null")
    order = F.struct(-F.coalesce(F.size("referenced_works"), F.lit(0)), F.length("openalex_id"), "openalex_id")
    return rows.groupBy(F.lower("title").alias("key")).agg(F.count("*").alias("candidates"), F.min_by("openalex_id", order).alias("openalex_id"))


@query(f"with {WORKS}, r as (select id, kind, row_number() over (partition by kind order by num) - 1 as n from works) select id, cast(n // 36 as int) as ring, round(cos(2 * pi() * (n % 36) / 36) * (n // 36 + 1), 6) + 0.0 as x, round(sin(2 * pi() * (n % 36) / 36) * (n // 36 + 1), 6) + 0.0 as y  from r")
def k25_ring_layout(spark: SparkSession, d: str) -> DataFrame:
    """Places of ranked works on rings of 36."""
    r = ranked(works(spark, d), ["kind"], ["num"]).withColumn("n", F.col("rank") - 1)
    ring, angle = F.floor(F.col("n") / 36), 2 * F.pi() * (F.col("n") % 36) / 36
    return r.select("id", ring.cast("int").alias("ring"), (F.round(F.cos(angle) * (ring + 1), 6) + 0.0).alias("x"), (F.round(F.sin(angle) * (ring + 1), 6) + 0.0).alias("y"))
