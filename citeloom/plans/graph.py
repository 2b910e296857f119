"""Joins and traversal over the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traversal
from ..operators.topk import ranked
from ..session import table
from .catalog import query
from .views import ASSERTIONS, DOCUMENTS_OF, WORKS, assertions, documents_of, live, works


@query(f"with {ASSERTIONS}, {WORKS} select distinct l.citing, w.id as cited, w.title, w.year from live l join works w on l.cited = w.id")
def j01_outgoing(spark: SparkSession, d: str) -> DataFrame:
    """Distinct works each work cites over live edges."""
    edges = live(spark, d).select("citing", "cited").distinct()
    return edges.join(works(spark, d).withColumnRenamed("id", "cited"), "cited").select("citing", "cited", "title", "year")


@query(f"with {ASSERTIONS} select distinct l.cited, s.s_name as citing_name, l.citing from live l join supplier s on l.citing = 'S' || s.s_suppkey")
def j02_incoming(spark: SparkSession, d: str) -> DataFrame:
    """Distinct works that cite each work."""
    names = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("citing"), F.col("s_name").alias("citing_name"))
    return live(spark, d).select("citing", "cited").distinct().join(names, "citing").select("cited", "citing_name", "citing")


@query(f"with {ASSERTIONS} select distinct citing, cited from live where citing in (select 'S' || s_suppkey from supplier where s_acctbal > 0) and cited in (select 'P' || p_partkey from part where p_size <= 10)")
def j03_edges_among(spark: SparkSession, d: str) -> DataFrame:
    """Live edges with both ends in given sets."""
    left = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("citing"))
    right = table(spark, d, "part").where("p_size <= 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("cited"))
    return live(spark, d).select("citing", "cited").join(left, "citing", "left_semi").join(right, "cited", "left_semi").distinct()


@query(f"with {ASSERTIONS} select citing, cited, count(*) as assertions, count(distinct source) as sources, cast(sum(place) as bigint) as mentions from live group by citing, cited")
def j04_edge_sources(spark: SparkSession, d: str) -> DataFrame:
    """What supports each edge: assertions, source records and mentions."""
    return live(spark, d).groupBy("citing", "cited").agg(F.count("*").alias("assertions"), F.countDistinct("source").alias("sources"), F.sum("place").alias("mentions"))


@query(f"""with {ASSERTIONS} select citing, cited, label, source, place from live
 qualify row_number() over (partition by citing, cited order by observed_at desc, source desc, place desc) = 1""")
def j05_current_claims(spark: SparkSession, d: str) -> DataFrame:
    """The newest label of each live edge, as one aggregate that combines before the shuffle."""
    newest = live(spark, d).groupBy("citing", "cited").agg(F.max(F.struct("observed_at", "source", "place", "label")).alias("m"))
    return newest.select("citing", "cited", "m.label", "m.source", "m.place")


@query(f"with {ASSERTIONS}, {DOCUMENTS_OF}, {WORKS} select distinct l.citing, l.cited, w.year from live l join works w on w.id = l.cited where not exists (select 1 from documents_of x where x.work = l.cited and x.state = 'present')")
def j06_cited_targets(spark: SparkSession, d: str) -> DataFrame:
    """Cited works without a present document."""
    present = documents_of(spark, d).where("state = 'present'").select(F.col("work").alias("cited"))
    edges = live(spark, d).select("citing", "cited").distinct().join(present, "cited", "left_anti")
    return edges.join(works(spark, d).select(F.col("id").alias("cited"), "year"), "cited").select("citing", "cited", "year")


@query(f"with {ASSERTIONS}, {DOCUMENTS_OF}, {WORKS} select id from works w where exists (select 1 from live l where l.cited = w.id) or exists (select 1 from documents_of x where x.work = w.id and x.state = 'present')")
def j07_participating_works(spark: SparkSession, d: str) -> DataFrame:
    """Works that are cited or have a document; both checks become semi joins over one union of ids."""
    ids = live(spark, d).select(F.col("cited").alias("id")).unionByName(documents_of(spark, d).where("state = 'present'").select(F.col("work").alias("id")))
    return works(spark, d).select("id").join(ids, "id", "left_semi")


@query(f"""with {ASSERTIONS}, edge as (select distinct citing, cited from live) select id, count(*) as size from (
 select citing as id, cited as other from edge union select cited, citing from edge union select citing, citing from edge union select cited, cited from edge) group by id""")
def j08_neighborhood_of(spark: SparkSession, d: str) -> DataFrame:
    """Size of each work's neighborhood: itself and its distinct neighbors."""
    e = live(spark, d).select("citing", "cited").distinct()
    both = e.select(F.explode(F.array(F.struct(F.col("citing").alias("id"), F.col("cited").alias("other")), F.struct(F.col("cited").alias("id"), F.col("citing").alias("other")))).alias("x")).select("x.*")
    return both.distinct().groupBy("id").agg((F.count("*") + 1).alias("size"))


@query(f"""with {ASSERTIONS}, edge as (select distinct citing, cited from live) select 'references' as direction, citing as center, cited as neighbor from edge
 union all select 'citations', cited, citing from edge""")
def j09_collect_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbors in both directions."""
    e = live(spark, d).select("citing", "cited").distinct()
    return e.select(F.lit("references").alias("direction"), F.col("citing").alias("center"), F.col("cited").alias("neighbor")).unionByName(e.select(F.lit("citations").alias("direction"), F.col("cited").alias("center"), F.col("citing").alias("neighbor")))


REDIRECTS = "pairs as (select work_id as src, lead(work_id) over (partition by scheme, value_normalized order by work_id) as dst from (select distinct scheme, value_normalized, work_id from work_identifier where status <> 'retracted' and value_normalized <> '' and work_id is not null and scheme is not null) t), one as (select src, max(dst) as dst from pairs where dst is not null group by src)"


@query(f"""with recursive {REDIRECTS}, walk as (select src, dst as place, 1 as hops from one union all select w.src, o.dst, w.hops + 1 from walk w join one o on w.place = o.src where w.hops < 8)
 select src as "old", arg_max(place, hops) as target, cast(max(hops) as int) as hops from walk group by src""")
def j11_resolve_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Where chains of redirects lead within eight hops: three rounds of pointer doubling."""
    rows = table(spark, d, "work_identifier").where("status <> 'retracted' and value_normalized <> '' and work_id is not null and scheme is not null").select("scheme", "value_normalized", "work_id").distinct()
    at = ranked(rows, ["scheme", "value_normalized"], ["work_id"], "n")
    ahead = at.select("scheme", "value_normalized", (F.col("n") - 1).alias("n"), F.col("work_id").alias("new"))
    nxt = at.join(ahead, ["scheme", "value_normalized", "n"])
    return traversal.resolve_redirects(nxt.groupBy(F.col("work_id").alias("old")).agg(F.max("new").alias("new")), hops=8)


CO = """co as (select distinct a.l_partkey as citing, b.l_partkey as cited from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"""


def co_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between parts of one order (an order has at most seven lines)."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pairs = rows.withColumnRenamed("l_partkey", "citing").join(rows.withColumnRenamed("l_partkey", "cited"), "l_orderkey").where("citing < cited")
    return pairs.select("citing", "cited").distinct()


SEEDS = "select p_partkey as node from part where p_size = 1"


@query(f"""with recursive {CO}, walk as (select node, 0 as depth from ({SEEDS}) union select c.cited, w.depth + 1 from walk w join co c on c.citing = w.node where w.depth < 3)
 select node, cast(min(depth) as int) as depth from walk group by node""")
def j12_walk(spark: SparkSession, d: str) -> DataFrame:
    """Level-synchronous breadth-first search to depth three from all seeds."""
    return traversal.levels(co_edges(spark, d), table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), depth=3)


FIRST = f"""{CO}, {WORKS}, b as (select c.citing as seed, c.cited as work, row_number() over (partition by c.citing order by w.num % 100 desc, w.year desc nulls last, c.cited) as n from co c join works w on w.num = c.cited join ({SEEDS}) s on s.node = c.citing where w.mark is null or w.mark not in ('hidden', 'downplayed')), chosen as (select seed, 1 as level, n - 1 as place, seed as parent, work from b where n <= 10)"""


def _walk(spark: SparkSession, d: str, depth: int) -> DataFrame:
    from ..session import cut

    w = works(spark, d).select(F.col("num").alias("id"), ((F.col("num") % 100).cast("double") / 100).alias("score"), "year", "mark")
    seeds = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("seed"))
    return traversal.walk(cut(co_edges(spark, d)), w, seeds, depth)


@query(f"with {FIRST} select node as seed, 0 as level, 0 as place, null::bigint as parent, node as work from ({SEEDS}) union all select * from chosen")
def j12_walk_from_with_budget(spark: SparkSession, d: str) -> DataFrame:
    """Walks of two levels within fanout and budget; SQL can't state a third, which tests compare with brute force."""
    return _walk(spark, d, 2).select("seed", "level", "place", "parent", "work")


@query()
def j12_walk_three_levels(spark: SparkSession, d: str) -> DataFrame:
    """Walks of three levels: a child taken by an earlier parent doesn't use up a later one's fanout."""
    return _walk(spark, d, 3)


@query(f"with {FIRST} select node as seed, node as work, cast(node as varchar) as path from ({SEEDS}) union all select seed, work, seed || '>' || work from chosen")
def j20_walk_path_to(spark: SparkSession, d: str) -> DataFrame:
    """The way from a walk's seed to each of its works."""
    return traversal.paths(_walk(spark, d, 2), 2).select("seed", "work", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"with {FIRST}, closed as (select node from ({SEEDS}) where node % 2 = 0) select node as seed, node as work from ({SEEDS}) union all select seed, work from chosen where seed not in (select node from closed)")
def j21_collapse_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Walks after the expansions of every second seed are closed."""
    walked = _walk(spark, d, 2)
    return traversal.collapsed(walked, walked.where("level = 0 and seed % 2 = 0").select("seed", "work"), 2).select("seed", "work")


@query(f"with {CO}, {WORKS} select c.citing as parent, c.cited as work, cast(w.num % 100 as double) / 100 as score, w.year, w.mark from co c join works w on w.num = c.cited")
def j13_frontier_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Children of all parents with score, year and mark."""
    w = works(spark, d).select(F.col("num").alias("cited"), ((F.col("num") % 100).cast("double") / 100).alias("score"), "year", "mark")
    return co_edges(spark, d).join(w, "cited").select(F.col("citing").alias("parent"), F.col("cited").alias("work"), "score", "year", "mark")


@query()
def j14_plan_frontier(spark: SparkSession, d: str) -> DataFrame:
    """For parents in order, the best children that no earlier parent has taken, up to a fanout and a budget per shelf of parents."""
    rows = j13_frontier_candidates(spark, d).withColumn("shelf", F.floor(F.col("parent") / 50))
    return traversal.plan_frontier(rows, "shelf", fanout=5, budget=40)


@query("select work_id, scheme, value_normalized as value from work_identifier where status = 'active' and value_normalized <> '' and work_id is not null and scheme in ('openalex','doi','arxiv') qualify row_number() over (partition by work_id order by list_position(['openalex','doi','arxiv'], scheme), created_at, id, value_normalized) = 1")
def j15_provider_lookup_key(spark: SparkSession, d: str) -> DataFrame:
    """The identifier to look a work up by: openalex, else doi, else arxiv; the oldest of equals."""
    order = F.array(*map(F.lit, ["openalex", "doi", "arxiv"]))
    rows = table(spark, d, "work_identifier").where("status = 'active' and value_normalized <> '' and work_id is not null and scheme in ('openalex', 'doi', 'arxiv')")
    best = rows.groupBy("work_id").agg(F.min(F.struct(F.array_position(order, F.col("scheme")).alias("o"), "created_at", "id", "value_normalized", "scheme")).alias("m"))
    return best.select("work_id", "m.scheme", F.col("m.value_normalized").alias("value"))


@query("""select w.openalex_id as citing, r.ref as cited, t.title as cited_title, t.openalex_id is not null as resolved from openalex_work w, unnest(w.referenced_works) as r(ref) left join openalex_work t on t.openalex_id = r.ref where r.ref <> w.openalex_id""")
def j17_ingest_references(spark: SparkSession, d: str) -> DataFrame:
    """References of provider records as edges, resolved where the cited record is known; no record cites itself."""
    w = table(spark, d, "openalex_work")
    e = w.select(F.col("openalex_id").alias("citing"), F.explode("referenced_works").alias("cited")).where("citing <> cited")
    known = w.select(F.col("openalex_id").alias("cited"), F.col("title").alias("cited_title"), F.lit(True).alias("k"))
    return e.join(known, "cited", "left").select("citing", "cited", "cited_title", F.col("k").isNotNull().alias("resolved"))


@query("select distinct g.id, o.title, o.year from graph_work g join openalex_work o on lower(o.title) = lower(g.display_title) where g.display_authors is null or g.display_year is null")
def j18_hydrate_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Works that lack authors or a year, with what the provider record of the same title says."""
    g = table(spark, d, "graph_work").where("display_authors is null or display_year is null").select("id", F.lower("display_title").alias("key"))
    return g.join(table(spark, d, "openalex_work").select(F.lower("title").alias("key"), "title", "year"), "key").select("id", "title", "year").distinct()


@query(f"with {ASSERTIONS}, {DOCUMENTS_OF}, n as (select cited as work, count(distinct citing) as c from live group by cited) select w.p_partkey as num, coalesce(x.state, case when n.c > 0 then 'existing' else 'unknown' end) as state from part w left join documents_of x on x.work = 'P' || w.p_partkey left join n on n.work = 'P' || w.p_partkey")
def j19_cached_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's state of each work, else existing if it has edges, else unknown."""
    n = live(spark, d).groupBy(F.col("cited").alias("work")).agg(F.countDistinct("citing").alias("c"))
    base = table(spark, d, "part").select(F.col("p_partkey").alias("num"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("work"))
    return base.join(documents_of(spark, d), "work", "left").join(n, "work", "left").select("num", F.coalesce("state", F.when(F.col("c") > 0, "existing").otherwise("unknown")).alias("state"))


@query("""select m.id as mention_id, e.entry_key, e.ordinal, m.passage_start, m.passage_end from citation_mention m join bibliography_entry e on e.id = m.entry_id""")
def j22_attach_references(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with the entry they point at."""
    e = table(spark, d, "bibliography_entry").select(F.col("id").alias("entry_id"), "entry_key", "ordinal")
    return table(spark, d, "citation_mention").select(F.col("id").alias("mention_id"), "entry_id", "passage_start", "passage_end").join(e, "entry_id").drop("entry_id")


@query("""select c.id as claim_id, c.origin, e.entry_key, w.display_title as citing_title from field_claim c left join bibliography_entry e on e.id = c.entry_id left join graph_work w on w.id = c.work_id""")
def j24_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Claims with their entry and work, if any."""
    e = table(spark, d, "bibliography_entry").select(F.col("id").alias("entry_id"), "entry_key")
    w = table(spark, d, "graph_work").select(F.col("id").alias("work_id"), F.col("display_title").alias("citing_title"))
    return table(spark, d, "field_claim").select(F.col("id").alias("claim_id"), "origin", "entry_id", "work_id").join(e, "entry_id", "left").join(w, "work_id", "left").select("claim_id", "origin", "entry_key", "citing_title")


@query("""with l as (select document_version_id, marker_text, entry_id from citation_mention where marker_text is not null)
 select document_version_id, marker_text, case when count(distinct entry_id) = 1 then min(entry_id) end as destination, case when count(distinct entry_id) > 1 then 'ambiguous' when count(distinct entry_id) = 0 then 'unresolved' else 'resolved' end as state from l group by all""")
def j25_paper_links(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a document: one destination resolves them, several leave them ambiguous."""
    g = table(spark, d, "citation_mention").where("marker_text is not null").groupBy("document_version_id", "marker_text").agg(F.min("entry_id").alias("lo"), F.max("entry_id").alias("hi"))
    one = F.col("lo") == F.col("hi")
    return g.select("document_version_id", "marker_text", F.when(one, F.col("lo")).alias("destination"), F.when(F.col("lo").isNull(), "unresolved").when(one, "resolved").otherwise("ambiguous").alias("state"))


@query(f"with {ASSERTIONS} select citing, cited, count(*) as assertions, cast(count(*) filter (where label = 'uses_method') as bigint) as methods, cast(count(*) filter (where label = 'background') as bigint) as backgrounds from live group by citing, cited")
def j27_edge_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their grouped labels."""
    return live(spark, d).groupBy("citing", "cited").agg(F.count("*").alias("assertions"), F.count_if(F.col("label") == "uses_method").alias("methods"), F.count_if(F.col("label") == "background").alias("backgrounds"))


@query("select i.work_id, o.openalex_id, len(o.referenced_works) as referenced from work_identifier i left join openalex_work o on o.openalex_id = i.value_normalized where i.scheme = 'openalex' and i.status = 'active'")
def j28_fetch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts from cached provider records; a missing record leaves nulls."""
    i = table(spark, d, "work_identifier").where("scheme = 'openalex' and status = 'active'").select("work_id", F.col("value_normalized").alias("key"))
    o = table(spark, d, "openalex_work").select(F.col("openalex_id").alias("key"), "openalex_id", F.when(F.col("referenced_works").isNotNull(), F.size("referenced_works").cast("bigint")).alias("referenced"))
    return i.join(o, "key", "left").select("work_id", "openalex_id", "referenced")
