"""Merges of works that share an identifier, against the tables of works, identifiers and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merging as G
from ..session import table
from .catalog import query

STATE = """v as (select scheme, value_normalized as val, work_id from work_identifier where status <> 'retracted' and value_normalized <> '' and work_id is not null and scheme is not null),
 m as (select distinct v.work_id as old, h.root as new from v join (select scheme, val, min(work_id) as root from v group by all) h using (scheme, val) where v.work_id <> h.root),
 requests as (select old, new from m union select id, id from graph_work where display_year % 50 = 0 union select id, 'none-' || id from graph_work where display_year % 60 = 1),
 redirects as (select id as old, 'gone' as new from graph_work where display_year % 9 = 0 union select 'older-' || old, old from m),
 edges as (select m.old as citing, m.new as cited from m join graph_work g on g.id = m.old where length(g.display_title) % 7 = 0),
 decided as (select distinct r.old, r.new, case when r.old = r.new then 'same' when not exists (select 1 from graph_work g where g.id = r.old) or not exists (select 1 from graph_work g where g.id = r.new) then 'missing'
   when exists (select 1 from redirects d where d.old = r.old) or exists (select 1 from redirects d where d.old = r.new) or exists (select 1 from requests q where q.old <> q.new and q.old = r.new) then 'redirected'
   when exists (select 1 from edges e where (e.citing = r.old and e.cited = r.new) or (e.citing = r.new and e.cited = r.old)) then 'citation' else 'merged' end as decision from requests r),
 merged as (select old, min(new) as new from decided where decision = 'merged' group by old)"""


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(requests, works, redirects, edges)."""
    v = table(spark, d, "work_identifier").where("status <> 'retracted' and value_normalized <> '' and work_id is not null and scheme is not null").select("scheme", F.col("value_normalized").alias("val"), "work_id")
    root = v.groupBy("scheme", "val").agg(F.min("work_id").alias("root"))
    m = v.join(root, ["scheme", "val"]).where("work_id <> root").select(F.col("work_id").alias("old"), F.col("root").alias("new")).distinct()
    g = table(spark, d, "graph_work")
    requests = m.unionByName(g.where("display_year % 50 = 0").select(F.col("id").alias("old"), F.col("id").alias("new"))).unionByName(g.where("display_year % 60 = 1").select(F.col("id").alias("old"), F.concat(F.lit("none-"), "id").alias("new")))
    redirects = g.where("display_year % 9 = 0").select(F.col("id").alias("old"), F.lit("gone").alias("new")).unionByName(m.select(F.concat(F.lit("older-"), "old").alias("old"), F.col("old").alias("new"))).distinct()
    edges = m.join(g.select(F.col("id").alias("old"), F.length("display_title").alias("n")), "old").where("n % 7 = 0").select(F.col("old").alias("citing"), F.col("new").alias("cited"))
    return requests, g.select("id"), redirects, edges


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return G.decide(*_state(spark, d)).where("decision = 'merged'").groupBy("old").agg(F.min("new").alias("new"))


@query(f"with {STATE} select old, new, decision from decided")
def d11_merge_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Requests to merge works that share an identifier, with the first guard that refuses one."""
    return G.decide(*_state(spark, d))


@query(f"with {STATE} select r.old, coalesce(m.new, r.new) as new from redirects r left join merged m on m.old = r.new union all select old, new from merged")
def d11_merge_work(spark: SparkSession, d: str) -> DataFrame:
    """Redirects after the merges, older ones flattened."""
    return G.flattened(_state(spark, d)[2], _merged(spark, d))


@query(f"""with {STATE}, f as (select c.id, coalesce(m.new, c.work_id) as work_id, c.field, c.source_record_id, m.new is not null as moved from field_claim c left join merged m on m.old = c.work_id),
 b as (select *, first(id) over (partition by work_id, field, source_record_id order by moved, id) as keeper from f) select id, work_id, moved, case when moved and work_id is not null and field is not null and source_record_id is not null and keeper <> id then keeper end as survivor from b""")
def d12_repoint_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Facts led to the merged works; those that the target has from the same source already are folded into it."""
    facts = table(spark, d, "field_claim").select("id", "work_id", "field", "source_record_id")
    return G.repointed_once(facts, _merged(spark, d), "work_id", ["field", "source_record_id"]).select("id", "work_id", "moved", "survivor")


@query(f"with {STATE}, u as (select * from field_claim where origin = 'user' and retracted_at is null) select u.id from u join merged m on m.old = u.work_id where exists (select 1 from u i where i.work_id = m.new and i.field = u.field)")
def d13_retract_colliding_overrides(spark: SparkSession, d: str) -> DataFrame:
    """The active overrides of merged works whose field the target overrides itself."""
    u = table(spark, d, "field_claim").where("origin = 'user' and retracted_at is null").select("id", "work_id", "field")
    moved = u.join(_merged(spark, d), F.col("work_id") == F.col("old")).select("id", "new", "field")
    return moved.join(u.select(F.col("work_id").alias("new"), "field"), ["new", "field"], "left_semi").select("id")


@query(f"""with {STATE}, i as (select distinct id, work_id, scheme, value_normalized from work_identifier), f as (select i.id, coalesce(m.new, i.work_id) as work_id, scheme, value_normalized, m.new is not null as moved from i left join merged m on m.old = i.work_id),
 b as (select *, first(id) over (partition by work_id, scheme, value_normalized order by moved, id) as keeper from f) select id, work_id, scheme, value_normalized from b where not (moved and scheme is not null and value_normalized is not null and keeper <> id)""")
def d14_move_work_content(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers after the merges: moved ones that the target has already are deleted."""
    rows = table(spark, d, "work_identifier").select("id", "work_id", "scheme", "value_normalized").distinct()
    return G.repointed_once(rows, _merged(spark, d), "work_id", ["scheme", "value_normalized"]).where("survivor is null").select("id", "work_id", "scheme", "value_normalized")


MARKS = "marks as (select work_id, max(review_state) as mark from field_claim where work_id is not null and review_state is not null group by 1)"


@query(f"with {STATE}, {MARKS} select coalesce(m.new, k.work_id) as work_id, coalesce(max(case when m.new is null then mark end), min(case when m.new is not null then k.work_id || ':' || mark end)) as mark from marks k left join merged m on m.old = k.work_id group by 1")
def d15_move_curation(spark: SparkSession, d: str) -> DataFrame:
    """Marks after the merges: the target's own wins, else that of the first merged work."""
    marks = table(spark, d, "field_claim").where("work_id is not null and review_state is not null").groupBy("work_id").agg(F.max("review_state").alias("mark")).withColumn("was", F.concat_ws(":", "work_id", "mark"))
    rows = G.repointed(marks, _merged(spark, d), "work_id")
    own, other = F.max(F.when(~F.col("moved"), F.col("mark"))), F.min(F.when(F.col("moved"), F.col("was")))
    return rows.groupBy("work_id").agg(F.coalesce(own, other).alias("mark"))


@query(f"with {STATE}, l as (select origin as ramp, work_id, row_number() over (partition by origin order by work_id) as i from (select distinct origin, work_id from field_claim where origin is not null and work_id is not null)) select l.ramp, l.i as place, coalesce(m.new, l.work_id) as work_id from l left join merged m on m.old = l.work_id")
def d16_move_ramps(spark: SparkSession, d: str) -> DataFrame:
    """Ordered lists of works with every merged work replaced in its place."""
    from ..operators.topk import ranked

    rows = table(spark, d, "field_claim").where("origin is not null and work_id is not null").select(F.col("origin").alias("ramp"), "work_id").distinct()
    return G.repointed(ranked(rows, ["ramp"], ["work_id"], "place"), _merged(spark, d), "work_id").select("ramp", "place", "work_id")


@query(f"with {STATE} select g.id as work_id, not exists (select 1 from field_claim c where c.work_id = g.id and c.origin <> 'citing_bibliography') and not exists (select 1 from merged m where m.new = g.id) as stub from graph_work g")
def look_p10_is_auto_mergeable_stub(spark: SparkSession, d: str) -> DataFrame:
    """Works that nothing but citing bibliographies claims and that no merge leads to: two anti joins."""
    g = table(spark, d, "graph_work").select(F.col("id").alias("work_id"))
    held = table(spark, d, "field_claim").where("origin <> 'citing_bibliography'").select("work_id").unionByName(_merged(spark, d).select(F.col("new").alias("work_id"))).where("work_id is not null").distinct().withColumn("h", F.lit(True))
    return g.join(held, "work_id", "left").select("work_id", F.col("h").isNull().alias("stub"))
