"""Overrides, marks, tags and lists as table-to-table changes, and files written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators.topk import last_by, ranked
from ..session import ensure_checkpoint_dir, table
from ..sources import files as S
from .catalog import query

_CLAIM = "select id, work_id, field, value, origin, retracted_at is not null as retracted from field_claim"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_claim").select("id", "work_id", "field", "value", "origin", F.col("retracted_at").isNotNull().alias("retracted"))


@query(f"with c as ({_CLAIM}), b as (select id as work_id, 'title' as field, '\"Set by hand\"' as value from graph_work where display_year % 5 = 0), a as (select c.id, c.work_id, c.field, c.value, c.origin, c.retracted or (c.origin = 'user' and b.work_id is not null) as retracted from c left join b on b.work_id = c.work_id and b.field = c.field) select * from a union all select 'new-' || work_id, work_id, field, value, 'user', false from b")
def w12_set_override(spark: SparkSession, d: str) -> DataFrame:
    """A batch of overrides: the active one of each work and field is retracted, the new one appended."""
    new = table(spark, d, "graph_work").where("display_year % 5 = 0").select(F.col("id").alias("work_id"), F.lit("title").alias("field"), F.lit('"Set by hand"').alias("value"))
    keys = new.select("work_id", "field").withColumn("hit", F.lit(True))
    old = _claims(spark, d).join(keys, ["work_id", "field"], "left")
    kept = old.select("id", "work_id", "field", "value", "origin", (F.col("retracted") | ((F.col("origin") == "user") & F.coalesce("hit", F.lit(False)))).alias("retracted"))
    return kept.unionByName(new.select(F.concat(F.lit("new-"), "work_id").alias("id"), "work_id", "field", "value", F.lit("user").alias("origin"), F.lit(False).alias("retracted")))


@query("select g.id as work_id, coalesce(bool_or(c.id is not null), false) as cleared from graph_work g left join field_claim c on c.work_id = g.id and c.field = 'year' and c.origin = 'user' and c.retracted_at is null where g.display_year % 3 = 0 group by g.id")
def w13_clear_override(spark: SparkSession, d: str) -> DataFrame:
    """Works asked to drop their override of a field, and whether they had one."""
    asked = table(spark, d, "graph_work").where("display_year % 3 = 0").select(F.col("id").alias("work_id"))
    had = table(spark, d, "field_claim").where("field = 'year' and origin = 'user' and retracted_at is null").select("work_id", F.lit(True).alias("c")).distinct()
    return asked.join(had, "work_id", "left").select("work_id", F.coalesce("c", F.lit(False)).alias("cleared")).distinct()


@query("select id from field_claim where retracted_at is null and origin = 'user' and field = 'author' and json_array_length(try_cast(value as json)) = 1")
def w15_retract_active_override(spark: SparkSession, d: str) -> DataFrame:
    """Active overrides that a predicate on their JSON value selects."""
    return table(spark, d, "field_claim").where("retracted_at is null and origin = 'user' and field = 'author'").where(F.json_array_length("value") == 1).select("id")


@query("select entry_id, work_id, arg_max(review_state, struct_pack(c := created_at, i := id)) as status, arg_max(confidence, struct_pack(c := created_at, i := id)) as confidence from field_claim where entry_id is not null group by 1, 2")
def w06_record_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The last status and confidence of every entry and work."""
    rows = table(spark, d, "field_claim").where("entry_id is not null").select("entry_id", "work_id", F.col("review_state").alias("status"), "confidence", "created_at", "id")
    return last_by(rows, ["entry_id", "work_id"], ["created_at", "id"]).select("entry_id", "work_id", "status", "confidence")


@query("select id, case when review_state = 'accepted' and entry_id in (select id from bibliography_entry where page % 2 = 0) then 'withdrawn' else review_state end as status from field_claim where entry_id is not null")
def w07_withdraw_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Accepted rows of given entries become withdrawn, others stay."""
    keys = table(spark, d, "bibliography_entry").where("page % 2 = 0").select(F.col("id").alias("entry_id"))
    rows = table(spark, d, "field_claim").where("entry_id is not null").select("id", "entry_id", F.col("review_state").alias("status"))
    return C.update_where(rows, keys, "entry_id", {"status": F.when(F.col("status") == "accepted", "withdrawn").otherwise(F.col("status"))}).drop("entry_id")


@query("with t as (select p_brand as tag, min(p_partkey) as id, max(p_type) as kind from part group by 1) select id, case when id % 3 = 0 then 'New ' || tag else tag end as tag, case when id % 2 = 0 then 'method' else kind end as kind from t")
def w43_update_tag(spark: SparkSession, d: str) -> DataFrame:
    """Tags patched: what a patch leaves null stays."""
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.min("p_partkey").alias("id"), F.max("p_type").alias("kind"))
    patch = t.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("New "), "tag")).alias("new_tag"), F.when(F.col("id") % 2 == 0, "method").alias("new_kind")).where("new_tag is not null or new_kind is not null")
    return t.join(patch, "id", "left").select("id", F.coalesce("new_tag", "tag").alias("tag"), F.coalesce("new_kind", "kind").alias("kind"))


@query("select p_partkey as work, p_brand as tag from part where p_brand not in (select p_brand from part group by p_brand having min(p_partkey) % 2 = 0) and p_size > 5 union select p_partkey, 'Brand#new' from part where p_size > 45")
def w44_delete_and_assign_tags(spark: SparkSession, d: str) -> DataFrame:
    """Assignments after some tags are deleted with all their uses, some uses are taken away and a tag is assigned; twice is as once."""
    p = table(spark, d, "part")
    uses = p.select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("tag"))
    deleted = p.groupBy(F.col("p_brand").alias("tag")).agg(F.min("p_partkey").alias("m")).where("m % 2 = 0").select("tag")
    taken = p.where("p_size <= 5").select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("tag"))
    new = p.where("p_size > 45").select(F.col("p_partkey").alias("work"), F.lit("Brand#new").alias("tag"))
    return uses.join(deleted, "tag", "left_anti").join(taken, ["work", "tag"], "left_anti").select("work", "tag").unionByName(new).unionByName(new).distinct()


@query("with m as (select user_id as work, arg_max(event_type, struct_pack(a := ts, b := event_id)) as mark, arg_max(event_id, struct_pack(a := ts, b := event_id)) as note from events where event_type <> 'error' group by 1) select * from m where work not in (select user_id from events where event_type = 'error' group by 1 having count(*) > 12)")
def w47_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks set by a stream of changes, the last counting, and cleared for some works."""
    e = table(spark, d, "events").select(F.col("user_id").alias("work"), F.col("event_type").alias("mark"), F.col("event_id").alias("note"), "ts")
    last = last_by(e.where("mark <> 'error'"), ["work"], ["ts", "note"]).select("work", "mark", "note")
    cleared = e.where("mark = 'error'").groupBy("work").agg(F.count("*").alias("n")).where("n > 12").select("work")
    return last.join(cleared, "work", "left_anti")


@query("with i as (select distinct l_orderkey as ramp, l_linenumber as item from lineitem), o as (select ramp, item, row_number() over (partition by ramp order by item desc) - 1 as place from i where not (ramp % 4 = 0 and item = 1)), ok as (select ramp from i group by ramp having ramp % 4 <> 0 or (count(*) filter (item = 1)) = 0) select i.ramp, i.item, case when ok.ramp is not null then o.place else i.item - 1 end as place, ok.ramp is not null as applied from i left join o using (ramp, item) left join ok on ok.ramp = i.ramp")
def w53_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Positions by a given order, applied only where it is an exact permutation of the list's items; other lists keep theirs."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ramp"), F.col("l_linenumber").alias("item")).distinct()
    asked = items.where("not (ramp % 4 = 0 and item = 1)").groupBy("ramp").agg(F.reverse(F.array_sort(F.collect_list("item"))).alias("order"))  # an order has at most seven lines
    flat = asked.select("ramp", F.posexplode("order").alias("place", "item"))
    both = items.join(flat, ["ramp", "item"], "full_outer").withColumn("known", F.col("place").isNotNull())
    have = items.withColumn("h", F.lit(True))
    fits = both.join(have, ["ramp", "item"], "left").groupBy("ramp").agg((F.bool_and(F.col("known") & F.col("h").isNotNull()) & (F.count("*") == F.count_distinct("item"))).alias("applied"))
    rows = items.join(flat, ["ramp", "item"], "left").join(fits, "ramp")
    return rows.select("ramp", "item", F.when(F.col("applied"), F.col("place")).otherwise(F.col("item") - 1).alias("place"), "applied")


@query("with r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n, lead(event_id) over (partition by user_id order by ts, event_id) as nxt from events) select event_id as id, nxt as superseded_by, nxt is null as current from r")
def w17_supersede_with_user_claim(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with the one that replaced it; the last of a key is current. Places come from a global sort, not a window per key."""
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    at = ranked(rows, ["user_id"], ["ts", "id"], "n")
    nxt = at.select("user_id", (F.col("n") - 1).alias("n"), F.col("id").alias("superseded_by"))
    return at.join(nxt, ["user_id", "n"], "left").select("id", "superseded_by", F.col("superseded_by").isNull().alias("current"))


@query("with p as (select r.paper_id, u.p.page_number as n, regexp_replace(replace(replace(replace(substr(r.text, u.p.text_start + 1, u.p.text_end - u.p.text_start), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\*_\\[\\]])', '\\\\\\1', 'g') as t from reading_index r, unnest(r.pages) as u(p) where r.text is not null) select paper_id, sha256('# ' || paper_id || string_agg(chr(10) || chr(10) || '## Page ' || n || chr(10) || chr(10) || t, '' order by n)) as markdown from p group by paper_id")
def w63_render_source(spark: SparkSession, d: str) -> DataFrame:
    """Papers as Markdown with a heading per page, as a hash of the text."""
    from ..functions.text import escape_markdown

    rows = table(spark, d, "reading_index").where("text is not null and size(pages) > 0").select("paper_id", "text", F.explode("pages").alias("p"))
    page = F.concat(F.lit("\n\n## Page "), F.col("p.page_number").cast("string"), F.lit("\n\n"), escape_markdown(F.substr("text", F.col("p.text_start") + 1, F.col("p.text_end") - F.col("p.text_start"))))
    parts = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(F.col("p.page_number").alias("n"), page.alias("t")))).alias("s"))
    return parts.select("paper_id", F.sha2(F.concat(F.lit("# "), "paper_id", F.array_join(F.transform("s", lambda x: x["t"]), "")), 256).alias("markdown"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("select 'h' || event_id as id, user_id as page, event_type as quote from events where event_id % 3 <> 0")
def s07_load_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines in the order of their ids and read back; lines that can't be read are dropped."""
    rows = table(spark, d, "events").select(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").cast("int").alias("page"), F.col("event_type").alias("quote"), "event_id")
    line = F.when(F.col("event_id") % 3 == 0, F.lit('{"id": broken')).otherwise(F.to_json(F.struct("id", "page", "quote")))
    path = shared_path(spark, "highlights")
    rows.orderBy("id").select(line.alias("value")).write.text(path)
    return S.json_lines(spark, path, S.HIGHLIGHT).select("id", F.col("page").cast("bigint").alias("page"), "quote")


@query("select event_type as stage, count(*) as calls, round(sum(value), 4) as cost from events group by 1")
def s08_read_records(spark: SparkSession, d: str) -> DataFrame:
    """A ledger appended to twice and read back; a missing path is an empty ledger."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("cost_usd"), "event_id")
    path = shared_path(spark, "spend")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).drop("event_id").write.mode("append").json(path)
    ledger = S.json_lines(spark, path, S.SPEND).unionByName(S.json_lines(spark, path + "-missing", S.SPEND))
    return ledger.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost"))


@query("select 'j' || user_id as id, count(*) as progress from events group by 1")
def s06_load_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as JSON documents, read by their schema."""
    jobs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("progress")).select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("id"), "progress", F.struct(F.lit("running").alias("state")).alias("status"))
    path = shared_path(spark, "jobs")
    jobs.write.json(path)
    return S.json_lines(spark, path, S.JOB).select("id", F.col("progress").cast("bigint").alias("progress"))
