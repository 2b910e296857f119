"""Upserts, merges, reconciliation and deduplication as table-to-table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..session import table
from .catalog import query


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "field_claim").select("work_id", "field", "id", "origin", "value", F.unix_micros("created_at").alias("made"))
    return rows.where("made < 1736000000000000"), rows.where("made >= 1736000000000000")


OLD_NEW = "c as (select work_id, field, id, origin, value, epoch_us(created_at) as made from field_claim), o as (select * from c where made < 1736000000000000), n as (select * from c where made >= 1736000000000000)"


@query(f"with {OLD_NEW}, ob as (select * from o qualify row_number() over (partition by work_id, field order by made, id) = 1), nb as (select * from n qualify row_number() over (partition by work_id, field order by made desc, id desc) = 1) select * from nb union all select * from ob where not exists (select 1 from nb where nb.work_id is not distinct from ob.work_id and nb.field is not distinct from ob.field)")
def w01_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored claim of each work and field, replaced by the newest of a batch."""
    old, new = _claims(spark, d)
    first = C.insert_ignore(old.where("false"), old, ["work_id", "field"], ["made", "id"])
    return C.upsert(first, new, ["work_id", "field"], ["made", "id"])


@query("select sha256(text) as storage_key, min(doc_id) as doc_id from documents where text is not null group by 1")
def w02_upsert_blob(spark: SparkSession, d: str) -> DataFrame:
    """Get-or-create by content hash: the first document of each."""
    rows = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("storage_key"), "doc_id")
    return C.insert_ignore(rows.where("false"), rows, ["storage_key"], ["doc_id"])


@query("select citing_version_id, entry_key, arg_min(id, struct_pack(a := ordinal, b := id)) as id from bibliography_entry group by 1, 2")
def w04_insert_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bibliography_entry").select("citing_version_id", "entry_key", "id", "ordinal")
    return C.insert_ignore(rows.where("false"), rows, ["citing_version_id", "entry_key"], ["ordinal", "id"]).drop("ordinal")


@query("select document_version_id, page, marker_start, min(id) as id, arg_min(sha256(passage), id) as passage_hash from citation_mention where passage is not null group by 1, 2, 3")
def w05_insert_mention(spark: SparkSession, d: str) -> DataFrame:
    """Mentions once per place, with their passage's hash."""
    rows = table(spark, d, "citation_mention").where("passage is not null").select("document_version_id", "page", "marker_start", "id", F.sha2("passage", 256).alias("passage_hash"))
    return C.insert_ignore(rows.where("false"), rows, ["document_version_id", "page", "marker_start"], ["id"])


@query(f"with {OLD_NEW}, ob as (select * from o qualify row_number() over (partition by work_id, field, value order by made, id) = 1), nb as (select * from n qualify row_number() over (partition by work_id, field, value order by made, id) = 1) select * from ob union all select * from nb where not exists (select 1 from ob where ob.work_id is not distinct from nb.work_id and ob.field is not distinct from nb.field and ob.value is not distinct from nb.value)")
def w11_insert_claim_once(spark: SparkSession, d: str) -> DataFrame:
    """Claims that aren't stored yet are added, nulls comparing as equal."""
    old, new = _claims(spark, d)
    stored = C.insert_ignore(old.where("false"), old, ["work_id", "field", "value"], ["made", "id"])
    return C.insert_ignore(stored, new, ["work_id", "field", "value"], ["made", "id"])


@query("select user_id, to_json(list_slice(list(event_id order by ts, event_id), -20, -1)) as trials from events group by user_id")
def w23_push_trial(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 trials of each key in their order, found by a two-level top-k."""
    from ..operators.topk import top_k

    rows = table(spark, d, "events").select("user_id", "event_id", F.col("ts"))
    kept = top_k(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20, "event_id")
    return kept.groupBy("user_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"])).alias("trials"))


SCAN = """b as (select doc_id, coalesce(sha256(text), '') as sha from documents), o as (select 'f' || doc_id as path, sha from b where doc_id % 3 <> 0),
 s as (select 'f' || case when doc_id % 7 = 0 then doc_id + 500000 else doc_id end as path, case when doc_id % 11 = 0 then sha || 'x' else sha end as sha from b where doc_id % 5 <> 0)"""


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("sha"))
    k = F.col("doc_id")
    path = lambda c: F.concat(F.lit("f"), c.cast("string")).alias("path")
    return b.where(k % 3 != 0).select(path(k), "sha"), b.where(k % 5 != 0).select(path(F.when(k % 7 == 0, k + 500000).otherwise(k)), F.when(k % 11 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("sha"))


RECONCILED = f"""with {SCAN}, m as (select coalesce(o.path, s.path) as path, o.sha as old_sha, s.sha as new_sha from o full join s on o.path = s.path),
 gone as (select path, old_sha as sha, row_number() over (partition by old_sha order by path) as k from m where new_sha is null), fresh as (select path, new_sha as sha, row_number() over (partition by new_sha order by path) as k from m where old_sha is null),
 mv as (select f.path, f.sha, f.k, g.path as was from fresh f left join gone g on g.sha = f.sha and g.k = f.k), have as (select distinct new_sha as sha from m where old_sha is not null and new_sha is not null)
 select path, new_sha as sha, case when old_sha = new_sha then 'unchanged' else 'replaced' end as decision from m where old_sha is not null and new_sha is not null
 union all select mv.path, mv.sha, case when was is not null then 'moved' when have.sha is not null or k > 1 then 'duplicate' else 'added' end from mv left join have on have.sha = mv.sha
 union all select path, sha, {{}} from gone where path not in (select was from mv where was is not null)"""


@query(RECONCILED.format("'tombstoned'"))
def d08_reconcile_files(spark: SparkSession, d: str) -> DataFrame:
    """A library scan against the stored files, with tombstones for what is gone."""
    return C.reconcile(*_files(spark, d))


_DONE = f"select * from ({RECONCILED.format(chr(39) + 'tombstoned' + chr(39))})"


@query(f"{_DONE} where decision = 'moved'")
def d09_move_candidate(spark: SparkSession, d: str) -> DataFrame:
    """New paths whose content a vanished path had."""
    return C.reconcile(*_files(spark, d)).where("decision = 'moved'")


@query(f"{_DONE} where decision = 'tombstoned'")
def d10_tombstone(spark: SparkSession, d: str) -> DataFrame:
    """Stored paths that the scan lacks and that moved nowhere."""
    return C.reconcile(*_files(spark, d)).where("decision = 'tombstoned'")


@query(f"select path, sha from ({RECONCILED.format(chr(39) + 'tombstoned' + chr(39))}) where decision <> 'tombstoned'")
def d18_apply_scan(spark: SparkSession, d: str) -> DataFrame:
    """The library after a full scan."""
    return C.reconcile(*_files(spark, d)).where("decision <> 'tombstoned'").select("path", "sha")


@query(f"select decision, count(*) as files from ({RECONCILED.format(chr(39) + 'tombstoned' + chr(39))}) group by 1")
def d20_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """How many files a scan leaves, replaces, moves, adds, doubles and loses."""
    return C.reconcile(*_files(spark, d)).groupBy("decision").agg(F.count("*").alias("files"))


@query(RECONCILED.format("'unchanged'"))
def d19_apply_partial_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(*_files(spark, d), partial=True)


@query("select openalex_id, (doi is not null)::int + (title is not null)::int + (\"year\" is not null)::int + (len(authors) > 0)::int as completeness from openalex_work")
def d03_completeness(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: c.cast("int")
    return table(spark, d, "openalex_work").select("openalex_id", (n(F.col("doi").isNotNull()) + n(F.col("title").isNotNull()) + n(F.col("year").isNotNull()) + n(F.size("authors") > 0)).alias("completeness"))


@query("with p as (select document_version_id, passage, min(struct_pack(a := marker_start, b := id)) as f from citation_mention where passage is not null group by 1, 2) select document_version_id, passage from p qualify row_number() over (partition by document_version_id order by f) <= 6")
def d05_distinct_passages(spark: SparkSession, d: str) -> DataFrame:
    """The first six different passages of each document."""
    from ..operators.topk import top_k

    p = table(spark, d, "citation_mention").where("passage is not null").groupBy("document_version_id", "passage").agg(F.min(F.struct("marker_start", "id")).alias("f"))
    return top_k(p, ["document_version_id"], [F.asc("f")], 6, "f").select("document_version_id", "passage")


@query("select id, list_sort(list_distinct(list_filter(display_authors, lambda x: x <> ''))) as names from graph_work where display_authors is not null")
def d07_sorted_unique(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_work").where("display_authors is not null").select("id", F.array_sort(F.array_distinct(F.filter("display_authors", lambda x: x != ""))).alias("names"))
