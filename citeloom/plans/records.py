"""Keyed lookups and table-to-table writes. Keys come as tables and meet by semi joins; order is a rank column where it is part of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titlekey import key_of
from ..operators import changes as C
from ..operators.topk import ranked
from ..session import table
from .catalog import query
from .selection import key_sql
from .views import ASSERTIONS, DOCUMENTS_OF, assertions, documents_of


def wanted(spark: SparkSession, d: str) -> DataFrame:
    """Ids of works that are asked for: those of claims by users, and one that isn't known."""
    ids = table(spark, d, "field_claim").where("origin = 'user'").select("work_id").where("work_id is not null").distinct()
    return ids.unionByName(spark.createDataFrame([("unknown",)], "work_id string"))


WANTED = "wanted as (select distinct work_id from field_claim where origin = 'user' and work_id is not null union select 'unknown')"


@query(f"with {WANTED} select w.work_id as asked, g.kind, g.display_title, g.display_year from wanted w left join graph_work g on g.id = w.work_id")
def look_p01_get(spark: SparkSession, d: str) -> DataFrame:
    """Works by id; an unknown id is asked for and not found."""
    g = table(spark, d, "graph_work").select(F.col("id").alias("work_id"), "kind", "display_title", "display_year")
    return wanted(spark, d).join(g, "work_id", "left").withColumnRenamed("work_id", "asked")


@query("select distinct i.scheme, i.value_normalized as value, m.document_version_id as version, g.id as work_id from work_identifier i join graph_work g on g.id = i.work_id join field_claim c on c.work_id = g.id join citation_mention m on m.entry_id = c.entry_id where i.status = 'active' and i.value_normalized <> ''")
def look_p04_find_by_version_identifier(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers with the versions that mention an entry of the work, and the work."""
    i = table(spark, d, "work_identifier").where("status = 'active' and value_normalized <> ''").select("work_id", "scheme", F.col("value_normalized").alias("value"))
    c = table(spark, d, "field_claim").select("work_id", "entry_id").where("entry_id is not null").distinct()
    m = table(spark, d, "citation_mention").select("entry_id", F.col("document_version_id").alias("version")).distinct()
    g = table(spark, d, "graph_work").select(F.col("id").alias("work_id"))
    return i.join(g, "work_id").join(c, "work_id").join(m, "entry_id").select("scheme", "value", "version", "work_id").distinct()


@query(f"with {WANTED}, u as (select work_id, scheme, value_normalized as value, created_at, id, 'work' as level from work_identifier where status = 'active' union all select c.work_id, 'entry', b.entry_key, b.created_at, b.id, 'version' from field_claim c join bibliography_entry b on b.id = c.entry_id) select work_id, scheme, value, level, row_number() over (partition by work_id order by scheme, created_at, id, value, level) as place from (select distinct u.* from u join wanted using (work_id))")
def look_p05_active_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of wanted works and of their printed entries, in order of scheme, time and id."""
    a = table(spark, d, "work_identifier").where("status = 'active'").select("work_id", "scheme", F.col("value_normalized").alias("value"), "created_at", "id", F.lit("work").alias("level"))
    b = table(spark, d, "bibliography_entry").select(F.col("id").alias("entry_id"), F.col("entry_key").alias("value"), "created_at")
    v = table(spark, d, "field_claim").select("work_id", "entry_id").join(b, "entry_id").select("work_id", F.lit("entry").alias("scheme"), "value", "created_at", F.col("entry_id").alias("id"), F.lit("version").alias("level"))
    rows = a.unionByName(v).join(wanted(spark, d), "work_id", "left_semi").distinct()
    return ranked(rows, ["work_id"], ["scheme", "created_at", "id", "value", "level"], "place").select("work_id", "scheme", "value", "level", "place")


@query("select document_version_id, epoch_us(min(created_at)) as first_seen, row_number() over (order by min(created_at), document_version_id) as place from citation_mention where document_version_id is not null group by 1")
def look_p06_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions, oldest first."""
    v = table(spark, d, "citation_mention").where("document_version_id is not null").groupBy("document_version_id").agg(F.min("created_at").alias("c"))
    return ranked(v, [], ["c", "document_version_id"], "place").select("document_version_id", F.unix_micros("c").alias("first_seen"), "place")


@query(f"with k as (select id, {key_sql('display_title')} as key from graph_work), r as (select work_id as old from work_identifier where status = 'retracted') select a.id as asked, b.id as found from k a join k b on a.key = b.key and a.id <> b.id where a.key <> '' and not exists (select 1 from r where r.old = b.id)")
def look_p08_find_by_title_key(spark: SparkSession, d: str) -> DataFrame:
    """Other works of each work's title key, without those that are withdrawn."""
    k = table(spark, d, "graph_work").select("id", key_of(F.col("display_title")).alias("key")).where("key <> ''")
    gone = table(spark, d, "work_identifier").where("status = 'retracted'").select(F.col("work_id").alias("found"))
    return k.withColumnRenamed("id", "asked").join(k.withColumnRenamed("id", "found"), "key").where("asked <> found").join(gone, "found", "left_anti").select("asked", "found")


@query(f"with {WANTED} select c.work_id, c.field, c.id, c.origin from field_claim c join wanted using (work_id) where c.field in ('title', 'year', 'author') and c.retracted_at is null and (c.field <> 'author' or json_array_length(try_cast(c.value as json)) > 1)")
def look_p11_claims_for(spark: SparkSession, d: str) -> DataFrame:
    """Claims of wanted works in tracked fields, author lists of several names only (a predicate on the JSON value)."""
    rows = table(spark, d, "field_claim").where("field in ('title', 'year', 'author') and retracted_at is null").where((F.col("field") != "author") | (F.json_array_length("value") > 1))
    return rows.join(wanted(spark, d), "work_id", "left_semi").select("work_id", "field", "id", "origin")


@query("with s as (select source_record_id, min(created_at) as seen from field_claim where source_record_id is not null group by 1), k as (select distinct source_record_id from field_claim where review_state = 'accepted') select source_record_id, row_number() over (order by seen, source_record_id) as place from s join k using (source_record_id)")
def look_p13_source_records(spark: SparkSession, d: str) -> DataFrame:
    """Source records of accepted claims, in order of their first claim."""
    s = table(spark, d, "field_claim").where("source_record_id is not null").groupBy("source_record_id").agg(F.min("created_at").alias("at"))
    return ranked(s.join(table(spark, d, "field_claim").where("review_state = 'accepted'").select("source_record_id"), "source_record_id", "left_semi"), [], ["at", "source_record_id"], "place").select("source_record_id", "place")


@query("select e.id, e.citing_version_id, c.work_id as cited, row_number() over (partition by e.citing_version_id order by e.ordinal, e.entry_key, e.id, c.work_id) as place from bibliography_entry e join (select distinct entry_id, work_id from field_claim where entry_id is not null) c on c.entry_id = e.id")
def look_p14_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the works they support, in printed order."""
    c = table(spark, d, "field_claim").where("entry_id is not null").select("entry_id", F.col("work_id").alias("cited")).distinct()
    e = table(spark, d, "bibliography_entry").select("id", "citing_version_id", "ordinal", "entry_key")
    return ranked(e.join(c, e["id"] == c["entry_id"]), ["citing_version_id"], ["ordinal", "entry_key", "id", "cited"], "place").select("id", "citing_version_id", "cited", "place")


@query("select e.id, e.entry_key, e.ordinal, min(c.work_id) as work_id from bibliography_entry e join field_claim c on c.entry_id = e.id where c.review_state = 'accepted' and c.retracted_at is null group by all")
def look_p17_resolved_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with an accepted work."""
    c = table(spark, d, "field_claim").where("review_state = 'accepted' and retracted_at is null and entry_id is not null").groupBy("entry_id").agg(F.min("work_id").alias("work_id"))
    e = table(spark, d, "bibliography_entry").select("id", "entry_key", "ordinal")
    return e.join(c, e["id"] == c["entry_id"]).select("id", "entry_key", "ordinal", "work_id")


@query("select assertion_id, id, page, marker_start, row_number() over (partition by document_version_id, assertion_id order by page, marker_start, id) as place from citation_mention where assertion_id is not null")
def look_p19_mentions_for_edge(spark: SparkSession, d: str) -> DataFrame:
    """All mentions of every edge in each version, in text order."""
    rows = table(spark, d, "citation_mention").where("assertion_id is not null").select("document_version_id", "assertion_id", "id", "page", "marker_start")
    return ranked(rows, ["document_version_id", "assertion_id"], ["page", "marker_start", "id"], "place").select("assertion_id", "id", "page", "marker_start", "place")


@query("select e.citing_version_id, e.id as entry_id, string_agg(m.id, '|' order by m.page, m.marker_start, m.id) as mentions from bibliography_entry e join citation_mention m on m.entry_id = e.id group by 1, 2")
def look_p20_local_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their nested mentions in text order, by one join instead of a query per edge."""
    m = table(spark, d, "citation_mention").where("entry_id is not null").groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "marker_start", "id"))), lambda x: x["id"]), "|").alias("mentions"))
    return table(spark, d, "bibliography_entry").select(F.col("id").alias("entry_id"), "citing_version_id").join(m, "entry_id").select("citing_version_id", "entry_id", "mentions")


@query(f"with {DOCUMENTS_OF} select p.work, x.state from (select 'P' || p_partkey as work from part where p_size <= 10) p join documents_of x using (work)")
def look_p22_states_for(spark: SparkSession, d: str) -> DataFrame:
    """States of a list of works; works without one are left out."""
    asked = table(spark, d, "part").where("p_size <= 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("work"))
    return documents_of(spark, d).join(asked, "work", "left_semi").select("work", "state")


@query("select c.id, c.field, e.ordinal, m.page, g.display_title from field_claim c join graph_work g on g.id = c.work_id left join bibliography_entry e on e.id = c.entry_id left join (select entry_id, min(page) as page from citation_mention group by 1) m on m.entry_id = c.entry_id")
def look_p26_get(spark: SparkSession, d: str) -> DataFrame:
    """Claims with their work, and with entry and first page where there are."""
    e = table(spark, d, "bibliography_entry").select(F.col("id").alias("entry_id"), "ordinal")
    m = table(spark, d, "citation_mention").where("entry_id is not null").groupBy("entry_id").agg(F.min("page").alias("page"))
    g = table(spark, d, "graph_work").select(F.col("id").alias("work_id"), "display_title")
    return table(spark, d, "field_claim").select("id", "field", "work_id", "entry_id").join(g, "work_id").join(e, "entry_id", "left").join(m, "entry_id", "left").select("id", "field", "ordinal", "page", "display_title")


@query("select k.doc_id, d.text is not null as hit, length(d.text) as size from (select doc_id from documents where doc_id % 5 = 0 union select -1) k left join documents d on d.doc_id = k.doc_id")
def look_p28_find(spark: SparkSession, d: str) -> DataFrame:
    """Payloads by key; a null payload and an unknown key are both misses."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    keys = docs.where("doc_id % 5 = 0").select("doc_id").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("doc_id"))).distinct()
    return keys.join(docs, "doc_id", "left").select("doc_id", F.col("text").isNotNull().alias("hit"), F.length("text").cast("bigint").alias("size"))


@query("select workspace_id, doc_id, row_number() over (partition by workspace_id order by case when n_chars > 0 then source end nulls last, doc_id) as place from documents where workspace_id is not null")
def look_p30_list_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each workspace by path, those without one last; a workspace with a tenth of the rows is no task of its own."""
    rows = table(spark, d, "documents").where("workspace_id is not null").select("workspace_id", "doc_id", F.when(F.col("n_chars") > 0, F.col("source")).alias("path"))
    return ranked(rows, ["workspace_id"], [F.asc_nulls_last("path"), F.asc("doc_id")], "place").select("workspace_id", "doc_id", "place")


@query("with q as (select distinct substr(lower(display_title), 1, 18) as asked from graph_work where display_title is not null and display_title <> ''), t as (select lower(display_title) as t, min(id) as id, count(*) as n from graph_work where display_title is not null group by 1) select q.asked, count(*) as matches, case when count(*) = 1 then min(t.id) when count(*) filter (t.t = q.asked) = 1 then min(t.id) filter (t.t = q.asked) end as id from q join t on starts_with(t.t, q.asked) group by q.asked")
def look_p42_ramp_reference(spark: SparkSession, d: str) -> DataFrame:
    """What beginnings of titles refer to: the only title that starts so, else the only equal one, else none with the number of titles."""
    t = table(spark, d, "graph_work").where("display_title is not null").groupBy(F.lower("display_title").alias("t")).agg(F.min("id").alias("id"))
    asked = t.where("t <> ''").select(F.left("t", F.lit(18)).alias("asked")).distinct()
    # a beginning as long as asked is an equality on the title's own beginning
    found = t.withColumn("asked", F.left("t", F.lit(18))).join(asked, "asked")
    g = found.groupBy("asked").agg(F.count("*").alias("matches"), F.min("id").alias("any"), F.count_if(F.col("t") == F.col("asked")).alias("same"), F.min(F.when(F.col("t") == F.col("asked"), F.col("id"))).alias("equal"))
    return g.select("asked", "matches", F.when(F.col("matches") == 1, F.col("any")).when(F.col("same") == 1, F.col("equal")).alias("id"))


@query("select g.id, g.display_title, g.display_year, i.identifiers from graph_work g left join (select work_id, string_agg(scheme || ':' || coalesce(value_normalized, ''), '|' order by scheme, coalesce(value_normalized, '')) as identifiers from (select distinct work_id, scheme, value_normalized from work_identifier where status = 'active') group by 1) i on i.work_id = g.id")
def look_p44_get_work(spark: SparkSession, d: str) -> DataFrame:
    """A work's page: its fields and its active identifiers."""
    i = table(spark, d, "work_identifier").where("status = 'active' and work_id is not null").select(F.col("work_id").alias("id"), "scheme", F.coalesce("value_normalized", F.lit("")).alias("v")).distinct()
    one = i.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scheme", "v"))), lambda x: F.concat(x["scheme"], F.lit(":"), x["v"])), "|").alias("identifiers"))
    return table(spark, d, "graph_work").select("id", "display_title", "display_year").join(one, "id", "left")


@query("with q as (select id, lower(display_title) as t from graph_work where display_title is not null), a as (select distinct lower(string_split(display_title, ' ')[2]) as asked from graph_work where display_title is not null and string_split(display_title, ' ')[2] <> '') select a.asked, count(*) as works, case when count(*) = 1 then min(q.id) end as id from a join q on contains(q.t, a.asked) group by a.asked")
def look_p46_resolve_paper(spark: SparkSession, d: str) -> DataFrame:
    """Works whose title contains what is asked for: one is the answer, several are none. Both sides meet over the first three characters asked for."""
    g = table(spark, d, "graph_work").where("display_title is not null").select("id", F.lower("display_title").alias("t"))
    asked = g.select(F.get(F.split("t", " "), F.lit(1)).alias("asked")).where("asked <> ''").distinct().withColumn("k", F.left("asked", F.lit(3)))
    pieces = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substr("t", i, n))))
    found = g.where("t <> ''").select("id", "t", F.explode(F.array_distinct(pieces)).alias("k")).join(asked, "k").where(F.contains("t", "asked"))
    return found.groupBy("asked").agg(F.count("*").alias("works"), F.min("id").alias("first")).select("asked", "works", F.when(F.col("works") == 1, F.col("first")).alias("id"))


@query(f"with {WANTED}, m as (select work_id, max(review_state) as mark from field_claim group by 1), t as (select work_id, string_agg(distinct scheme, '|' order by scheme) as tags from work_identifier where status = 'active' group by 1) select w.work_id, m.mark, t.tags from wanted w left join m using (work_id) left join t using (work_id)")
def look_p47_curation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Marks and grouped tags of a list of works."""
    m = table(spark, d, "field_claim").groupBy("work_id").agg(F.max("review_state").alias("mark"))
    t = table(spark, d, "work_identifier").where("status = 'active'").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("scheme")), "|").alias("tags"))
    return wanted(spark, d).join(m, "work_id", "left").join(t, "work_id", "left")


@query("select unnest(ids) as work, unnest(scores) as score from (select list(p_partkey order by p_partkey) as ids, list(p_size % 7 order by p_partkey) as scores from part where p_partkey % 2 = 0) union all select p_partkey, -1 from part where p_partkey % 2 = 1")
def w03_store(spark: SparkSession, d: str) -> DataFrame:
    """A batch as parallel arrays, unzipped and upserted."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("work"), (F.col("p_size") % 7).alias("score"))
    arrays = p.where("work % 2 = 0").groupBy(F.floor(F.col("work") / 500).alias("chunk")).agg(F.collect_list("work").alias("ids"), F.collect_list("score").alias("scores"))
    new = arrays.select(F.inline(F.arrays_zip("ids", "scores"))).toDF("work", "score")
    return C.upsert(p.select("work", F.lit(-1).alias("score")), new, ["work"], ["score"])


@query(f"with {ASSERTIONS}, n as (select citing, cited, case when place > 3 then source end as source from assertions), o as (select distinct citing, cited, source from n where length(cited) % 2 = 0) select citing, cited, source from o union select citing, cited, source from n")
def w08_add_assertion(spark: SparkSession, d: str) -> DataFrame:
    """Edges got or inserted; a null source equals a null source."""
    n = assertions(spark, d).select("citing", "cited", F.when(F.col("place") > 3, F.col("source")).alias("source")).withColumn("one", F.lit(1))
    old = n.where(F.length("cited") % 2 == 0).distinct()
    return C.insert_ignore(old, n, ["citing", "cited", "source"], ["one"]).drop("one")


@query("select entry_id, document_version_id as citing, min(id) as id from citation_mention where entry_id is not null group by 1, 2")
def w09_add_entry_assertion(spark: SparkSession, d: str) -> DataFrame:
    """One edge per entry and citing version; rows without an entry aren't held to be unique."""
    rows = table(spark, d, "citation_mention").where("entry_id is not null").select("entry_id", F.col("document_version_id").alias("citing"), "id")
    return C.insert_ignore(rows.where("false"), rows, ["entry_id", "citing"], ["id"])


@query("with k as (select *, row_number() over (partition by work_id, field, value, origin, extractor, source_record_id, entry_id order by created_at, id) as n from field_claim) select work_id, count(*) filter (n = 1) as inserted, count(*) filter (n > 1) as known from k group by work_id")
def w10_record(spark: SparkSession, d: str) -> DataFrame:
    """A batch of claims recorded once each, by work; nulls compare as equal."""
    keys = ["work_id", "field", "value", "origin", "extractor", "source_record_id", "entry_id"]
    per = table(spark, d, "field_claim").groupBy(*keys).agg(F.count("*").alias("n"))
    return per.groupBy("work_id").agg(F.count("*").alias("inserted"), (F.sum("n") - F.count("*")).alias("known"))


@query("with i as (select distinct id, work_id, scheme, value_normalized as v, created_at from work_identifier where status = 'active' and value_normalized <> '' and scheme is not null) select scheme, v, arg_min(work_id, struct_pack(c := created_at, i := id)) as holder, count(distinct work_id) > 1 as conflict from i where work_id is not null group by scheme, v")
def w36_add_identifier(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers attached to the first work that claims them; later claims by others are conflicts."""
    rows = table(spark, d, "work_identifier").where("status = 'active' and value_normalized <> '' and scheme is not null and work_id is not null").select("scheme", F.col("value_normalized").alias("v"), "work_id", "created_at", "id")
    return rows.groupBy("scheme", "v").agg(F.min_by("work_id", F.struct("created_at", "id")).alias("holder"), (F.count_distinct("work_id") > 1).alias("conflict"))


@query("with w as (select distinct value_normalized as v from work_identifier where scheme = 'doi' and status = 'active' and value_normalized <> ''), a as (select distinct lower(doi) as v from openalex_work where doi is not null) select a.v, w.v is null as created from a left join w on w.v = a.v")
def w35_resolve_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of records that a work holds, and those that a new work is made for, once per identifier."""
    known = table(spark, d, "work_identifier").where("scheme = 'doi' and status = 'active' and value_normalized <> ''").select(F.col("value_normalized").alias("v"), F.lit(True).alias("k")).distinct()
    asked = table(spark, d, "openalex_work").where("doi is not null").select(F.lower("doi").alias("v")).distinct()
    return asked.join(known, "v", "left").select("v", F.col("k").isNull().alias("created"))


@query(f"select id, nullif({key_sql('display_title')}, '') as title_key from graph_work")
def w41_backfill_title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Title keys of all works in one pass."""
    return table(spark, d, "graph_work").select("id", F.nullif(key_of(F.col("display_title")), F.lit("")).alias("title_key"))


CLAIMED = "select id, unnest([struct_pack(field := 'title', value := case when title is not null then to_json(title) end), struct_pack(field := 'year', value := case when y is not null then to_json(y) end), struct_pack(field := 'doi', value := case when doi is not null then to_json(doi) end)]) as c"


@query(f"select openalex_id as id, c.field as field, c.value::varchar as value from ({CLAIMED} from (select openalex_id, openalex_id as id, title, cast(\"year\" as int) as y, doi from openalex_work)) join (select openalex_id from openalex_work) o on o.openalex_id = id where c.value is not null")
def w68_record_publisher_claims(spark: SparkSession, d: str) -> DataFrame:
    """Records as claims, one per known field."""
    return _claims_of(table(spark, d, "openalex_work").select(F.col("openalex_id").alias("id"), "title", F.col("year").cast("int").alias("year"), "doi"))


def _claims_of(rows: DataFrame) -> DataFrame:
    """rows(id, title, year, doi) -> (id, field, value as JSON)."""
    quoted = lambda c: F.when(F.col(c).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"^\{\"x\":(.*)\}$", 1))
    fields = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("title", quoted("title")), ("year", F.col("year").cast("string")), ("doi", quoted("doi")))))
    return rows.select("id", F.explode(fields).alias("c")).select("id", "c.field", "c.value").where("value is not null")


@query("select id, f.field as field, f.conf as confidence from (select id, unnest([struct_pack(field := 'title', v := fields ->> '$.title.value', conf := fields ->> '$.title.confidence'), struct_pack(field := 'year', v := fields ->> '$.year.value', conf := fields ->> '$.year.confidence'), struct_pack(field := 'venue', v := fields ->> '$.venue.value', conf := fields ->> '$.venue.confidence'), struct_pack(field := 'doi', v := fields ->> '$.doi.value', conf := fields ->> '$.doi.confidence'), struct_pack(field := 'author', v := cast(fields -> '$.authors.value' as varchar), conf := fields ->> '$.authors.confidence')]) as f from bibliography_entry) where f.v is not null and f.v <> 'null'")
def w69_record_entry_claims(spark: SparkSession, d: str) -> DataFrame:
    """Up to five claims of every parsed entry, each with its own confidence."""
    get: Column = lambda n, k: F.get_json_object("fields", f"$.{n}.{k}")
    names = [("title", "title"), ("year", "year"), ("venue", "venue"), ("doi", "doi"), ("authors", "author")]
    fields = F.array(*(F.struct(F.lit(f).alias("field"), get(n, "value").alias("v"), get(n, "confidence").alias("confidence")) for n, f in names))
    return table(spark, d, "bibliography_entry").select("id", F.explode(fields).alias("c")).where("c.v is not null").select("id", "c.field", "c.confidence")
