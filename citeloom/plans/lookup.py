"""Point lookups, filters and projections, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .catalog import query
from .views import DOCUMENTS_OF, documents_of


@query("select g.id, g.display_title from graph_work g where g.id in (select work_id from field_claim where origin = 'user')")
def look_p02_get_many(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "field_claim").where("origin = 'user'").select(F.col("work_id").alias("id"))
    return table(spark, d, "graph_work").select("id", "display_title").join(ids, "id", "left_semi")


@query("select distinct i.scheme, i.value_normalized as value, g.id, g.display_title from work_identifier i join graph_work g on g.id = i.work_id where i.status = 'active' and i.scheme in ('openalex', 'doi', 'isbn')")
def look_p03_find_by_identifier(spark: SparkSession, d: str) -> DataFrame:
    """Active work-level identifiers with their works."""
    i = table(spark, d, "work_identifier").where("status = 'active' and scheme in ('openalex', 'doi', 'isbn')").select("scheme", F.col("value_normalized").alias("value"), F.col("work_id").alias("id"))
    return i.join(table(spark, d, "graph_work").select("id", "display_title"), "id").select("scheme", "value", "id", "display_title").distinct()


@query("select work_id, min(value_normalized) as openalex_id from work_identifier where scheme = 'openalex' and status = 'active' and work_id is not null group by work_id")
def look_p09_openalex_ids_for(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "work_identifier").where("scheme = 'openalex' and status = 'active' and work_id is not null").groupBy("work_id").agg(F.min("value_normalized").alias("openalex_id"))


@query("select distinct work_id, true as has_claim from field_claim where review_state <> 'rejected' and retracted_at is null")
def look_p25_has_current_claim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "field_claim").where("review_state <> 'rejected' and retracted_at is null").select("work_id", F.lit(True).alias("has_claim")).distinct()


@query("select sha256(text) as sha, min(doc_id) as doc_id, count(*) as copies from documents where text is not null and text <> '' group by 1")
def look_p34_present_document_for_sha(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content hash."""
    return table(spark, d, "documents").where("text is not null and text <> ''").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"with {DOCUMENTS_OF} select 'P' || p_partkey as work, coalesce(x.state, 'missing') as presence from part left join documents_of x on x.work = 'P' || p_partkey")
def look_p35_document_presence(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("work"))
    return w.join(documents_of(spark, d), "work", "left").select("work", F.coalesce("state", F.lit("missing")).alias("presence"))


@query("select p_name as work, string_agg(distinct p_brand, ',' order by p_brand) as tags from part group by p_name")
def look_p38_tags_for_works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("work")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("tags"))


@query("select id, nullif(trim(fields ->> '$.title.value'), '') as title, nullif(trim(fields ->> '$.venue.value'), '') as venue from bibliography_entry")
def look_p50_text(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty string fields of a JSON object."""
    field = lambda n: F.nullif(F.trim(F.get_json_object("fields", f"$.{n}.value")), F.lit("")).alias(n)
    return table(spark, d, "bibliography_entry").select("id", field("title"), field("venue"))
