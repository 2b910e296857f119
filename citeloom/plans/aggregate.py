"""Aggregations, audits and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import table
from .catalog import query
from .views import ASSERTIONS, live


@query(f"with {ASSERTIONS} select citing, count(distinct cited) as cited from live group by citing")
def a02_outgoing_counts(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d).groupBy("citing").agg(F.countDistinct("cited").alias("cited"))


@query("select n_name as tag, count(c_custkey) as uses from nation left join customer on c_nationkey = n_nationkey and c_acctbal < 0 group by n_name")
def a04_list_tags(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each tag, unused ones with zero."""
    uses = table(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(uses, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("tag"), F.coalesce("n", F.lit(0)).alias("uses"))


@query("select count(*) as tags from (select distinct lower(p_brand) from part)")
def a05_count_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.countDistinct(F.lower("p_brand")).alias("tags"))


@query("select event_type as stage, count(*) as calls, cast(sum(cast(props ->> '$.k' as bigint)) as bigint) as tokens, round(sum(value), 4) as cost from events group by event_type")
def a06_stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("tokens"), F.round(F.sum("value"), 4).alias("cost"))


@query("select round(sum(value), 4) as cost from events")
def a07_read_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.round(F.sum("value"), 4).alias("cost"))


PAGES = "select r.paper_id, p.page_number, p.provenance, p.confidence, p.text_end - p.text_start as size, p.text_start, p.text_end from reading_index r, unnest(r.pages) as u(p)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reading_index").select("paper_id", F.explode("pages").alias("p")).select("paper_id", "p.page_number", "p.provenance", "p.confidence", (F.col("p.text_end") - F.col("p.text_start")).alias("size"), "p.text_start", "p.text_end")


@query("select paper_id, page, count(*) as tokens from reading_token group by paper_id, page")
def a09_tokens_per_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reading_token").groupBy("paper_id", "page").agg(F.count("*").alias("tokens"))


PARAGRAPHS = r"select r.paper_id, u.p as par from reading_index r, unnest(string_split_regex(r.text, '\n[ \t]*\n')) as u(p) where r.text is not null"


@query("with g as (select r.paper_id, case when p.provenance = 'unavailable' then 'unavailable' when p.confidence is null and p.provenance = 'ocr' then 'unknown confidence' end as reason from reading_index r, unnest(r.pages) as u(p)) select reason, count(*) as pages from g where reason is not null group by reason")
def a13_count_gaps(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("provenance") == "unavailable", "unavailable").when(F.col("confidence").isNull() & (F.col("provenance") == "ocr"), "unknown confidence").alias("reason")
    return pages(spark, d).select(reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("pages"))


@query("select user_id as job, max(case event_type when 'error' then 3 when 'purchase' then 2 when 'signup' then 1 else 0 end) as severity from events group by user_id")
def a14_worst_severity(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max(rank).alias("severity"))


@query("select work_id, coalesce(min(try_cast(value as int)) filter (where origin = 'publisher'), min(try_cast(value as int))) as year from field_claim where field = 'year' and retracted_at is null and review_state <> 'rejected' group by work_id")
def a15_recompute_year(spark: SparkSession, d: str) -> DataFrame:
    """The least published year, else the least of any."""
    y = F.col("value").try_cast("int")
    rows = table(spark, d, "field_claim").where("field = 'year' and retracted_at is null and review_state <> 'rejected'")
    return rows.groupBy("work_id").agg(F.coalesce(F.min(F.when(F.col("origin") == "publisher", y)), F.min(y)).alias("year"))


@query("select case when entry_id is null then 'missing' when position(marker_text in passage) > 0 then 'verbatim' else 'near' end as verdict, count(*) as mentions from citation_mention where marker_text is not null and passage is not null group by 1")
def a16_check(spark: SparkSession, d: str) -> DataFrame:
    """How many markers stand in their passage word for word."""
    verdict = F.when(F.col("entry_id").isNull(), "missing").when(F.instr("passage", F.col("marker_text")) > 0, "verbatim").otherwise("near").alias("verdict")
    return table(spark, d, "citation_mention").where("marker_text is not null and passage is not null").groupBy(verdict).agg(F.count("*").alias("mentions"))


@query("select coalesce(style, 'unknown') as method, count(*) as mentions, count(entry_id) as resolved from citation_mention group by 1")
def a17_count_resolution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_mention").groupBy(F.coalesce("style", F.lit("unknown")).alias("method")).agg(F.count("*").alias("mentions"), F.count("entry_id").alias("resolved"))


@query("with s as (select confidence, count(*) as n, count(*) filter (where review_state = 'accepted') as k from field_claim group by confidence) select confidence, n, k, round((k / n + 1.9208 / n - 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 6) as low, round((k / n + 1.9208 / n + 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 6) as high from s")
def a19_wilson(spark: SparkSession, d: str) -> DataFrame:
    """Share of accepted claims per confidence with its 95 % Wilson interval."""
    s = table(spark, d, "field_claim").groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(F.col("review_state") == "accepted").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return s.select("confidence", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("with x as (select work_id, field, bool_or(review_state = 'accepted') as truth, bool_or(origin in ('openalex','publisher')) as guess from field_claim group by all), s as (select field, count(*) filter (where truth and guess) as hit, count(*) filter (where guess) as guessed, count(*) filter (where truth) as true_ from x group by field) select field, hit, round(case when guessed > 0 then hit / guessed when true_ = 0 then 1.0 else 0.0 end, 6) as precision_, round(case when true_ > 0 then hit / true_ else 1.0 end, 6) as recall from s")
def a22_score_objects(spark: SparkSession, d: str) -> DataFrame:
    """Set precision and recall per kind; without predictions precision is 1 only if there is no truth."""
    x = table(spark, d, "field_claim").groupBy("work_id", "field").agg(F.bool_or(F.col("review_state") == "accepted").alias("truth"), F.bool_or(F.col("origin").isin("openalex", "publisher")).alias("guess"))
    return metrics.precision_recall(x, "field", F.col("truth"), F.col("guess"))


IOU = "greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) / (greatest(a.hi, b.hi) - least(a.lo, b.lo) + 1)"


@query(f"with p as ({PAGES}), a as (select paper_id, page_number, text_start as lo, text_end - 1 as hi from p where text_end > text_start), b as (select paper_id, text_start + 20 as lo, text_end + 19 as hi from p where text_end > text_start) select a.paper_id, round(avg(m), 6) as mean_iou from (select a.paper_id, a.page_number, max(case when least(a.hi, b.hi) < greatest(a.lo, b.lo) then 0 else {IOU} end) as m from a join b on a.paper_id = b.paper_id group by all) a group by a.paper_id")
def a23_score_sections(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the best overlap of each true interval with any predicted one of its paper."""
    p = pages(spark, d).where("text_end > text_start")
    a = p.select("paper_id", "page_number", F.col("text_start").alias("lo"), (F.col("text_end") - 1).alias("hi"))
    b = p.select("paper_id", (F.col("text_start") + 20).alias("blo"), (F.col("text_end") + 19).alias("bhi"))
    best = a.join(b, "paper_id").groupBy("paper_id", "page_number").agg(F.max(metrics.interval_iou("lo", "hi", "blo", "bhi")).alias("m"))
    return best.groupBy("paper_id").agg(F.round(F.avg("m"), 6).alias("mean_iou"))


@query("with t as (select event_type as stage, sum(value) as v from events group by event_type) select stage, round(v / (select sum(v) from t), 6) as share from t")
def a25_reasoning_profile(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("v"))
    total = t.agg(F.sum("v").alias("all"))
    return t.crossJoin(F.broadcast(total)).select("stage", F.round(F.col("v") / F.col("all"), 6).alias("share"))


@query("select l_suppkey as page, list_sort(list(l_quantity))[count(*) // 2 + 1] as height from lineitem group by l_suppkey")
def a26_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """Element n // 2 of the sorted heights: the upper median, found from the counts of equal heights."""
    return metrics.upper_median(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").select(F.col("l_suppkey").alias("page"), F.col("median").alias("height"))
