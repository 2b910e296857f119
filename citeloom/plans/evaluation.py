"""Evaluation of runs, job folds, and the rest of the rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..operators import metrics
from ..operators.topk import ranked
from ..session import table
from .catalog import query
from .views import WORKS, works

#: Requests of a host that one task orders.
RUN = 100_000
# A run's papers: what an event says of its user.
PAPERS = "papers as (select user_id as paper, count(*) as calls, count(*) filter (event_type = 'error') as errors, sum(value) as cost, count(*) filter (event_type = 'purchase') as hits, count(*) filter (event_type in ('purchase', 'click')) as guessed, count(*) filter (event_type in ('purchase', 'signup')) as truth from events group by user_id)"


def papers(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("paper")).agg(
        F.count("*").alias("calls"), F.count_if(e == "error").alias("errors"), F.sum("value").alias("cost"), F.count_if(e == "purchase").alias("hits"), F.count_if(e.isin("purchase", "click")).alias("guessed"), F.count_if(e.isin("purchase", "signup")).alias("truth"),
    )


@query(f"with {PAPERS} select count(*) as papers, round(avg(case when errors > 0 then 1.0 else 0.0 end), 6) as failed_rate, round(avg(cost), 4) as mean_cost, round(sum(hits) / sum(guessed), 6) as micro_precision, round(sum(hits) / sum(truth), 6) as micro_recall, round(avg(case when guessed > 0 then hits / guessed end), 6) as macro_precision, round(sum(errors) / sum(calls), 6) as error_rate from papers")
def a18_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A run in one row: rates, means, micro and macro precision, recall."""
    s = lambda a, b: F.round(F.sum(a) / F.sum(b), 6)
    return papers(spark, d).agg(
        F.count("*").alias("papers"), F.round(F.avg((F.col("errors") > 0).cast("double")), 6).alias("failed_rate"), F.round(F.avg("cost"), 4).alias("mean_cost"), s("hits", "guessed").alias("micro_precision"), s("hits", "truth").alias("micro_recall"),
        F.round(F.avg(F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed"))), 6).alias("macro_precision"), s("errors", "calls").alias("error_rate"),
    )


@query(f"with {PAPERS}, r as (select *, hits / nullif(guessed, 0) as p from papers) select paper, round(p, 6) as p, row_number() over (order by p nulls first, errors desc, paper) as place from r where errors > 0 or coalesce(p, 0) < 0.5")
def a21_worst_case(spark: SparkSession, d: str) -> DataFrame:
    """All failing papers, worst first."""
    r = papers(spark, d).withColumn("p", F.col("hits") / F.nullif("guessed", F.lit(0).cast("bigint"))).where((F.col("errors") > 0) | (F.coalesce("p", F.lit(0.0)) < 0.5))
    return ranked(r, [], [F.asc_nulls_first("p"), F.desc("errors"), F.asc("paper")], "place").select("paper", F.round("p", 6).alias("p"), "place")


PAGE = "select r.paper_id, u.p.text_start as lo, u.p.text_end as hi, length(r.text) as n from reading_index r, unnest(r.pages) as u(p) where r.text is not null"


@query(f"select paper_id, round(sum(greatest(hi - lo, 0)) / max(n), 6) as coverage, count(*) filter (hi - lo between 0 and 199) as short, count(*) filter (hi - lo > 3000) as long, count(*) filter (hi < lo or lo < 0 or hi > n) as malformed from ({PAGE}) where n > 0 group by paper_id")
def a24_score_sections(spark: SparkSession, d: str) -> DataFrame:
    """How much of each text its sections cover, and how many are short, long or impossible."""
    rows = table(spark, d, "reading_index").where("text is not null and text <> ''").select("paper_id", F.length("text").alias("n"), F.explode("pages").alias("p")).select("paper_id", "n", F.col("p.text_start").alias("lo"), F.col("p.text_end").alias("hi"))
    size = F.col("hi") - F.col("lo")
    return rows.groupBy("paper_id").agg(F.round(F.sum(F.greatest(size, F.lit(0))) / F.max("n"), 6).alias("coverage"), F.count_if(size.between(0, 199)).alias("short"), F.count_if(size > 3000).alias("long"), F.count_if((size < 0) | (F.col("lo") < 0) | (F.col("hi") > F.col("n"))).alias("malformed"))


@query("with m as (select event_type as stage, median(value * 100) as mid from events group by event_type) select e.event_id, e.value * 100 >= greatest(8000, 2 * m.mid) as confused from events e join m on m.stage = e.event_type")
def a20_mark_confused(spark: SparkSession, d: str) -> DataFrame:
    """Calls of at least 8,000 tokens that are twice their stage's median; the medians are one row per stage."""
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("value") * 100).alias("tokens"))
    mid = e.groupBy("event_type").agg(F.median("tokens").alias("mid"))
    return e.join(mid, "event_type").select("event_id", (F.col("tokens") >= F.greatest(F.lit(8000.0), 2 * F.col("mid"))).alias("confused"))


@query(f"""with {WORKS}, y as (select year, count(*) as n from works where year is not null group by year), g as (select year, n, lead(year) over (order by year) as nxt from y),
 slots as (select year as lo, year as hi, n from g union all select s.v, s.v, 0 from g, unnest(range(year + 1, nxt)) as s(v) where nxt - year - 1 between 1 and 3 union all select year + 1, nxt - 1, 0 from g where nxt - year - 1 > 3 union all select null, null, count(*) from works where year is null having count(*) > 0),
 thin as (select case when year % 9 <> 0 and year % 10 < 7 then year end as year from works), y2 as (select year, count(*) as n from thin where year is not null group by year), g2 as (select year, n, lead(year) over (order by year) as nxt from y2),
 slots2 as (select year as lo, year as hi, n from g2 union all select s.v, s.v, 0 from g2, unnest(range(year + 1, nxt)) as s(v) where nxt - year - 1 between 1 and 3 union all select year + 1, nxt - 1, 0 from g2 where nxt - year - 1 > 3 union all select null, null, count(*) from thin where year is null having count(*) > 0)
 select 'all' as lane, lo, hi, n from slots union all select 'thinned' as lane, lo, hi, n from slots2""")
def a27_histogram_grid(spark: SparkSession, d: str) -> DataFrame:
    """Slots by year with the unknown lane, of all works and of works whose years have gaps of one to four."""
    w = works(spark, d)

    def slots(rows: DataFrame, lane: str) -> DataFrame:
        unknown = rows.where("year is null").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), "n")
        return metrics.histogram_slots(rows, "year").unionByName(unknown).withColumn("lane", F.lit(lane))

    thin = w.withColumn("year", F.when((F.col("year") % 9 != 0) & (F.col("year") % 10 < 7), F.col("year")))
    return slots(w, "all").unionByName(slots(thin, "thinned")).select("lane", "lo", "hi", "n")


@query("select user_id as job, arg_max(case event_type when 'signup' then 'queued' when 'click' then 'running' when 'view' then 'running' when 'purchase' then 'completed' else 'failed' end, struct_pack(a := ts, b := event_id)) as state, count(*) filter (event_type = 'purchase') as completed, count(*) filter (event_type = 'error') as failed, arg_max(event_id, struct_pack(a := ts, b := event_id)) as last_event from events group by user_id")
def t04_job_states(spark: SparkSession, d: str) -> DataFrame:
    """Jobs folded from their events: the last state, tasks completed and failed. The fold is an aggregate, so it combines before the shuffle."""
    e = F.col("event_type")
    state = F.when(e == "signup", "queued").when(e.isin("click", "view"), "running").when(e == "purchase", "completed").otherwise("failed")
    last = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by(state, last).alias("state"), F.count_if(e == "purchase").alias("completed"), F.count_if(e == "error").alias("failed"), F.max_by("event_id", last).alias("last_event"))


@query("with o as (select event_id, user_id % 10 as host, ts, row_number() over (partition by user_id % 10 order by ts, event_id) as n from events), b as (select *, max(epoch_us(ts) - (n - 1) * 2000000) over (partition by host order by n) as base from o) select event_id, cast(base + (n - 1) * 2000000 - epoch_us(ts) as bigint) as delay from b")
def t09_throttle_delay(spark: SparkSession, d: str) -> DataFrame:
    """How long each request waits so that those of one host are two seconds apart: the running maximum of arrival less place.

    The maximum runs within runs of RUN requests and over the runs' own maxima, so no task holds a host.
    """
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "ts")
    o = ranked(rows, ["host"], ["ts", "event_id"], "n").withColumn("v", F.col("t") - (F.col("n") - 1) * 2_000_000).withColumn("run", F.floor(F.col("n") / RUN))
    top = o.groupBy("host", "run").agg(F.max("v").alias("m"))
    before = top.select("host", "run", F.max("m").over(Window.partitionBy("host").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("v").over(Window.partitionBy("host", "run").orderBy("n"))
    both = o.withColumn("own", own).join(before, ["host", "run"])
    return both.select("event_id", (F.greatest("own", "before") - F.col("v")).cast("bigint").alias("delay"))


@query("with a as (select sha256(text) as key, min(doc_id) as first, count(*) as n from documents where text is not null group by 1) select d.doc_id, case when a.first = d.doc_id then 'asked' else 'saved' end as answer from documents d join a on a.key = sha256(d.text)")
def t14_load(spark: SparkSession, d: str) -> DataFrame:
    """Answers saved by content hash: the first document of a text is asked, its copies are read from the store."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "key").select("doc_id", F.when(F.col("first") == F.col("doc_id"), "asked").otherwise("saved").alias("answer"))


@query(f"with {WORKS}, r as (select id, kind, row_number() over (partition by kind order by year nulls last, lower(title), id) - 1 as n from works) select id, cast(n // 36 as int) as ring, cast(n % 36 as int) as place from r")
def k26_layout_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Rings of works by year, title and id."""
    rows = works(spark, d).withColumn("key", F.lower("title"))
    r = ranked(rows, ["kind"], [F.asc_nulls_last("year"), F.asc("key"), F.asc("id")]).withColumn("n", F.col("rank") - 1)
    return r.select("id", F.floor(F.col("n") / 36).cast("int").alias("ring"), (F.col("n") % 36).cast("int").alias("place"))


SECTIONS = "select r.paper_id, u.p.page_number as n, u.p.text_start as lo, u.p.text_end + case when u.p.page_number % 3 = 0 then 25 else 0 end as hi from reading_index r, unnest(r.pages) as u(p)"


@query(f"with s as ({SECTIONS}), x as (select *, lead(lo) over (partition by paper_id order by n) as nxt from s) select paper_id, n, lo, case when nxt is not null and hi > nxt then nxt else hi end as hi, nxt is not null and hi > nxt as clipped, nxt is null or lo <= nxt as ordered from x")
def k28_repair_section_order(spark: SparkSession, d: str) -> DataFrame:
    """Sections that reach past the start of the next are clipped to it; whether they stand in order is told."""
    rows = table(spark, d, "reading_index").select("paper_id", F.explode("pages").alias("p")).select("paper_id", F.col("p.page_number").alias("n"), F.col("p.text_start").alias("lo"), (F.col("p.text_end") + F.when(F.col("p.page_number") % 3 == 0, 25).otherwise(0)).alias("hi"))
    at = ranked(rows, ["paper_id"], ["n"], "i")
    nxt = at.select("paper_id", (F.col("i") - 1).alias("i"), F.col("lo").alias("nxt"))
    both = at.join(nxt, ["paper_id", "i"], "left")
    over = F.coalesce(F.col("hi") > F.col("nxt"), F.lit(False))
    return both.select("paper_id", "n", "lo", F.when(over, F.col("nxt")).otherwise(F.col("hi")).alias("hi"), over.alias("clipped"), F.coalesce(F.col("lo") <= F.col("nxt"), F.lit(True)).alias("ordered"))


@query("select document_version_id, page, arg_max(id, struct_pack(n := marker_end - marker_start, p := -marker_start, i := id)) as id from citation_mention where marker_start is not null and marker_end is not null group by 1, 2")
def k23_better(spark: SparkSession, d: str) -> DataFrame:
    """The longest marker of each page, the first of equals."""
    rows = table(spark, d, "citation_mention").where("marker_start is not null and marker_end is not null")
    order = F.struct((F.col("marker_end") - F.col("marker_start")).alias("n"), (-F.col("marker_start")).alias("p"), F.col("id").alias("i"))
    return rows.groupBy("document_version_id", "page").agg(F.max_by("id", order).alias("id"))


PICKED = "select p_partkey as id, p_partkey % 9 as pick, ['https://x.org/a', 'https://x.org/b', 'https://x.org/' || p_size] as links from part"


@query(f"select id, case when pick < 3 then links[pick + 1] end as url, case when pick >= 3 then 'index ' || pick || ' is out of range' end as error from ({PICKED})")
def m40_ground_pick(spark: SparkSession, d: str) -> DataFrame:
    """A picked index of a list of links, or why it is none."""
    k = F.col("p_partkey")
    links = F.array(F.lit("https://x.org/a"), F.lit("https://x.org/b"), F.concat(F.lit("https://x.org/"), F.col("p_size").cast("string")))
    pick = (k % 9).cast("int")
    url: Column = L.http(F.get(links, pick))
    return table(spark, d, "part").select(k.alias("id"), url.alias("url"), F.when(url.isNull(), F.concat(F.lit("index "), pick.cast("string"), F.lit(" is out of range"))).alias("error"))


@query("select c_custkey as ramp, count(o_orderkey) as items, count(o_orderkey) filter (o_orderstatus = 'F') as done, count(o_orderkey) filter (o_orderstatus = 'O') as open, count(o_orderkey) filter (o_orderstatus = 'P') as skipped, row_number() over (order by max(o_orderdate) desc nulls last, c_custkey) as place from customer left join orders on o_custkey = c_custkey group by c_custkey")
def a03_ramp_list(spark: SparkSession, d: str) -> DataFrame:
    """Lists with how many items they have in all and by state, empty ones too, the last changed first."""
    n = lambda s, a: F.count_if(F.col("o_orderstatus") == s).alias(a)
    items = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("items"), n("F", "done"), n("O", "open"), n("P", "skipped"), F.max("o_orderdate").alias("changed"))
    rows = table(spark, d, "customer").join(items, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "done", "open", "skipped")]
    return ranked(rows.select(F.col("c_custkey").alias("ramp"), *zero, "changed"), [], [F.desc_nulls_last("changed"), F.asc("ramp")], "place").drop("changed")
