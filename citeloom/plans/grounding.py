"""Whether what was read stands in the text, and what stands where: quotes, values, captions, labels, lists of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .catalog import query

LEAST = 8


def occurrences(needle: Column, hay: Column) -> Column:
    """How often a non-empty needle stands in hay, counted without overlap."""
    return ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("bigint")


def bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


_TITLE = "fields ->> '$.title.value'"
_BARE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"with e as (select id, raw_text as h, {_TITLE} as t, {_BARE.format('raw_text')} as bh, {_BARE.format(_TITLE)} as bt from bibliography_entry where {_TITLE} is not null and raw_text is not null), n as (select id, length(bt) as size, case when t <> '' then (length(h) - length(replace(h, t, ''))) // length(t) else 0 end as exact, case when bt <> '' then (length(bh) - length(replace(bh, bt, ''))) // length(bt) else 0 end as loose from e) select id, case when size < {LEAST} then 'missing' when exact = 1 then 'exact' when exact > 1 then 'ambiguous' when loose = 1 then 'normalized' when loose > 1 then 'ambiguous' else 'missing' end as verdict from n")
def m29_verify_quote(spark: SparkSession, d: str) -> DataFrame:
    """Whether a parsed title stands in its entry: as it is, by its letters and digits alone, several times, or not; too short ones count as missing."""
    t = F.get_json_object("fields", "$.title.value")
    rows = table(spark, d, "bibliography_entry").select("id", F.col("raw_text").alias("h"), t.alias("t")).where("t is not null and h is not null").withColumn("bh", bare(F.col("h"))).withColumn("bt", bare(F.col("t")))
    count = lambda n, h: F.when(F.col(n) != "", occurrences(F.col(n), F.col(h))).otherwise(0)
    n = rows.select("id", F.length("bt").alias("size"), count("t", "h").alias("exact"), count("bt", "bh").alias("loose"))
    verdict = F.when(F.col("size") < LEAST, "missing").when(F.col("exact") == 1, "exact").when(F.col("exact") > 1, "ambiguous").when(F.col("loose") == 1, "normalized").when(F.col("loose") > 1, "ambiguous").otherwise("missing")
    return n.select("id", verdict.alias("verdict"))


@query("with m as (select id, string_split(passage, marker_text) as parts, length(marker_text) as n from citation_mention where passage is not null and marker_text <> '' and contains(passage, marker_text)) select id, k.i as nth, cast(list_sum(list_transform(parts[1:k.i], lambda x: length(x))) + n * (k.i - 1) as bigint) as place from m, lateral (select unnest(range(1, len(parts))) as i) k")
def m30_page_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every place where a marker stands in its passage."""
    rows = table(spark, d, "citation_mention").where("passage is not null and marker_text <> ''").where(F.contains("passage", "marker_text"))
    parts = rows.select("id", F.expr("split(passage, concat('\\\\Q', marker_text, '\\\\E'))").alias("parts"), F.length("marker_text").alias("n"))
    at = parts.select("id", "n", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("nth"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("nth")), F.lit(0), lambda a, x: a + F.length(x))
    return at.select("id", F.col("nth").cast("bigint").alias("nth"), (before + F.col("n") * (F.col("nth") - 1)).cast("bigint").alias("place"))


_NAMES = "cast(fields -> '$.authors.value' as varchar[])"


@query(f"with e as (select id, raw_text as h, {_TITLE} as t, fields ->> '$.year.value' as y, {_NAMES} as names from bibliography_entry where raw_text is not null) select id, case when contains(h, t) then t end as title, case when contains(h, y) then y end as year, case when len(names) > 0 and list_bool_and(list_transform(names, lambda x: contains(h, x))) then array_to_string(names, '|') end as authors from e")
def m33_ground_field_draft(spark: SparkSession, d: str) -> DataFrame:
    """Drafted values that stand in the entry word for word; one missing author drops the list."""
    get = lambda n: F.get_json_object("fields", f"$.{n}.value")
    rows = table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", F.col("raw_text").alias("h"), get("title").alias("t"), get("year").alias("y"), F.from_json(get("authors"), "array<string>").alias("names"))
    kept = lambda c: F.when(F.contains("h", c), F.col(c))
    every = (F.size("names") > 0) & F.forall("names", lambda x: F.contains(F.col("h"), x))
    return rows.select("id", kept("t").alias("title"), kept("y").alias("year"), F.when(every, F.array_join("names", "|")).alias("authors"))


@query(f"select id, list_bool_and(list_transform({_NAMES}, lambda x: contains(trim(x), ' ') and contains(lower(raw_text), lower(x)))) as confirmed from bibliography_entry where raw_text is not null and len({_NAMES}) > 0")
def m36_confirmed_authors(spark: SparkSession, d: str) -> DataFrame:
    """Whether all authors have two words or more and stand in the text."""
    names = F.from_json(F.get_json_object("fields", "$.authors.value"), "array<string>")
    rows = table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", F.lower("raw_text").alias("h"), names.alias("names")).where("size(names) > 0")
    return rows.select("id", F.forall("names", lambda x: F.contains(F.trim(x), F.lit(" ")) & F.contains(F.col("h"), F.lower(x))).alias("confirmed"))


@query(f"with e as (select id, {_BARE.format('raw_text')} as h, {_BARE.format('display_title')} as t from (select b.id, b.raw_text, g.display_title from bibliography_entry b join field_claim c on c.entry_id = b.id join graph_work g on g.id = c.work_id where b.raw_text is not null and g.display_title is not null)) select distinct id, t, instr(h, t) - 1 as place from e where length(t) >= {LEAST} and (length(h) - length(replace(h, t, ''))) // length(t) = 1")
def m37_unique(spark: SparkSession, d: str) -> DataFrame:
    """Where a work's folded title stands in a folded entry, if it does exactly once and isn't too short."""
    b = table(spark, d, "bibliography_entry").where("raw_text is not null").select(F.col("id").alias("entry_id"), bare(F.col("raw_text")).alias("h"))
    g = table(spark, d, "graph_work").where("display_title is not null").select(F.col("id").alias("work_id"), bare(F.col("display_title")).alias("t"))
    rows = table(spark, d, "field_claim").select("entry_id", "work_id").distinct().join(b, "entry_id").join(g, "work_id").where(F.length("t") >= LEAST)
    return rows.where(occurrences(F.col("t"), F.col("h")) == 1).select(F.col("entry_id").alias("id"), "t", (F.instr("h", F.col("t")) - 1).cast("bigint").alias("place")).distinct()


@query("with weak as (select id, left(raw_text, 600) as txt from bibliography_entry where raw_text is not null and (coalesce(fields ->> '$.authors.confidence', 'missing') <> 'explicit' or coalesce(fields ->> '$.year.confidence', 'missing') <> 'explicit')), held as (select entry_id from field_claim where entry_id is not null and origin in ('user', 'publisher', 'paper') group by 1) select weak.id, sha256('v1|' || txt) as key from weak where id not in (select entry_id from held)")
def m44_harvest_bibliography_fields(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose authors or year are weak and whose work no better origin claims, with the key their answer is cached under."""
    weak = lambda n: F.coalesce(F.get_json_object("fields", f"$.{n}.confidence"), F.lit("missing")) != "explicit"
    rows = table(spark, d, "bibliography_entry").where("raw_text is not null").where(weak("authors") | weak("year"))
    held = table(spark, d, "field_claim").where("entry_id is not null and origin in ('user', 'publisher', 'paper')").select(F.col("entry_id").alias("id")).distinct()
    return rows.join(held, "id", "left_anti").select("id", F.sha2(F.concat(F.lit("v1|"), F.left("raw_text", F.lit(600))), 256).alias("key"))


@query("select paper_id, substr(t, 1, 20000) as front from (select r.paper_id, case when regexp_matches(x.t, '(?i)\\n(references|bibliography)[ \\t]*\\n') then substr(x.t, 1, length(regexp_extract(x.t, '(?is)^(.*?)\\n(?:references|bibliography)[ \\t]*\\n', 1))) else x.t end as t from reading_index r join (select paper_id, substr(text, 1, greatest(coalesce(pages[1].text_end, 0), coalesce(pages[2].text_end, 0))) as t from reading_index where text is not null) x using (paper_id))")
def f09_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages up to a references heading, 20,000 characters at most (the operator's own limit)."""
    end = F.greatest(F.coalesce(F.get("pages", F.lit(0))["text_end"], F.lit(0)), F.coalesce(F.get("pages", F.lit(1))["text_end"], F.lit(0)))
    rows = table(spark, d, "reading_index").where("text is not null").select("paper_id", F.left("text", end).alias("t"))
    head = F.regexp_extract("t", r"(?is)^(.*?)\n(?:references|bibliography)[ \t]*\n", 1)
    cut = F.when(F.col("t").rlike(r"(?i)\n(references|bibliography)[ \t]*\n"), head).otherwise(F.col("t"))
    return rows.select("paper_id", F.left(cut, F.lit(20000)).alias("front"))


@query("select query_id, 'title.search:' || array_to_string(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]{2,}'), ' ') || coalesce(',publication_year:' || (\"year\" - 1) || '-' || (\"year\" + 1), '') as search from title_query where title is not null")
def f44_title_search_url(spark: SparkSession, d: str) -> DataFrame:
    """A search for the words of a title within a year of it."""
    words = F.array_join(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1)), " ")
    y = F.col("year")
    return table(spark, d, "title_query").where("title is not null").select("query_id", F.concat(F.lit("title.search:"), words, F.coalesce(F.concat(F.lit(",publication_year:"), (y - 1).cast("string"), F.lit("-"), (y + 1).cast("string")), F.lit(""))).alias("search"))


LINES = "select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line, unnest(string_split(text, chr(10))) as x from documents where text is not null"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("line", (F.col("line") + 1).cast("bigint"))


@query(rf"with l as ({LINES}), h as (select doc_id, min(line) as at_line from l where lower(trim(x)) in ('references', 'bibliography', 'index', 'contents') group by 1) select l.doc_id, l.line - h.at_line as place, regexp_extract(x, '^\[([0-9]+)\]', 1) as key, length(x) as chars from l join h using (doc_id) where l.line > h.at_line and regexp_matches(x, '^\[[0-9]+\] ')")
def f84_extract_entries(spark: SparkSession, d: str) -> DataFrame:
    """Numbered entries of the list behind each document's first such heading."""
    lines = _lines(spark, d)
    heads = lines.where(F.lower(F.trim("x")).isin("references", "bibliography", "index", "contents")).groupBy("doc_id").agg(F.min("line").alias("at"))
    rows = lines.where(F.col("x").rlike(r"^\[[0-9]+\] ")).join(heads, "doc_id").where("line > at")
    return rows.select("doc_id", (F.col("line") - F.col("at")).alias("place"), F.regexp_extract("x", r"^\[([0-9]+)\]", 1).alias("key"), F.length("x").cast("bigint").alias("chars"))


@query(rf"select doc_id, regexp_extract(x, '\(([A-Z]?[0-9]{{1,3}}(?:\.[0-9]{{1,3}})?[a-z]?)\)$', 1) as label, count(*) as lines from ({LINES}) where regexp_matches(x, '\([A-Z]?[0-9]{{1,3}}(\.[0-9]{{1,3}})?[a-z]?\)$') group by 1, 2")
def f110_equation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels at the ends of lines."""
    pattern = r"\(([A-Z]?[0-9]{1,3}(?:\.[0-9]{1,3})?[a-z]?)\)\z"
    return _lines(spark, d).where(F.col("x").rlike(pattern)).groupBy("doc_id", F.regexp_extract("x", pattern, 1).alias("label")).agg(F.count("*").alias("lines"))


@query(r"select m.id, regexp_extract(passage, '(?i)\b(fig(?:ure|s)?|tab(?:le)?|eq)\.? ?(S?[0-9]{1,4})\b', 1) as kind, regexp_extract(passage, '(?i)\b(fig(?:ure|s)?|tab(?:le)?|eq)\.? ?(S?[0-9]{1,4})\b', 2) as number from citation_mention m where regexp_matches(passage, '(?i)\b(fig(?:ure|s)?|tab(?:le)?|eq)\.? ?(S?[0-9]{1,4})\b')")
def f80_find(spark: SparkSession, d: str) -> DataFrame:
    """The first figure, table or equation that a passage names."""
    pattern = r"(?i)\b(fig(?:ure|s)?|tab(?:le)?|eq)\.? ?(S?[0-9]{1,4})\b"
    return table(spark, d, "citation_mention").where(F.col("passage").rlike(pattern)).select("id", F.regexp_extract("passage", pattern, 1).alias("kind"), F.regexp_extract("passage", pattern, 2).alias("number"))


@query("select r.paper_id, 'page' as kind, u.p.text_start as start, u.p.text_end as finish, sha256(substr(r.text, u.p.text_start + 1, u.p.text_end - u.p.text_start)) as hash from reading_index r, unnest(r.pages) as u(p) where r.text is not null union all select r.paper_id, 'sentence', s.s.range_start, s.s.range_end, sha256(substr(r.text, s.s.range_start + 1, s.s.range_end - s.s.range_start)) from reading_index r, unnest(r.sentence) as s(s) where r.text is not null")
def j23_source_text_from_index(spark: SparkSession, d: str) -> DataFrame:
    """The nested index as flat spans of pages and sentences, with a hash of their text."""
    rows = table(spark, d, "reading_index").where("text is not null")

    def flat(column: str, kind: str, a: str, b: str) -> DataFrame:
        s = rows.select("paper_id", "text", F.explode(column).alias("s")).select("paper_id", F.lit(kind).alias("kind"), F.col(f"s.{a}").alias("start"), F.col(f"s.{b}").alias("finish"), "text")
        return s.select("paper_id", "kind", "start", "finish", F.sha2(F.substr("text", F.col("start") + 1, F.col("finish") - F.col("start")), 256).alias("hash"))

    return flat("pages", "page", "text_start", "text_end").unionByName(flat("sentence", "sentence", "range_start", "range_end"))


@query("with t as (select paper_id, page, count(*) as tokens from reading_token group by 1, 2) select p.provenance, count(*) as pages, count(*) filter (coalesce(t.tokens, 0) < 20) as sparse, cast(sum(coalesce(t.tokens, 0)) as bigint) as tokens from (select r.paper_id, u.p.page_number, u.p.provenance from reading_index r, unnest(r.pages) as u(p)) p left join t on t.paper_id = p.paper_id and t.page = p.page_number group by 1")
def a10_count_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by provenance, and how many of them have hardly any token."""
    t = table(spark, d, "reading_token").groupBy("paper_id", F.col("page").alias("page_number")).agg(F.count("*").alias("tokens"))
    p = table(spark, d, "reading_index").select("paper_id", F.explode("pages").alias("p")).select("paper_id", "p.page_number", "p.provenance")
    n = F.coalesce("tokens", F.lit(0))
    return p.join(t, ["paper_id", "page_number"], "left").groupBy("provenance").agg(F.count("*").alias("pages"), F.count_if(n < 20).alias("sparse"), F.sum(n).alias("tokens"))


@query("select d.doc_id, case when s.doc_id is null then 'miss' when s.n = length(d.text) and s.made = d.source then 'hit' else 'stale' end as cache from documents d left join (select doc_id, case when doc_id % 4 = 0 then n_chars + 1 else n_chars end as n, case when doc_id % 6 = 0 then 'older' else source end as made from documents where doc_id % 5 <> 0) s on s.doc_id = d.doc_id where d.text is not null")
def s37_load_cached(spark: SparkSession, d: str) -> DataFrame:
    """A stored result counts only while size and stamp of its source are the same."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    k = F.col("doc_id")
    store = docs.where(k % 5 != 0).select("doc_id", F.when(k % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n"), F.when(k % 6 == 0, "older").otherwise(F.col("source")).alias("made"))
    rows = docs.where("text is not null").join(store, "doc_id", "left")
    state = F.when(F.col("n").isNull() & F.col("made").isNull(), "miss").when((F.col("n") == F.length("text")) & (F.col("made") == F.col("source")), "hit").otherwise("stale")
    return rows.select("doc_id", state.alias("cache"))


@query("select g.id, g.display_title, i.n as identifiers, c.n as claims from graph_work g join (select work_id, count(distinct id) as n from work_identifier group by 1) i on i.work_id = g.id join (select work_id, count(*) as n from field_claim group by 1) c on c.work_id = g.id")
def s39_load_extraction(spark: SparkSession, d: str) -> DataFrame:
    """What is put together from three sources; where one part is missing there is nothing."""
    i = table(spark, d, "work_identifier").groupBy(F.col("work_id").alias("id")).agg(F.countDistinct("id").alias("identifiers"))
    c = table(spark, d, "field_claim").groupBy(F.col("work_id").alias("id")).agg(F.count("*").alias("claims"))
    return table(spark, d, "graph_work").select("id", "display_title").join(i, "id").join(c, "id")
