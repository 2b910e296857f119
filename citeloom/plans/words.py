"""Cleaning, cutting and reading of text, over whole tables and with literal rows that show each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import bibliography as B
from ..functions import reference as R
from ..functions.titlekey import key_of
from ..session import table
from .catalog import query
from .links import _case, literals
from .selection import family_sql, key_sql, udf
from .whole import _folded
from .wholetext import _replaced

CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"


def clean_text(text: Column, longest: int) -> Column:
    """White space collapsed; null with control characters, without a letter or sign, or if it is longer."""
    t = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.when(~text.rlike(CONTROL) & (t != "") & (F.length(t) <= longest), t)


TEXTS = [("  a \n b ", "a b"), ("bell\x07", None), ("", None), ("   ", None), ("x" * 301, None), ("tab\tbed", "tab bed")]
_TEXTS = literals(TEXTS, "x, y").replace("\n", "' || chr(10) || '").replace("\x07", "' || chr(7) || '").replace("\t", "' || chr(9) || '")


@query(_TEXTS)
def f19_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _case(spark, TEXTS, "string", clean_text(F.col("x"), 300))


@query("select id, coalesce(nullif(substr(trim(regexp_replace(display_title, '\\s+', ' ', 'g')), 1, 120), ''), 'Untitled ramp') as title from graph_work")
def f22_default_ramp_title(spark: SparkSession, d: str) -> DataFrame:
    """The work's title in one line, cut to 120 characters, or a fallback."""
    t = F.left(F.trim(F.regexp_replace("display_title", r"\s+", " ")), F.lit(120))
    return table(spark, d, "graph_work").select("id", F.coalesce(F.nullif(t, F.lit("")), F.lit("Untitled ramp")).alias("title"))


@query("select id, case field when 'year' then try_cast(value as int) between 1400 and 2200 when 'author' then coalesce(json_type(try_cast(value as json)) = 'ARRAY' and json_array_length(try_cast(value as json)) > 0 and list_bool_and(list_transform(json_extract(try_cast(value as json), '$[*]'), lambda x: json_type(x) = 'VARCHAR' and trim(x ->> '$') <> '')), false) else coalesce(json_type(try_cast(value as json)) = 'VARCHAR' and length(trim(try_cast(value as json) ->> '$')) between 1 and 1000, false) end as valid from field_claim where field in ('title', 'venue', 'year', 'author')")
def f18_parse_override(spark: SparkSession, d: str) -> DataFrame:
    """Whether a value may be set by hand: a plausible year, names, or a text of some length."""
    kind = F.expr("schema_of_variant(try_parse_json(value))")
    names = F.from_json("value", "array<string>")
    text = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    author = (kind == "ARRAY<STRING>") & (F.size(names) > 0) & ~F.exists(names, lambda x: x.isNull() | (F.trim(x) == ""))
    valid = F.when(F.col("field") == "year", F.col("value").try_cast("int").between(1400, 2200)).when(F.col("field") == "author", F.coalesce(author, F.lit(False))).otherwise(F.coalesce((kind == "STRING") & F.length(F.trim(text)).between(1, 1000), F.lit(False)))
    return table(spark, d, "field_claim").where("field in ('title', 'venue', 'year', 'author')").select("id", valid.alias("valid"))


@query("select id, lower(regexp_replace(printed_key, '\\s', '', 'g')) as key from bibliography_entry where printed_key is not null")
def f34_key(spark: SparkSession, d: str) -> DataFrame:
    """Printed keys in compatible form and lower case without white space."""
    import unicodedata

    key = udf(lambda v: "".join(unicodedata.normalize("NFKC", v).lower().split()), StringType())
    return table(spark, d, "bibliography_entry").where("printed_key is not null").select("id", key("printed_key").alias("key"))


_ENTRY_NAMES = "cast(fields -> '$.authors.value' as varchar[])"


@query(f"select id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_ENTRY_NAMES}, lambda n: {key_sql('coalesce(' + family_sql('trim(n)') + ', trim(n))')}), lambda x: x <> ''))), '|') as families from bibliography_entry where {_ENTRY_NAMES} is not null and not regexp_matches(cast(fields -> '$.authors.value' as varchar), '(?i)et al|others')")
def f37_author_families(spark: SparkSession, d: str) -> DataFrame:
    """Distinct family keys of printed author lists."""
    names = F.from_json(F.get_json_object("fields", "$.authors.value"), "array<string>")
    keys = udf(lambda v: "|".join(sorted({k for k in B.author_list_key(v)[0] if k})), StringType())
    rows = table(spark, d, "bibliography_entry").where(names.isNotNull() & ~F.get_json_object("fields", "$.authors.value").rlike("(?i)et al|others"))
    return rows.select("id", keys(names).alias("families"))


@query("select id, sha256('model-1|' || 'v3|' || raw_text) as key, sha256('{\"cited\":\"' || entry_key || '\",\"ordinal\":' || ordinal || '}') as label_key from bibliography_entry where raw_text is not null")
def f40_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of cached answers: of model, prompt version and text; of a record as JSON with sorted names."""
    json = F.to_json(F.struct(F.col("entry_key").alias("cited"), "ordinal"))
    return table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", F.sha2(F.concat(F.lit("model-1|v3|"), "raw_text"), 256).alias("key"), F.sha2(json, 256).alias("label_key"))


SOFT = "[\\x{ad}\\x{200b}\\x{0}\\x{feff}]"


@query(f"select id, regexp_replace(replace(replace(replace(replace(replace(passage, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '{SOFT}', '', 'g') as normalized from citation_mention where passage is not null")
def f72_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Ligatures apart; soft hyphens, zero-width blanks and null characters dropped."""
    from ..functions.text import expand_ligatures

    return table(spark, d, "citation_mention").where("passage is not null").select("id", F.regexp_replace(expand_ligatures(F.col("passage")), "[­​\u0000﻿]", "").alias("normalized"))


FIGURES = [("Figure 3", "3"), ("Fig. S12a", "S12A"), ("Table 4-2", "4-2"), ("figs. 3–5", "3"), ("no number", None), ("Figure 12345", None), ("Tab. 7b.", "7B")]


@query(literals(FIGURES, "x, y"))
def f82_identifier(spark: SparkSession, d: str) -> DataFrame:
    """Number of a figure or table: an S, one to four digits, a part and a letter may follow; a range keeps its first."""
    found = F.upper(F.regexp_extract("x", r"(?i)\b(S?\d{1,4}(?!\d)(?:-\d+)?[a-z]?)(?![\w])", 1))
    return _case(spark, FIGURES, "string", F.nullif(found, F.lit("")))


@query("select id, case when length(passage) > 200 then trim(substr(passage, greatest(1, m - 60), 120 + length(marker_text))) else passage end as clip from (select *, instr(passage, marker_text) as m from citation_mention where passage is not null and marker_text <> '') where m > 0")
def f90_clip_passage(spark: SparkSession, d: str) -> DataFrame:
    """Long passages cut to a window around their marker."""
    m = F.instr("passage", F.col("marker_text"))
    rows = table(spark, d, "citation_mention").where("passage is not null and marker_text <> ''").withColumn("m", m).where("m > 0")
    start = F.greatest(F.lit(1), F.col("m") - 60)
    return rows.select("id", F.when(F.length("passage") > 200, F.trim(F.substr("passage", start, 120 + F.length("marker_text")))).otherwise(F.col("passage")).alias("clip"))


SENTENCES = r"select doc_id, s from (select doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) as s from documents where text is not null)"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "([.!?]) ", "$1\u0001")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(t, "\u0001")).alias("s"))


@query(f"select doc_id, count(*) as sentences, max(length(s)) as longest from ({SENTENCES}) where length(s) >= 30 group by doc_id")
def f96_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of at least thirty characters."""
    return _sentences(spark, d).where(F.length("s") >= 30).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("bigint").alias("longest"))


@query(rf"select doc_id, count(*) as sentences from ({SENTENCES}) where len(string_split_regex(trim(s), '\s+')) >= 7 and not regexp_matches(s, '(?i)^\s*\[?[0-9]+\]|\bet al\.,? \(?[0-9]{{4}}|\bpp?\. [0-9]') group by doc_id")
def f97_meaningful_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of at least seven words that aren't citations."""
    return _sentences(spark, d).where(R.is_meaningful_sentence(F.col("s"))).groupBy("doc_id").agg(F.count("*").alias("sentences"))


LINES = "select doc_id, unnest(string_split(text, chr(10))) as x from documents where text is not null"


@query(rf"select doc_id, count(*) as headings from (select doc_id, trim(x) as t from ({LINES})) where length(t) between 3 and 90 and regexp_matches(t, '^([0-9]+(\.[0-9]+)*\.?\s+)?\p{{Lu}}') and not regexp_matches(t, '[.,;:!?]$') and len(string_split_regex(t, '\s+')) <= 12 and length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) * 2 > length(t) group by doc_id")
def f107_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like headings, by document."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return rows.where(R.looks_like_heading(F.col("x"))).groupBy("doc_id").agg(F.count("*").alias("headings"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(text, '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g'), '\n[ \t]*\n([ \t]*\n)+', chr(10) || chr(10), 'g'), E' \t\n\r') as cleaned from documents where text is not null")
def f103_clean_page(spark: SparkSession, d: str) -> DataFrame:
    """Words divided at line ends joined; several blank lines become one."""
    t = F.regexp_replace(F.regexp_replace("text", r"(\p{Ll})-\n(\p{Ll})", "$1$2"), r"\n[ \t]*\n([ \t]*\n)+", "\n\n")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(t, r"^[ \t\n\r]+|[ \t\n\r]+\z", "").alias("cleaned"))


WORDS_KEPT = [("well-\nknown", "well-known"), ("co-\noperate", "cooperate"), ("self-\ntest", "self-test"), ("inter-\nnational", "international"), ("end-", "end-"), ("A-\nB", "A-B"), ("non-\nlinear", "non-linear")]
# First parts that keep their hyphen at a line's end.
KEEP = "well|self|non|half|cross|high|low|long|short|state|time|real|multi|two|three|first|second"


@query(literals(WORDS_KEPT, "x, y").replace("\n", "' || chr(10) || '"))
def f74_append_word(spark: SparkSession, d: str) -> DataFrame:
    """A word goes on after a line's end without the hyphen, unless its first part keeps it or the second isn't in small letters."""
    kept = F.regexp_replace("x", rf"(?i)\b({KEEP})-\n", "$1-")
    return _case(spark, WORDS_KEPT, "string", F.regexp_replace(F.regexp_replace(kept, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"-\n", "-"))


@query("select event_id, numbered * 2 < candidates and candidates >= 4 as retry from (select event_id, cast(floor(value) as int) % 10 as numbered, event_id % 13 as candidates from events)")
def f113_needs_retry(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer numbered too few of its candidates."""
    n, c = F.floor("value").cast("int") % 10, F.col("event_id") % 13
    return table(spark, d, "events").select("event_id", ((n * 2 < c) & (c >= 4)).alias("retry"))


@query(f"select id, regexp_replace({_replaced('strip_accents(lower(display_title))')}, '[^a-z0-9 ]', '', 'g') as folded, regexp_replace({_replaced('strip_accents(lower(display_title))')}, '[^a-z0-9]', '', 'g') as loose from graph_work where display_title is not null")
def f124_fold(spark: SparkSession, d: str) -> DataFrame:
    """Titles decomposed, in lower case, with words kept apart and without."""
    words = F.transform(F.split("display_title", " "), lambda w: w)
    rows = table(spark, d, "graph_work").where("display_title is not null").select("id", "display_title", F.posexplode(words).alias("i", "w"))
    parts = rows.select("id", "i", _folded("w").alias("f"))
    joined = parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda x: x["f"]), " ").alias("folded"))
    return joined.select("id", "folded", F.replace("folded", F.lit(" "), F.lit("")).alias("loose"))


@query(f"select author, {key_sql('coalesce(' + family_sql('trim(author)') + ', trim(author))')} || ':' || coalesce(nullif(lower(strip_accents(substr(case when contains(author, ',') then trim(split_part(author, ',', 2)) else trim(author) end, 1, 1))), ''), '') as key from (select distinct unnest(authors) as author from openalex_work) where author is not null and regexp_matches(trim(author), '^\\p{{L}}')")
def f127_name_key(spark: SparkSession, d: str) -> DataFrame:
    """Family and first initial of author names."""
    rows = table(spark, d, "openalex_work").select(F.explode("authors").alias("author")).where("author is not null").where(F.trim("author").rlike(r"^\p{L}")).distinct()
    family = udf(lambda v: B.citation_family(v) or v.strip(), StringType())("author")
    given = F.when(F.contains("author", F.lit(",")), F.trim(F.split_part("author", F.lit(","), F.lit(2)))).otherwise(F.trim("author"))
    initial = F.left(given, F.lit(1))
    return rows.select("author", F.concat(key_of(family), F.lit(":"), key_of(initial)).alias("key"))


NUMBERS = [("Theorem 3.2", "3.2"), ("Eq. (12)", "12"), ("Table IV", "4"), ("Figure A1", "A1"), ("no", None), ("Lemma 10", "10")]


@query(literals(NUMBERS, "x, y"))
def f129_object_number(spark: SparkSession, d: str) -> DataFrame:
    """The number of an object's label; Roman numerals of tables become digits."""
    arabic = F.regexp_extract("x", r"\b([A-Z]?\d+(?:\.\d+)*)", 1)
    roman = F.regexp_extract("x", r"\b([IVX]{1,5})$", 1)
    table_ = F.create_map(*(F.lit(v) for k in enumerate(["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"], 1) for v in (k[1], str(k[0]))))
    return _case(spark, NUMBERS, "string", F.coalesce(F.nullif(arabic, F.lit("")), table_[roman]))


@query("select p_partkey as id, concat_ws(' · ', case when p_size > 10 then 'cited by ' || p_size || ' works' end, case when p_partkey % 3 = 0 then 'in the library' end, case when p_size % 2 = 0 then 'used as method' end) as summary from part")
def f132_signal_summary(spark: SparkSession, d: str) -> DataFrame:
    """The phrases of the signals that are there, in order."""
    s, k = F.col("p_size"), F.col("p_partkey")
    phrases = F.concat_ws(" · ", F.when(s > 10, F.concat(F.lit("cited by "), s.cast("string"), F.lit(" works"))), F.when(k % 3 == 0, "in the library"), F.when(s % 2 == 0, "used as method"))
    return table(spark, d, "part").select(k.alias("id"), phrases.alias("summary"))


@query("select id, substr(coalesce(nullif(trim(raw_text), ''), fields ->> '$.title.value'), 1, 512) as query from bibliography_entry where coalesce(nullif(trim(raw_text), ''), fields ->> '$.title.value') is not null")
def f146_query_text(spark: SparkSession, d: str) -> DataFrame:
    """What a provider is asked for: the printed text, else the title, 512 characters at most (the operator's own limit)."""
    t = F.coalesce(F.nullif(F.trim("raw_text"), F.lit("")), F.get_json_object("fields", "$.title.value"))
    return table(spark, d, "bibliography_entry").where(t.isNotNull()).select("id", F.left(t, F.lit(512)).alias("query"))


@query("with p as (select r.paper_id, u.p.page_number as n, substr(r.text, u.p.text_start + 1, u.p.text_end - u.p.text_start) as t from reading_index r, unnest(r.pages) as u(p) where r.text is not null) select paper_id, sha256(string_agg('[page ' || n || ']' || chr(10) || t, chr(10) order by n)) as marked from p group by paper_id")
def f151_page_marked_text(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a paper behind marks with their numbers, as a hash of the text."""
    rows = table(spark, d, "reading_index").where("text is not null and size(pages) > 0")
    page = lambda p: F.concat(F.lit("[page "), p["page_number"].cast("string"), F.lit("]\n"), F.substr("text", p["text_start"] + 1, p["text_end"] - p["text_start"]))
    return rows.select("paper_id", F.sha2(F.array_join(F.transform(F.array_sort("pages", lambda a, b: F.when(a["page_number"] < b["page_number"], -1).when(a["page_number"] > b["page_number"], 1).otherwise(0)), page), "\n"), 256).alias("marked"))


@query("select user_id as job, '# Tasks' || chr(10) || string_agg('- [' || case event_type when 'purchase' then 'x' when 'error' then '!' when 'click' then '~' else ' ' end || '] ' || event_id, chr(10) order by event_id) as list from events group by user_id")
def f158_render_tasklist(spark: SparkSession, d: str) -> DataFrame:
    """A job's tasks as a list with a sign for each state."""
    sign = F.when(F.col("event_type") == "purchase", "x").when(F.col("event_type") == "error", "!").when(F.col("event_type") == "click", "~").otherwise(" ")
    line = F.struct("event_id", F.concat(F.lit("- ["), sign, F.lit("] "), F.col("event_id").cast("string")).alias("l"))
    lists = table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.array_sort(F.collect_list(line)).alias("s"))
    return lists.select("job", F.concat(F.lit("# Tasks\n"), F.array_join(F.transform("s", lambda x: x["l"]), "\n")).alias("list"))


@query(r"with b as (select doc_id, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) as i, unnest(string_split_regex(text, '\n[ \t]*\n')) as b from documents where text is not null), h as (select doc_id, i, b, not contains(b, chr(10)) and length(trim(b)) between 3 and 90 and regexp_matches(trim(b), '^\p{Lu}') and not regexp_matches(trim(b), '[.,;:!?。！？]$') as head from b where trim(b, E' \t\n') <> ''), s as (select *, sum(head::int) over (partition by doc_id order by i) as sec from h) select doc_id, cast(sec as bigint) as section, max(case when head then trim(b) end) as heading, count(*) filter (not head) as paragraphs from s group by 1, 2")
def f161_discover_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each document: a heading starts a new one; what stands before the first is section 0."""
    head = ~F.contains("b", F.lit("\n")) & F.length(F.trim("b")).between(3, 90) & F.trim("b").rlike(r"^\p{Lu}") & ~F.trim("b").rlike(r"[.,;:!?。！？]$")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("i", "b")).where(F.regexp_replace("b", r"[ \t\n]", "") != "").withColumn("head", head)
    # a document's blocks are counted within its own row, so no window is needed
    blocks = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("head"), F.trim("b")).alias("h")))).alias("s"))
    start = F.expr("cast(array() as array<struct<sec:bigint,h:string>>)")
    step = lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["sec"], F.lit(0)) + x["h"].isNotNull().cast("bigint")).cast("bigint").alias("sec"), x["h"].alias("h"))))
    told = blocks.select("doc_id", F.explode(F.aggregate("s", start, step)).alias("x"))
    return told.groupBy("doc_id", F.col("x.sec").alias("section")).agg(F.max("x.h").alias("heading"), F.count_if(F.col("x.h").isNull()).alias("paragraphs"))
