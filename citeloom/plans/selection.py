"""Title keys, author lists, and the selection of the shown claim of each field."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import bibliography as B
from ..functions.titlekey import decode_latex, key_of
from ..operators import selection as S
from ..session import table
from .catalog import query


def udf(f, kind):
    """f of single values on Arrow batches; null gives null."""
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def key_sql(x: str) -> str:
    """The title key of a title without commands, in SQL."""
    plain = f"regexp_replace(replace(replace(strip_accents(lower({x})), 'ß', 'ss'), 'ς', 'σ'), '[\\s.,:;!?''\"‘’“”„«»‹›…‐‑‒–—-]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '([^\\p{{L}}\\p{{N}}\\s])', ' \\1 ', 'g'), '\\s+', ' ', 'g'))"


_CUT = r"(?i)(^|[,\s])(and others|et al|others)[.,\s]*$"
_NAME = f"trim(regexp_replace(trim({{x}}), '{_CUT}', ''))"
_FAMILY = r"case when contains({x}, ',') then trim(split_part({x}, ',', 1)) else rtrim(trim(regexp_extract({x}, '(?:(?:^|\s)(?:van|von|de|del|della|da|dos|das|la|der|den))*(?:^|\s)\S+$')), '.') end"
_BAD = r"len(regexp_extract_all(trim({x}), '\S+')) > 6 or regexp_matches({f}, '[0-9]') or not regexp_matches({f}, '\p{{L}}')"


def family_sql(x: str) -> str:
    """citation_family of a trimmed name in SQL; null where it has none."""
    f = _FAMILY.format(x=x)
    return f"case when {_BAD.format(x=x, f=f)} then null else {f} end"


def families_sql(names: str) -> str:
    """The families of a list, and whether it is cut, as two SQL expressions joined in a struct."""
    name = _NAME.format(x="x")
    return (
        f"struct_pack(fam := list_transform(list_filter(list_transform({names}, lambda x: {name}), lambda n: n <> ''), lambda n: {key_sql('coalesce(' + family_sql('n') + ', n)')}), "
        f"cut := coalesce(list_bool_or(list_transform({names}, lambda x: regexp_matches(trim(x), '{_CUT}'))), false))"
    )


LITERAL_TITLES = [(r"The $\alpha$-decay of \emph{big} nuclei", "the α decay of big nuclei"), (r"Caf\'e \"{U}ber", "cafe uber"), ("C++", "c + +"), (r"\notknown{abc}", r"\notknown { abc }"), ("Größe und ς", "grosse und σ"), ("soft­hy​phen", "softhyphen"), (r"\beta-decay \& more", "β decay & more"), ("", "")]
_LITERALS = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in LITERAL_TITLES)


@query(f"select distinct display_title as title, {key_sql('display_title')} as key from graph_work where display_title is not null union select * from (values {_LITERALS}) as l(title, key)")
def f01_title_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all titles, and of literal ones with commands, ligatures of letters and invisible characters."""
    rows = table(spark, d, "graph_work").where("display_title is not null").select(F.col("display_title").alias("title"))
    rows = rows.unionByName(spark.createDataFrame([(a,) for a, _ in LITERAL_TITLES], "title string")).distinct()
    return rows.select("title", key_of(F.col("title")).alias("key"))


LATEX = [(r"$\alpha$ and \textbf{bold}", "α and bold"), (r"H$_2$O", "H_{2}O"), ("costs $5", "costs $5"), (r"a~b\,c", "a b c"), (r"\ss \O", "ß Ø"), ("$x-y$", "x−y"), (r"50\% \& 1\_2", "50% & 1_2")]


@query("select * from (values " + ", ".join("('{}', '{}')".format(a.replace("'", "''"), b) for a, b in LATEX) + ") as l(title, decoded) union select distinct display_title, display_title from graph_work where display_title is not null and not regexp_matches(display_title, '[\\\\${}~^_]')")
def f02_decode_latex(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_work").where(F.col("display_title").isNotNull() & ~F.col("display_title").rlike(r"[\\${}~^_]")).select(F.col("display_title").alias("title"))
    rows = rows.unionByName(spark.createDataFrame([(a,) for a, _ in LATEX], "title string")).distinct()
    return rows.select("title", udf(decode_latex, StringType())("title").alias("decoded"))


AUTHORS = "(select unnest(display_authors) as author from graph_work union select unnest(authors) from openalex_work union select unnest(['Jan van der Waals', 'Smith 3rd', 'A B C D E F G', 'Vaughan, W.', '...', 'Doe, J. et al.', 'Roe and others', 'others', 'a: b', 'x/y', 'Maria dos Santos.']))"


def _authors(spark: SparkSession, d: str) -> DataFrame:
    """Author strings of works and records, and literal ones with particles, digits, cuts and too many words."""
    more = ["Jan van der Waals", "Smith 3rd", "A B C D E F G", "Vaughan, W.", "...", "Doe, J. et al.", "Roe and others", "others", "a: b", "x/y", "Maria dos Santos."]
    rows = table(spark, d, "graph_work").select(F.explode("display_authors").alias("author")).unionByName(table(spark, d, "openalex_work").select(F.explode("authors").alias("author")))
    return rows.unionByName(spark.createDataFrame([(a,) for a in more], "author string")).distinct()


@query(r"select author, case when regexp_matches(f, '\p{L}') then f end as family from (select author, rtrim(regexp_extract(trim(regexp_extract(author, '^(.*?)(?:,| and |&| et al|;|$)', 1)), '\S+$'), '.') as f from " + AUTHORS + ") where author is not null")
def f11_first_author_family(spark: SparkSession, d: str) -> DataFrame:
    return _authors(spark, d).where("author is not null").select("author", udf(B.first_author_family, StringType())("author").alias("family"))


@query(f"select author, {family_sql('trim(author)')} as family from {AUTHORS} where author is not null")
def f12_citation_family(spark: SparkSession, d: str) -> DataFrame:
    return _authors(spark, d).where("author is not null").select("author", udf(B.citation_family, StringType())("author").alias("family"))


@query(f"select author, not regexp_matches(rtrim(author, '.'), '[:/]') and ({family_sql(chr(114) + 'trim(author, ' + chr(39) + '.' + chr(39) + ')')}) is not null as person from {AUTHORS} where author is not null")
def f13_looks_like_person_name(spark: SparkSession, d: str) -> DataFrame:
    return _authors(spark, d).where("author is not null").select("author", udf(B.looks_like_person_name, BooleanType())("author").alias("person"))


@query(f"select author, {_NAME.format(x='author')} as name, regexp_matches(trim(author), '{_CUT}') as cut from {AUTHORS} where author is not null")
def f15_strip_truncation(spark: SparkSession, d: str) -> DataFrame:
    kind = StructType([StructField("name", StringType()), StructField("cut", BooleanType())])
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([B.strip_truncation(v) for v in x], columns=["name", "cut"])

    return _authors(spark, d).where("author is not null").select("author", run("author").alias("s")).select("author", "s.name", "s.cut")


@query(f"select id, list_aggregate(k.fam, 'string_agg', '|') as families, k.cut as cut from (select id, {families_sql('display_authors')} as k from graph_work where display_authors is not null)")
def f14_author_list_key(spark: SparkSession, d: str) -> DataFrame:
    """The families of a list in order, and whether the list is cut."""
    keys = udf(lambda v: "|".join(B.author_list_key(v)[0]) or None, StringType())
    cut = udf(lambda v: B.author_list_key(v)[1], BooleanType())
    return table(spark, d, "graph_work").where("display_authors is not null").select("id", keys("display_authors").alias("families"), cut("display_authors").alias("cut"))


CLAIMS = f"""c as (select *, json_type(try_cast(value as json)) as kind from field_claim where work_id is not null and field is not null and id is not null),
 j as (select *, case when review_state = 'rejected' then 'rejected' when retracted_at is not null then 'retracted'
   when coalesce((field in ('title', 'venue') and kind = 'VARCHAR' and trim(try_cast(value as json) ->> '$') <> '') or (field = 'year' and kind in ('BIGINT', 'UBIGINT')) or (field = 'author' and kind = 'ARRAY' and json_array_length(try_cast(value as json)) > 0 and list_bool_and(list_transform(json_extract(try_cast(value as json), '$[*]'), lambda x: json_type(x) = 'VARCHAR'))), false) then null else 'unreadable' end as reason,
   (coalesce(list_position({S.ORIGINS}, origin), 7) - 1) * 4 + coalesce(list_position({S.CONFIDENCES}, confidence), 4) - 1 as tier from c),
 a as (select *, case when field = 'author' and reason is null then {families_sql("try_cast(try_cast(value as json) as varchar[])")} end as fa, case when reason is null and field in ('title', 'venue') then {key_sql("(try_cast(value as json) ->> '$')")} when reason is null and field = 'year' then trim(value) end as one from j),
 k as (select *, case when reason is not null then [] when field = 'author' then fa.fam when one <> '' then [one] else [] end as key, coalesce(fa.cut, false) as cut,
   case when field <> 'author' then 0 when fa.cut then -1 else len(fa.fam) end as complete from a)"""
_AGREES = "(len({a}.key) > 0 and len({b}.key) > 0 and ({a}.key = {b}.key or ({a}.field = 'author' and (({a}.cut and {b}.key[1:len({a}.key)] = {a}.key) or ({b}.cut and {a}.key[1:len({b}.key)] = {b}.key)))))"
SELECTED = f"""{CLAIMS}, t as (select * from (select *, min(tier) over (partition by work_id, field) as top from k where reason is null) where tier = top),
 s as (select x.id, count(*) as support, any_value(n) as n from (select *, count(*) over (partition by work_id, field) as n from t) x join t y on x.work_id = y.work_id and x.field = y.field and (x.id = y.id or {_AGREES.format(a="x", b="y")}) group by x.id),
 w as (select t.*, s.support, max(s.support < s.n) over (partition by work_id, field) as conflict, row_number() over (partition by work_id, field order by s.support desc, complete desc, created_at, t.id) as place from t join s using (id)),
 won as (select f.work_id, f.field, w.id as claim_id, w.value, w.key, w.cut, case when w.id is null then 'unknown' when w.conflict then 'conflicting' else 'known' end as state, w.support from (select distinct work_id, field from k) f left join w on w.work_id = f.work_id and w.field = f.field and w.place = 1)"""


@query(f"with {SELECTED} select work_id, field, claim_id, value, state, support from won")
def k18_select_field(spark: SparkSession, d: str) -> DataFrame:
    """The shown claim of each field: best origin and confidence, then support by agreeing claims, completeness, age, id."""
    return S.selected(table(spark, d, "field_claim")).select("work_id", "field", "claim_id", "value", "state", "support")


@query(f"with {SELECTED} select k.work_id, k.field, k.id, case when k.reason is not null then 'excluded:' || k.reason when k.id = won.claim_id then 'selected' when {_AGREES.format(a='won', b='k')} then 'agrees' else 'disagrees' end as relation from k join won using (work_id, field)".replace("won.field = 'author'", "field = 'author'"))
def k21_field_provenance(spark: SparkSession, d: str) -> DataFrame:
    """How every claim relates to the shown one."""
    return S.provenance(table(spark, d, "field_claim"))


RESELECTED = f"""{SELECTED}, m as (select work_id, max(case when field = 'title' then struct_pack(v := value) end) as t, max(case when field = 'year' then struct_pack(v := value) end) as y, max(case when field = 'author' then struct_pack(v := value) end) as a from won where field in ('title', 'year', 'author') group by work_id),
 r as (select g.id, display_title, display_year, display_authors, case when m.t is not null then try_cast(m.t.v as json) ->> '$' else display_title end as nt, case when m.y is not null then try_cast(m.y.v as int) else display_year end as ny, case when m.a is not null then try_cast(try_cast(m.a.v as json) as varchar[]) else display_authors end as na from graph_work g left join m on m.work_id = g.id)"""


@query(f"with {RESELECTED} select id, nt as display_title, ny as display_year, array_to_string(na, '; ') as display_authors from r")
def k19_reselect(spark: SparkSession, d: str) -> DataFrame:
    """The works with their fields as selected."""
    return S.reselect(table(spark, d, "graph_work"), table(spark, d, "field_claim")).select("id", "display_title", "display_year", F.array_join("display_authors", "; ").alias("display_authors"))


@query(f"with {RESELECTED} select count(*) as works, count(*) filter (nt is distinct from display_title) as titles, count(*) filter (ny is distinct from display_year) as years, count(*) filter (na is distinct from display_authors) as authors from r")
def k20_reselect_all(spark: SparkSession, d: str) -> DataFrame:
    """How many works a selection over all of them changes, by field."""
    has = lambda f: F.count_if(F.array_contains("changed", f))
    return S.reselect(table(spark, d, "graph_work"), table(spark, d, "field_claim")).agg(F.count("*").alias("works"), has("display_title").alias("titles"), has("display_year").alias("years"), has("display_authors").alias("authors"))


@query(f"with {RESELECTED}, f as (select min(id) as id from graph_work) select r.id, nt as display_title, ny as display_year from r join f using (id)")
def k30_reselect_one(spark: SparkSession, d: str) -> DataFrame:
    """The selection of one work alone: the claims of others are never read further than the scan's filter."""
    works = table(spark, d, "graph_work")
    one = works.agg(F.min("id").alias("id"))
    claims = table(spark, d, "field_claim")
    return S.reselect(works.join(one, "id", "left_semi"), claims.join(one, F.col("work_id") == one["id"], "left_semi")).select("id", "display_title", "display_year")


@query(f"with {CLAIMS}, p as (select a.id as a, b.id as b, {_AGREES.format(a='a', b='b')} as agree from k a join k b on a.work_id = b.work_id and a.field = b.field and a.id < b.id and a.reason is null and b.reason is null and a.origin = 'publisher' and b.origin = 'paper') select a, b, agree from p")
def m18_values_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether the publisher's and the paper's claim of one field say the same, by the rules of the field."""
    rows = S.judged(table(spark, d, "field_claim")).where("reason is null").select("work_id", "field", "id", "origin", "key", "cut")
    x, y = (rows.where(F.col("origin") == o).select("work_id", "field", F.col("id").alias(n), F.col("key").alias(f"{n}_key"), F.col("cut").alias(f"{n}_cut")) for o, n in (("publisher", "a"), ("paper", "b")))
    return x.join(y, ["work_id", "field"]).where("a < b").select("a", "b", S.agree("a_", "b_", F.col("field")).alias("agree"))


@query(f"with p as (select g.id, o.openalex_id, {families_sql('g.display_authors')} as x, {families_sql('o.authors')} as y from graph_work g join openalex_work o on lower(o.title) = lower(g.display_title) where g.display_authors is not null and o.authors is not null) select id, openalex_id, len(x.fam) > 0 and len(y.fam) > 0 and (x.fam = y.fam or (x.cut and y.fam[1:len(x.fam)] = x.fam) or (y.cut and x.fam[1:len(y.fam)] = y.fam)) as agree from p")
def m19_authors_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether the author lists of works and records of one title agree."""
    @F.pandas_udf(BooleanType())
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([B.authors_agree(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    g = table(spark, d, "graph_work").where("display_authors is not null").select("id", F.lower("display_title").alias("k"), "display_authors")
    o = table(spark, d, "openalex_work").where("authors is not null").select("openalex_id", F.lower("title").alias("k"), "authors")
    return g.join(o, "k").select("id", "openalex_id", same("display_authors", "authors").alias("agree"))


@query(f"with {CLAIMS} select id, complete from k where reason is null")
def f17_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Names of an author list, -1 for a cut one, 0 for other fields."""
    return S.judged(table(spark, d, "field_claim")).where("reason is null").select("id", "complete")


