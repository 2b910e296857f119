"""Problem 6: variant spellings of names typed by people.

Method: merge and rematch. Every distinct spelling is read into a profile (family name, given name, initials, or the core
and kind of an organisation). Profiles that match are merged: the merged profile has all spellings, given names and
initials of its parts, enters the blocks again with them, and may now match what neither part matched. This ends when a
round merges nothing.

Spellings of equal reading are one profile from the start, so popular names cost no more than rare ones. A block holds
the profiles of one family name (or of one that lacks one letter of it) and one initial; within a block a profile is
compared with those it could be a lesser form of, and each lesser form goes to its best partner only.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..session import cut
from .components import components
from .linkage import near

# Short forms of given names and the names they stand for.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "bella": "isabella", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lisa": "elizabeth",
    "bill": "william", "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "cathy": "catherine", "kate": "catherine", "cath": "catherine", "dan": "daniel", "danny": "daniel",
    "dave": "david", "dick": "richard", "rick": "richard", "dima": "dmitri", "mitya": "dmitri", "etta": "henrietta", "hetty": "henrietta", "fred": "frederick", "freddy": "frederick", "gabi": "gabriela", "gaby": "gabriela",
    "hans": "johannes", "hannes": "johannes", "jan": "johannes", "jack": "john", "jerry": "jerome", "jim": "james", "jimmy": "james", "joe": "joseph", "kata": "katarina", "katya": "katarina", "ken": "kenji",
    "leo": "leonard", "len": "leonard", "liv": "olivia", "livia": "olivia", "matt": "matthias", "meg": "margaret", "peggy": "margaret", "maggie": "margaret", "mike": "michael", "nick": "nicholas", "klaus": "nicholas",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "sonja": "sofia", "sonia": "sofia", "sophie": "sofia", "steve": "stephen", "sue": "susanna", "susie": "susanna", "ted": "theodore", "theo": "theodore",
    "tom": "tomas", "tommy": "tomas", "tony": "anthony", "uschi": "ursula", "vic": "victoria", "vicky": "victoria", "tori": "victoria", "vince": "vincent", "vinny": "vincent", "yoli": "yolanda", "zach": "zacharias", "zack": "zacharias",
}
# Words of organisations' names and their one form.
ORGANISATION = {
    "university": "university", "univ": "university", "universitat": "university", "universidad": "university", "universite": "university", "institute": "institute", "inst": "institute", "institut": "institute",
    "oceanography": "oceanography", "oceanographic": "oceanography", "oceanogr": "oceanography", "statistics": "statistics", "statistical": "statistics", "stat": "statistics", "office": "office", "national": "national", "natl": "national",
    "laboratory": "laboratory", "lab": "laboratory", "consortium": "consortium", "consort": "consortium", "cons": "consortium", "citation": "citation", "cit": "citation", "society": "society", "soc": "society", "association": "association", "assoc": "association",
    "department": "department", "dept": "department", "center": "centre", "centre": "centre", "ctr": "centre", "academy": "academy", "acad": "academy", "college": "college", "coll": "college", "museum": "museum", "survey": "survey", "agency": "agency", "council": "council", "committee": "committee", "group": "group", "collaboration": "collaboration",
}
SMALL_WORDS = {"the", "of", "for", "and", "collab", "de", "la", "le", "du", "der", "die", "das", "fur", "et"}
ET_AL = r"^\s*(and\s+)?et\.?\s+al\.?\s*$"
#: A given name is read as a mistyped one if a near one is this many times as frequent.
RARER = 5
#: A profile may be a mistyping of a near family name if it has at most so many readings, or the other RARER times as many rows.
FEW = 2


def letters(s: str) -> str:
    """Lower-case letters without accents."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    s = s.replace("ø", "o").replace("ß", "ss").replace("ł", "l").replace("đ", "d").replace("æ", "a").replace("œ", "o")
    return re.sub(r"[^a-z぀-鿿Ѐ-ӿͰ-Ͽ؀-ۿऀ-ॿ]", "", s)


def plain(s: str) -> str:
    """A family name for comparison: its letters, with ae, oe, ue as the letters they stand for."""
    return re.sub(r"([aou])e", r"\1", letters(s))


def _org_word(w: str) -> str | None:
    if w in ORGANISATION:
        return ORGANISATION[w]
    if len(w) >= 6:
        return next((v for k, v in ORGANISATION.items() if len(k) >= 6 and near(w, k) and abs(len(k) - len(w)) <= 1), None)
    return None


def read(name: str) -> tuple[str, str, str, str]:
    """(kind, family name or core, given name or "", all initials in order) of one spelling; kind is person or an organisation's."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", name)).strip()
    loose = [re.sub(r"[^a-z]", "", "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))) for w in re.split(r"[\s,]+", text.replace("(", " ").replace(")", " "))]
    known = [_org_word(w) for w in loose]
    if sum(k is not None for k in known) >= 1 and (sum(k is not None for k in known) >= 2 or any(k in ("university", "institute", "consortium", "laboratory", "office") for k in known)) and len(loose) >= 2:
        kind = " ".join(sorted({k for k in known if k}))
        parts = re.split(r"[\s,]+", text.replace("(", " ").replace(")", " "))
        core = " ".join(sorted(plain(p) for p, k, w in zip(parts, known, loose, strict=True) if k is None and w not in SMALL_WORDS and plain(p)))
        return kind, core or kind, "", ""
    if "," in text:
        family, given = (x.strip() for x in text.split(",", 1))
    else:
        words = text.split(" ")
        last = words[-1].replace(".", "")
        if len(words) > 1 and re.fullmatch(r"[A-ZÀ-Þ]{1,3}", last) and not all("." in w or len(w) == 1 for w in words[:-1]):
            family, given = " ".join(words[:-1]), ". ".join(last) + "."
        else:
            family, given = words[-1], " ".join(words[:-1])
    tokens = [t for t in re.split(r"[\s.\-]+", given) if t]
    dotted = bool(re.match(r"^\s*\w{2,}\.", given))
    if tokens and len(tokens[0]) <= 3 and tokens[0].isupper() and "." not in given and len(tokens) == 1:
        tokens = list(tokens[0])
    first = letters(tokens[0]) if tokens else ""
    initials = "".join(letters(t)[:1] for t in tokens)
    return "person", plain(family), (first + "." if dotted else first) if len(first) > 1 else "", initials


def readings(spellings: DataFrame) -> DataFrame:
    """spellings(name, n) -> (name, n, kind, family, given, initials); names that read as nothing are left by themselves."""

    def run(batches):
        for b in batches:
            rows = [read(x) for x in b["name"]]
            yield pd.DataFrame({"name": b["name"], "n": b["n"], "kind": [r[0] for r in rows], "family": [r[1] for r in rows], "given": [r[2] for r in rows], "initials": [r[3] for r in rows]})

    return spellings.mapInPandas(run, "name string, n bigint, kind string, family string, given string, initials string").where("family <> ''")


def one_less(word: Column) -> Column:
    """The word and every form that lacks one of its letters: equal or near words share one of them."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))))


def _near_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x == y or near(x, y) and abs(len(x) - len(y)) <= 1 for x, y in zip(a, b, strict=True)], dtype=bool)


def near_pairs(words: DataFrame) -> DataFrame:
    """words(w) -> (a, b) of different near words, both ways."""
    check = F.pandas_udf(_near_series, BooleanType())
    keys = words.where(F.length("w") >= 4).select("w", F.explode(one_less(F.col("w"))).alias("k"))
    pairs = keys.withColumnRenamed("w", "a").join(keys.withColumnRenamed("w", "b"), "k").where("a <> b").select("a", "b").distinct()
    return pairs.where(check("a", "b"))


def corrected(rows: DataFrame) -> DataFrame:
    """Given names in their full and most frequent form: short forms by the table, mistyped ones by a near and far more frequent one."""
    nick = F.create_map(*(F.lit(x) for kv in NICKNAMES.items() for x in kv))
    rows = rows.withColumn("given", F.coalesce(nick[F.col("given")], F.col("given")))
    counts = cut(rows.where("kind = 'person' and given <> '' and not endswith(given, '.')").groupBy(F.col("given").alias("w")).agg(F.sum("n").alias("c")))
    pairs = near_pairs(counts.select("w")).join(counts.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(counts.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b")
    better = pairs.where(F.col("cb") >= F.col("ca") * RARER).groupBy("a").agg(F.max(F.struct("cb", "b")).alias("m")).select(F.col("a").alias("given"), F.col("m.b").alias("right"))
    out = rows.join(better, "given", "left").withColumn("given", F.coalesce("right", "given")).drop("right")
    # the first initial is that of the full name (Etta for Henrietta)
    return out.withColumn("initials", F.when(F.col("given") != "", F.concat(F.left("given", F.lit(1)), F.substr("initials", F.lit(2)))).otherwise(F.col("initials")))


def profiles_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one profile per reading, membership name -> profile)."""
    tagged = rows.withColumn("p", F.concat_ws("|", "kind", "family", "given", "initials"))
    members = tagged.select("name", "p")
    one = tagged.groupBy("p", "kind", "family", "given", "initials").agg(F.sum("n").alias("n"))
    return one.select(
        "p", "kind", F.array("family").alias("families"), F.when((F.col("given") != "") & ~F.col("given").endswith("."), F.array("given")).otherwise(F.array().cast("array<string>")).alias("givens"),
        F.when(F.col("given").endswith("."), F.array(F.regexp_replace("given", r"\.$", ""))).otherwise(F.array().cast("array<string>")).alias("cuts"),
        F.when(F.col("initials") != "", F.array(F.left("initials", F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("firsts"),
        F.when(F.length("initials") > 1, F.array(F.substr("initials", F.lit(2)))).otherwise(F.array().cast("array<string>")).alias("middles"), "n", F.lit(1).alias("readings"), F.array("family").alias("main"),
    ), members


def _compatible(x: str, y: str) -> Column:
    """Whether nothing in two persons' profiles contradicts: given names, cut names, first and middle initials."""
    c = lambda k, f: F.col(f"{k}.{f}")
    empty = lambda f: (F.size(c(x, f)) == 0) | (F.size(c(y, f)) == 0)
    given = empty("givens") | F.arrays_overlap(c(x, "givens"), c(y, "givens"))
    starts = lambda k, o: (F.size(c(k, "cuts")) == 0) | (F.size(c(o, "givens")) == 0) | F.exists(c(o, "givens"), lambda g: F.exists(c(k, "cuts"), lambda s: g.startswith(s)))
    first = empty("firsts") | F.arrays_overlap(c(x, "firsts"), c(y, "firsts"))
    middle = empty("middles") | F.exists(c(x, "middles"), lambda a: F.exists(c(y, "middles"), lambda b: a.startswith(b) | b.startswith(a)))
    cuts = empty("cuts") | F.exists(c(x, "cuts"), lambda a: F.exists(c(y, "cuts"), lambda b: a.startswith(b) | b.startswith(a)))
    return given & starts(x, y) & starts(y, x) & first & middle & cuts


def _rank(k: str) -> Column:
    """How much a profile knows: a full given name, then a middle initial, then how often it is written, then its name."""
    return F.struct((F.size(F.col(f"{k}.givens")) > 0).alias("g"), (F.size(F.col(f"{k}.middles")) > 0).alias("m"), F.col(f"{k}.n").alias("n"), F.col(f"{k}.p").alias("p"))


def same_family(profiles: DataFrame) -> DataFrame:
    """(a, b): each profile and the fullest compatible one of its family name, with the middle initial it has itself if there is one."""
    keyed = profiles.where("kind = 'person'").select("*", F.explode("families").alias("fam"))
    keyed = keyed.select("*", F.explode(F.when(F.size("firsts") > 0, F.col("firsts")).otherwise(F.array(F.lit("")))).alias("ini"))
    # what a block may offer: its profiles with a given name or middle initial (few readings), and its most written profile
    x, y = keyed.alias("x"), keyed.alias("y")
    pairs = x.join(y, (F.col("x.fam") == F.col("y.fam")) & (F.col("x.ini") == F.col("y.ini")) & (F.col("x.p") != F.col("y.p"))).where((_rank("x") < _rank("y")) & _compatible("x", "y"))
    shared = F.size(F.array_intersect("x.middles", "y.middles")) > 0
    best = pairs.groupBy(F.col("x.p").alias("a")).agg(F.max(F.struct(shared.alias("s"), F.arrays_overlap("x.givens", "y.givens").alias("g"), F.col("y.n").alias("n"), F.col("y.p").alias("p"))).alias("m"))
    orgs = profiles.where("kind <> 'person'").select("p", F.concat_ws("|", "kind", F.array_join("families", " ")).alias("fam"))
    return best.select("a", F.col("m.p").alias("b")).unionByName(orgs.groupBy("fam").agg(F.collect_set("p").alias("s")).where("size(s) > 1").select(F.explode("s").alias("a"), F.array_min("s").alias("b")))


def near_family(profiles: DataFrame) -> DataFrame:
    """(a, b): each profile of few readings, or of few rows beside the other, and the better known profile whose family name it mistypes.

    Nothing in given names and initials may contradict, and either the names end alike (unlike endings tell families
    apart) or the full given names are equal.
    """
    fam = profiles.select("p", "kind", F.explode("families").alias("w"), "readings", "n")
    pairs = cut(near_pairs(fam.where("kind = 'person'").select("w").distinct()))
    org_pairs = near_pairs(fam.where("kind <> 'person'").select("w").distinct())
    few = profiles.where((F.col("kind") == "person") & (F.size("firsts") > 0)).select("*", F.explode("main").alias("wa"))
    x, y = few.alias("x"), profiles.where("kind = 'person'").select("*", F.explode("main").alias("wb")).alias("y")
    both = x.join(pairs.alias("k"), F.col("x.wa") == F.col("k.a")).join(y, F.col("k.b") == F.col("y.wb")).where((F.col("x.p") != F.col("y.p")) & _compatible("x", "y") & (F.size("y.firsts") > 0))
    order = lambda k: F.struct(F.col(f"{k}.readings"), F.col(f"{k}.n"), F.col(f"{k}.p"))
    both = both.where((order("x") < order("y")) & ((F.col("x.readings") <= FEW) | (F.col("y.n") >= RARER * F.col("x.n"))))
    full = F.arrays_overlap("x.givens", "y.givens")
    tail = F.right("x.wa", F.lit(2)) == F.right("y.wb", F.lit(2))
    best = both.groupBy(F.col("x.p").alias("a")).agg(F.max(F.struct(tail.alias("t"), full.alias("f"), (F.size(F.array_intersect("x.middles", "y.middles")) > 0).alias("m"), F.col("y.readings").alias("r"), F.col("y.n").alias("n"), F.col("y.p").alias("p"))).alias("m"))
    persons = best.where("m.t or m.f").select("a", F.col("m.p").alias("b"))
    o = profiles.where("kind <> 'person'").select("p", "kind", "n", F.explode("families").alias("w"))
    organisations = (
        org_pairs.join(o.select(F.col("w").alias("a"), F.col("p").alias("pa"), F.col("kind").alias("ka"), F.col("n").alias("na")), "a")
        .join(o.select(F.col("w").alias("b"), F.col("p").alias("pb"), F.col("kind").alias("kb"), F.col("n").alias("nb")), "b")
        .where("ka = kb and (nb > na or (nb = na and pb > pa))").groupBy(F.col("pa").alias("a")).agg(F.max(F.struct("nb", "pb")).alias("m")).select("a", F.col("m.pb").alias("b"))
    )
    return persons.unionByName(organisations)


def merged(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    """Profiles of one group united: all family names, given names, cuts and initials, and the family name of most rows."""
    rows = profiles.join(groups.select(F.col("vertex").alias("p"), "group"), "p", "left").withColumn("p", F.coalesce("group", "p")).drop("group")
    both = lambda f: F.array_sort(F.array_distinct(F.flatten(F.collect_set(f)))).alias(f)
    return rows.groupBy("p").agg(F.min("kind").alias("kind"), *map(both, ("families", "givens", "cuts", "firsts", "middles")), F.sum("n").alias("n"), F.sum("readings").cast("int").alias("readings"), F.max(F.struct("n", "main")).alias("m")).select(
        "p", "kind", "families", "givens", "cuts", "firsts", "middles", "n", "readings", F.col("m.main").alias("main")
    )


def resolve(names: DataFrame) -> DataFrame:
    """names(name) -> (name, entity), one row per different spelling; null, blank and "et al." are no names."""
    spellings = names.where(F.col("name").isNotNull() & (F.trim("name") != "") & ~F.lower("name").rlike(ET_AL)).groupBy("name").agg(F.count("*").alias("n"))
    profiles, members = profiles_of(cut(corrected(cut(readings(spellings)))))
    profiles, members = cut(profiles), cut(members)
    while True:
        links = cut(same_family(profiles))
        if links.isEmpty():
            links = cut(near_family(profiles))
        groups = components(links)
        if links.isEmpty():
            return members.select("name", F.col("p").alias("entity"))
        groups = cut(groups)
        profiles = cut(merged(profiles, groups))
        members = cut(members.join(groups.select(F.col("vertex").alias("p"), "group"), "p", "left").select("name", F.coalesce("group", "p").alias("p")))


def pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of all different spellings of one entity: the form TESTDATA.md fixes."""
    a, b = entities.select("entity", F.col("name").alias("name_a")), entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def author_names(works: DataFrame, openalex: DataFrame, entries: DataFrame) -> DataFrame:
    """All author strings of the three fields, one row per occurrence."""
    parsed = F.from_json(F.get_json_object("fields", "$.authors.value"), "array<string>")
    return (
        works.select(F.explode("display_authors").alias("name")).unionByName(openalex.select(F.explode("authors").alias("name"))).unionByName(entries.select(F.explode(parsed).alias("name")))
    )
