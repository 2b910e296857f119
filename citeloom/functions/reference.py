"""Parts of printed references and lines of documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DOI, clean, trim_punctuation

# Headings that open a list of references.
HEADINGS = ["references", "bibliography", "works cited", "literature cited", "literatur", "références", "referencias"]


def is_references_heading(line: Column) -> Column:
    bare = F.lower(F.trim(F.regexp_replace(line, r"^[\d.\sIVX]+(?=\p{L})|[.:\s]+$", "")))
    return bare.isin(*HEADINGS)


def year_of(raw: Column) -> Column:
    """The printed year: in brackets if there is one there, else the last one of four digits; null without."""
    bracketed = F.regexp_extract(raw, r"[(\[]((?:1[4-9]|20|21)\d\d)[a-z]?[)\]]", 1)
    all_ = F.regexp_extract_all(raw, F.lit(r"(?<![\d.:/-])((?:1[4-9]|20|21)\d\d)(?![\d/:-])"), F.lit(1))
    return F.coalesce(F.nullif(bracketed, F.lit("")), F.try_element_at(all_, F.lit(-1))).try_cast("int")


def doi_of(raw: Column) -> Column:
    """The reference's DOI if it prints exactly one, also where it is broken across lines after a slash."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.regexp_replace(raw, r"/\s+", "/")), F.lit(f"({DOI})"), F.lit(1)), trim_punctuation))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def arxiv_of(raw: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(raw), F.lit(r"arxiv[:\s./a-z]*?(\d{4}\.\d{4,5})"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def title_of(raw: Column) -> Column:
    """The title: in quotation marks, or the part after a bracketed year, or the longest part between full stops."""
    t = clean(raw)
    quoted = F.regexp_extract(t, "[“\"]([^”\"]{8,})[”\"]", 1)
    after = F.regexp_extract(t, r"\((?:\d{4}[a-z]?|n\.d\.)\)[.,:]? (.{8,}?)\. (?=\p{Lu})", 1)
    parts = F.split(t, r"(?<=\p{L}{3})[.,] ")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(after, F.lit("")), longest)


def parse_fields(raw: Column) -> Column:
    """struct(title, year, doi, arxiv) of a printed reference, each null where it can't be told."""
    return F.struct(title_of(raw).alias("title"), year_of(raw).alias("year"), doi_of(raw).alias("doi"), arxiv_of(raw).alias("arxiv"))


def range_tail(label: Column) -> Column:
    """What a range stands for beyond its first number: 1–3 gives 2, 3; none for single numbers and spans over 20."""
    a, b = (F.nullif(F.regexp_extract(label, r"^\s*(\d+)\s*[-–]\s*(\d+)\s*$", k), F.lit("")).try_cast("int") for k in (1, 2))
    return F.when((b > a) & (b - a <= 20), F.sequence(a + 1, F.greatest(b, a + 1))).otherwise(F.expr("cast(array() as array<int>)"))


def has_dot_leader(line: Column) -> Column:
    return line.rlike(r"(\.\s?){4,}\s*\d+\s*$")


def is_equation_label(line: Column) -> Column:
    return F.trim(line).rlike(r"^\((?:[A-Z]\.?)?\d{1,3}(?:\.\d{1,3})?[a-z]?\)$")


def looks_like_heading(line: Column) -> Column:
    """A short line that starts with a capital or a number, ends without punctuation and isn't mostly digits."""
    t = F.trim(line)
    return (F.length(t).between(3, 90)) & t.rlike(r"^(\d+(\.\d+)*\.?\s+)?\p{Lu}") & ~t.rlike(r"[.,;:!?]$") & (F.size(F.split(t, r"\s+")) <= 12) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) * 2 > F.length(t))


def is_meaningful_sentence(sentence: Column) -> Column:
    """At least seven words and not a citation."""
    return (F.size(F.split(F.trim(sentence), r"\s+")) >= 7) & ~sentence.rlike(r"(?i)^\s*\[?\d+\]|\bet al\.,? \(?\d{4}|\bpp?\. \d")


def subsequence_score(needle: Column, hay: Column) -> Column:
    """Fuzzy score of needle as a subsequence of hay: a point per letter, two more where it follows its predecessor or starts a word; null if it isn't one."""
    n, h = F.lower(needle), F.lower(hay)
    steps = F.when(F.length(n) > 0, F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.substr(n, i, F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)"))

    def step(acc: Column, c: Column) -> Column:
        at = F.position(c, h, F.coalesce(acc["at"], F.lit(0)) + 1)
        start = (at == 1) | F.substr(h, at - 1, F.lit(1)).rlike(r"[^\p{L}\p{N}]")
        bonus = F.when((acc["at"] > 0) & (at == acc["at"] + 1), 2).when(start, 2).otherwise(0)
        miss = acc["at"].isNull() | (at == 0)
        return F.struct(F.when(~miss, at).alias("at"), F.when(~miss, acc["score"] + 1 + bonus).alias("score"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("score")), step, lambda acc: acc["score"])
