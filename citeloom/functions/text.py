"""Text, identifier and URL functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier shapes, resolver prefixes and markers.
DOI = r"10\.[0-9]{4,9}/[^\s\"<>]+"
DOI_PREFIX = r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*"
ARXIV_NEW, ARXIV_OLD = r"[0-9]{4}\.[0-9]{4,5}", r"[a-z-]+(\.[a-z]{2})?/[0-9]{7}"
ARXIV_PREFIX = r"^(https?://)?arxiv\.org/(abs|pdf)/|^arxiv:\s*"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
LIGATURES = [("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")]


def clean(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trim_punctuation(text: Column) -> Column:
    """Without punctuation at the end, and without a closing bracket there that nothing opens."""
    t = F.regexp_replace(text, r"[.,;:\"'<>]+$", "")
    return F.when(t.endswith(")") & ~t.contains("("), F.regexp_replace(t, r"[).,;:]+$", "")).otherwise(t)


def normalize_doi(text: Column) -> Column:
    """Lower case without resolver; null if it has no DOI's shape."""
    t = trim_punctuation(F.regexp_replace(F.lower(F.trim(text)), DOI_PREFIX, ""))
    return F.when(t.rlike(f"^{DOI}$"), t)


def normalize_arxiv(text: Column) -> Column:
    """Lower case without marker and version; null if invalid."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), ARXIV_PREFIX, ""), r"(v[0-9]+)?(\.pdf)?$", "")
    return F.when(t.rlike(f"^({ARXIV_NEW}|{ARXIV_OLD})$"), t)


def all_dois(text: Column) -> Column:
    """Distinct DOIs in the order they are first seen."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({DOI})"), F.lit(1)), trim_punctuation))


def only(values: Column) -> Column:
    """The value, if there is exactly one."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def decode_entities(text: Column) -> Column:
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_markup(text: Column) -> Column:
    return clean(decode_entities(F.regexp_replace(text, r"<[^>]*>", " ")))


def expand_ligatures(text: Column) -> Column:
    for a, b in LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def compact(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(expand_ligatures(text)), r"[^\p{L}\p{N}]", "")


def title_key_ascii(text: Column) -> Column:
    """Lower-case words with one blank between them; other signs become words of their own. Exact for ASCII titles."""
    t = F.regexp_replace(F.lower(text), r"[\s\p{Pd}:;,.!?'\"()\[\]/_]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([^a-z0-9 ])", " $1 "), r" +", " "))


def leading_year(text: Column) -> Column:
    """Four digits (a letter may follow) at the start, between 1400 and 2200."""
    y = F.regexp_extract(F.trim(text), r"^([0-9]{4})[a-z]?\b", 1).try_cast("int")
    return F.when(y.between(1400, 2200), y)


def family_name(author: Column) -> Column:
    """The last word of the first comma-separated part, in lower case."""
    return F.lower(F.element_at(F.split(F.trim(F.substring_index(author, ",", 1)), r"\s+"), -1))


def without_truncation(author: Column) -> Column:
    return F.trim(F.regexp_replace(author, r"(?i)[,\s]*(et al\.?|and others|others)\s*$", ""))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, cut at the last blank before and ended with an ellipsis."""
    head = F.left(text, F.lit(n - 1))
    at_blank = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.when(head.rlike(r"\s"), at_blank).otherwise(head)), F.lit("…")))


def escape_markdown(text: Column) -> Column:
    t = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(t, r"([\\*_\[\]])", r"\\$1")


def citation_keys(label: Column) -> Column:
    """The numbers of a numeric marker, ranges of at most 30 expanded: [1, 3–5] gives 1, 3, 4, 5."""
    parts = F.regexp_extract_all(label, F.lit(r"(\d+(?:\s*[-–]\s*\d+)?)"), F.lit(1))

    def expand(p: Column) -> Column:
        a = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
        b = F.coalesce(F.nullif(F.regexp_extract(p, r"[-–]\s*(\d+)$", 1), F.lit("")).try_cast("int"), a)
        return F.when((b >= a) & (b - a <= 30), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def color(text: Column) -> Column:
    """#rgb or #rrggbb as lower-case #rrggbb; null otherwise."""
    t = F.lower(F.trim(text))
    long = F.concat(F.lit("#"), *(F.repeat(F.substr(t, F.lit(i), F.lit(1)), F.lit(2)) for i in (2, 3, 4)))
    return F.when(t.rlike("^#[0-9a-f]{6}$"), t).when(t.rlike("^#[0-9a-f]{3}$"), long)
