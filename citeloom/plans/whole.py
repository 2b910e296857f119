"""Text functions over whole tables that need Python or a recursion in SQL; also tested against brute force on small tables."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import table
from .catalog import query

# Character references, and letters that decomposing doesn't take apart.
REFERENCE = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6})|(amp|lt|gt|quot|apos|nbsp));")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
APART = str.maketrans({"ı": "i", "ł": "l", "Ł": "L", "ø": "o", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ɡ": "g"})
WORD = r"[\p{IsAlphabetic}\p{N}_]+"


def collapsed(text: Column) -> Column:
    """White space of any script collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trimmed(text: Column) -> Column:
    """Without punctuation and closing brackets that nothing opens at the end, one character at a time."""
    over = lambda t, a, b: t.endswith(b) & (F.length(F.replace(t, F.lit(a), F.lit(""))) > F.length(F.replace(t, F.lit(b), F.lit(""))))
    drop = lambda t: t.rlike("[.,;:\"'<>]$") | over(t, "(", ")") | over(t, "[", "]") | over(t, "{", "}")
    most = F.length(F.regexp_extract(text, "([.,;:\"'<>)\\]}]*)$", 1))
    return F.aggregate(F.sequence(F.lit(0), most), text, lambda t, i: F.when((i > 0) & drop(t), F.left(t, F.length(t) - 1)).otherwise(t))


def decoded(text: str) -> str:
    """Character references decoded once; those of no character or a control character are dropped."""

    def one(m: re.Match) -> str:
        if m[3]:
            return NAMED[m[3]]
        code = int(m[1]) if m[1] else int(m[2], 16)
        return "" if code > 0x10FFFF or 0xD800 <= code < 0xE000 or unicodedata.category(chr(code)) == "Cc" else chr(code)

    return REFERENCE.sub(one, text)


def folded(text: str) -> str:
    """Letters a to z and digits of the decomposed text."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "", t.translate(APART).lower())


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(decoded, na_action="ignore")


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(folded, na_action="ignore")


def marker_parts(label: Column) -> Column:
    """The parts of a numeric marker without its brackets."""
    inner = F.regexp_replace(label, r"^(?U)[\s\[(]+|[\s\])]+$", "")
    return F.filter(F.transform(F.split(inner, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")


def _range(part: Column) -> tuple[Column, Column, Column]:
    """(whether a part is a range, its ends)."""
    pattern = r"^(\d+)\s*[-–−]\s*(\d+)$"
    return part.rlike(pattern), F.regexp_extract(part, pattern, 1).try_cast("int"), F.regexp_extract(part, pattern, 2).try_cast("int")


def _expands(part: Column) -> Column:
    is_range, a, b = _range(part)
    return is_range & F.coalesce((b >= a) & (b - a <= 30), F.lit(False))


def expanded_keys(parts: Column) -> Column:
    """All numbers of the parts, ranges of at most 30 expanded."""

    def one(p: Column) -> Column:
        _, a, b = _range(p)
        plain = F.transform(F.regexp_extract_all(p, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int"))
        return F.when(_expands(p), F.sequence(a, F.greatest(a, b))).when(_range(p)[0], F.expr("cast(array() as array<int>)")).otherwise(plain)

    return F.array_distinct(F.flatten(F.transform(parts, one)))


_OVER = " or ".join(f"(ends_with(t, '{b}') and length(replace(t, '{a}', '')) > length(replace(t, '{b}', '')))" for a, b in ("()", "[]", "{}"))


@query(f"with recursive r as (select id, raw_text as t from bibliography_entry where raw_text is not null union all select id, substr(t, 1, length(t) - 1) from r where regexp_matches(t, '[.,;:\"''<>]$') or {_OVER}) select id, arg_min(t, length(t)) as trimmed from r group by id")
def f08_trim_trailing_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bibliography_entry").where("raw_text is not null").select("id", trimmed(F.col("raw_text")).alias("trimmed"))


_DECODED = "regexp_replace(text, '<[^>]*>', ' ', 'g')"
for _a, _b in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
    _DECODED = f"replace({_DECODED}, '&{_a};', '{_b}')"


@query(rf"select doc_id, trim(regexp_replace({_DECODED}, '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]+', ' ', 'g')) as plain from documents where text is not null and source = 'landing_page'")
def f47_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """Landing pages without tags, references decoded once; numeric references of characters stand in the tests only."""
    rows = table(spark, d, "documents").where("text is not null and source = 'landing_page'")
    return rows.select("doc_id", collapsed(_decoded(F.regexp_replace("text", "<[^>]*>", " "))).alias("plain"))
