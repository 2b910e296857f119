"""Fixed character values shared by the text operators, and same-length foldings made of them."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of two alphabets that are drawn alike (Latin, Cyrillic; Latin, Greek).
LATIN_CYRILLIC = [
    ("A", "А"), ("B", "В"), ("C", "С"), ("E", "Е"), ("H", "Н"), ("I", "І"), ("J", "Ј"), ("K", "К"), ("M", "М"), ("O", "О"), ("P", "Р"), ("S", "Ѕ"), ("T", "Т"),
    ("X", "Х"), ("Y", "У"), ("a", "а"), ("c", "с"), ("d", "ԁ"), ("e", "е"), ("h", "һ"), ("i", "і"), ("j", "ј"), ("o", "о"), ("p", "р"), ("q", "ԛ"), ("s", "ѕ"),
    ("w", "ԝ"), ("x", "х"), ("y", "у"), ("l", "ӏ"), ("ï", "ї"), ("ë", "ё"), ("Ë", "Ё"), ("Ï", "Ї"), ("G", "Ԍ"), ("Q", "Ԛ"), ("W", "Ԝ"),
]
LATIN_GREEK = [
    ("A", "Α"), ("B", "Β"), ("E", "Ε"), ("Z", "Ζ"), ("H", "Η"), ("I", "Ι"), ("K", "Κ"), ("M", "Μ"), ("N", "Ν"), ("O", "Ο"), ("P", "Ρ"), ("T", "Τ"), ("Y", "Υ"),
    ("X", "Χ"), ("o", "ο"), ("v", "ν"), ("i", "ι"), ("u", "υ"), ("p", "ρ"), ("j", "ϳ"), ("k", "κ"),
]
# Code points that show nothing, as ranges (general category Cf is added to them).
INVISIBLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0)]
INVISIBLE_CLASS = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE)


@cache
def fold_table() -> tuple[str, str]:
    """Characters and what each is compared as, one for one: plain width, base letter, Latin for a look-alike.

    Built from the Unicode decompositions of the Latin blocks and the full-width block and from the fixed lists above.
    """
    out: dict[str, str] = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c:
            out[c] = d
    for a, b in LATIN_CYRILLIC + LATIN_GREEK:
        base = unicodedata.normalize("NFKD", a)[0]
        out[b] = base
    out |= {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "\u2019": "'", "\u02bc": "'"} | {chr(c): " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    return "".join(out), "".join(out.values())


def fold(text: Column) -> Column:
    """Look-alikes, accents and width folded one for one, so that offsets stay."""
    return F.translate(text, *fold_table())


def words(text: Column) -> Column:
    """Lower-case words of folded text, without marks and invisible characters; a divided word at a line's end is joined."""
    t = F.lower(F.when(text.rlike("[^\\x00-\\x7F]"), fold(text)).otherwise(text))
    t = F.when(t.rlike("[ﬀ-ﬆ]"), F.replace(F.replace(F.replace(F.replace(F.replace(t, F.lit("ﬃ"), F.lit("ffi")), F.lit("ﬄ"), F.lit("ffl")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))).otherwise(t)
    t = F.when(t.rlike(f"[\\p{{M}}{INVISIBLE_CLASS}¬‐]"), F.regexp_replace(F.regexp_replace(t, r"[-‐¬­]\n\s*", ""), f"[\\p{{M}}{INVISIBLE_CLASS}¬]", "")).otherwise(F.regexp_replace(t, r"-\n\s*", ""))
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


_DIVIDED = re.compile("[-\u2010\u00ac\u00ad]\n\\s*")
_RUN = re.compile(r"[^\W_]+")
_OTHER = re.compile("[^\x00-\x7f]+")


@cache
def _letters() -> dict[int, str | None]:
    """fold_table() as a table of str.translate, with ligatures apart and without marks and invisible characters."""
    table: dict[int, str | None] = dict(zip(map(ord, fold_table()[0]), fold_table()[1], strict=True))
    table |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB05)}
    table |= {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"}
    return table | {c: None for a, b in INVISIBLE for c in range(a, b + 1)} | {0xAC: None}


@lru_cache(maxsize=1 << 16)
def _folded(run: str) -> str:
    return run.translate(_letters())


def words_of(text: str) -> list[str]:
    """words() of one string: lower case, look-alikes, accents and width folded, divided words joined."""
    if "\n" in text:
        text = _DIVIDED.sub("", text)
    return _RUN.findall((text if text.isascii() else _OTHER.sub(lambda m: _folded(m[0]), text)).lower())
