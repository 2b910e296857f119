"""Problem 2: visually identical text with different characters.

Method: a confusables skeleton. Text is decomposed, every character is replaced by its prototype from the look-alike
table, and the result is decomposed again; texts of equal skeleton look alike and form a group. The table is the public
one of confusable characters, read from the Unicode library on Spark's own class path, with the fixed pairs of
lookalike.py put into one class. The form of a text is the member of its group that takes every prototype in the script
of the word it stands in, composed; a text has to change if it is another member of that group.

Python runs only on texts with a character that could change; the rest is decided by one pattern in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lookalike import INVISIBLE, LATIN_CYRILLIC, LATIN_GREEK

#: Texts of only these characters are in the one form: printable ASCII, line ends, composed Latin letters but those of two in one (ij, 'n, dz, lj, nj), common punctuation.
PLAIN = "[\\x20-\\x7E\\n\u00a1-\u00ac\u00ae-\u0131\u0134-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u02af\u2013-\u201d\u2026]*"
# Blocks whose viramas join letters, for joiners that spelling needs.
VIRAMAS = set("्্੍્୍்్್്්္្꧀")
# Greek letters drawn like Latin ones that also serve as symbols; they are letters only inside a longer word.
SYMBOL_GREEK = set("νιυρκϳ")
#: Alphabets besides Latin, Cyrillic and Greek whose letters are put right in words of another script, by their Unicode name.
ALPHABETS = frozenset(["ARMENIAN", "CHEROKEE", "COPTIC", "GEORGIAN", "LISU"])


@cache
def _maps() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(to Latin, to Cyrillic, to Greek), each from the look-alikes of the other scripts."""
    latin = {b: a for a, b in LATIN_CYRILLIC} | {b: a for a, b in LATIN_GREEK}
    cyrillic = {a: b for a, b in LATIN_CYRILLIC}
    greek = {a: b for a, b in LATIN_GREEK}
    by_latin = dict(cyrillic)
    cyrillic |= {g: by_latin[a] for a, g in LATIN_GREEK if a in by_latin}
    greek |= {c: greek[a] for a, c in LATIN_CYRILLIC if a in greek}
    return latin, cyrillic, greek


@cache
def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800:
        return "" if o in (0xAA, 0xBA, 0xB5) else "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "C"
    name = unicodedata.name(c, "").split(" ")[0]
    return name if name in ALPHABETS else "other"


@cache
def invisible(c: str) -> bool:
    o = ord(c)
    return any(a <= o <= b for a, b in INVISIBLE) or unicodedata.category(c) == "Cf" or 0xE0000 <= o < 0xE0200 or (unicodedata.category(c) == "Cc" and c not in "\n\r\t\v\f\x1c\x1d\x1e\x1f\x85")


@cache
def plain(c: str) -> str:
    """One character by itself: plain width, letters apart, plain space; invisible ones are left to one_form."""
    if c == "\n":
        return c
    o, kind = ord(c), unicodedata.category(c)
    if c.isspace() or kind in ("Zs", "Zl", "Zp"):
        return "\n" if c in "\r\v\f\x85\u2028\u2029" else " "
    if 0xFF01 <= o <= 0xFFEF:
        return unicodedata.normalize("NFKC", c) if kind[0] in "LNM" else c
    if kind[0] == "L" and (0xFB00 <= o <= 0xFDFF or 0xFE70 <= o <= 0xFEFC or o in (0x132, 0x133, 0x149, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3)):
        return unicodedata.normalize("NFKC", c)
    return c


def _joiner(text: str, i: int) -> bool:
    """Whether the joiner at i is one that Indic spelling or a joined picture needs."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if before in VIRAMAS and before:
        return bool(after) and unicodedata.category(after)[0] in "LM" or after == ""
    if after in VIRAMAS and after and before:
        return unicodedata.category(before) == "Lo"
    return text[i] == "\u200d" and bool(before and after) and unicodedata.category(after) == "So" and (unicodedata.category(before) in ("So", "Sk") or before == "\ufe0f")


WORD = re.compile(r"[^\W_]+")


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Each character and its prototype, by the Unicode library of Spark's class path; bounded by the number of characters.

    An error where the session has no JVM of its own or the library fails: without the table most look-alikes would
    silently stay as they are.
    """
    chars = [chr(o) for o in [*range(0x20, 0xD800), *range(0xF900, 0x20000)] if unicodedata.category(chr(o))[0] in "LNPS"]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton("\n".join(chars)).split("\n")
    except Exception as e:
        raise RuntimeError("the table of confusable characters can't be read: a session with a JVM of its own and ICU4J (com.ibm.icu.text.SpoofChecker) on its class path is needed") from e
    if len(found) != len(chars):
        raise RuntimeError(f"the table of confusable characters can't be read: {len(found)} prototypes for {len(chars)} characters")
    table = {c: p for c, p in zip(chars, found, strict=True) if p != unicodedata.normalize("NFD", c)}
    if not table:
        raise RuntimeError("the table of confusable characters is empty")
    return table


class Alike:
    """Skeletons and forms by one table of prototypes."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = dict(table)
        for a, b in [*LATIN_CYRILLIC, *LATIN_GREEK]:  # one class each, whatever the table says
            self.table[b] = unicodedata.normalize("NFD", "".join(self.table.get(c, c) for c in unicodedata.normalize("NFD", a)))
        self.letters: dict[tuple[str, str, str], str] = {}
        for c in sorted([*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *(c for c in self.table if len(c) == 1)], key=lambda c: (not c.isascii(), c)):
            self.letters.setdefault((_script(c), unicodedata.category(c), self.table.get(c, c)), c)

    def skeleton(self, text: str) -> str:
        """Decomposed, each character replaced by its prototype, decomposed again; equal for texts that look alike."""
        out = "".join(plain(c) for c in unicodedata.normalize("NFD", text.replace("\r\n", "\n")) if not invisible(c))
        return unicodedata.normalize("NFD", "".join(self.table.get(c, c) for c in unicodedata.normalize("NFD", out)))

    def in_script(self, c: str, own: str, script: str) -> str:
        """The letter of a script that looks like c, or c."""
        if {own, script} <= set("LCG"):
            return dict(zip("LCG", _maps(), strict=True))[script].get(c, c)
        return self.letters.get((script, unicodedata.category(c), self.table.get(c, c)), c)

    def word(self, m: re.Match) -> str:
        """A word in the script that most of its letters can only be of; runs of letters of scripts without look-alikes divide it."""
        w = m[0]
        if w.isascii():
            return w
        scripts = [_script(c) for c in w]
        if "other" in scripts:
            out, at = [], 0
            for i in range(len(w) + 1):
                if i == len(w) or (scripts[i] == "other") != (scripts[at] == "other"):
                    out.append(w[at:i] if scripts[at] == "other" else self.run(w[at:i], scripts[at:i]))
                    at = i
            return "".join(out)
        return self.run(w, scripts)

    def run(self, w: str, scripts: list[str]) -> str:
        count = {s: scripts.count(s) for s in dict.fromkeys([*"LCG", *(s for s in scripts if s)])}
        if sum(1 for n in count.values() if n) < 2:
            return w
        latin, cyrillic, _ = _maps()
        shared = lambda c, s: c in cyrillic if s == "L" else c in latin if s in "CG" else self.in_script(c, s, "L") != c
        best = max(count, key=lambda s: (sum(1 for c, own in zip(w, scripts, strict=True) if own == s and not shared(c, s)), count[s], s == "L"))
        few = count["L"] + count["C"] < 3
        return "".join(self.in_script(c, own, best) if own and own != best and not (c in SYMBOL_GREEK and few) else c for c, own in zip(w, scripts, strict=True))

    def one_form(self, text: str) -> str:
        """Composed letters, plain width, letters apart, plain spaces and line ends, nothing invisible, one script per word."""
        if text.isascii() and text.isprintable():
            return text
        form = unicodedata.normalize("NFC", text.replace("\r\n", "\n"))
        if any(invisible(c) for c in set(form)):
            form = "".join(c for i, c in enumerate(form) if not invisible(c) or (c in "\u200c\u200d" and _joiner(form, i)) or (c == "\ufe0f" and i and unicodedata.category(form[i - 1]) == "So"))
        form = unicodedata.normalize("NFC", "".join(map(plain, form)))
        return WORD.sub(self.word, form)

    def member(self, text: str) -> str:
        """The form of the group of equal skeleton that a text belongs to; the text itself if no form is in its group."""
        form = self.one_form(text)
        return form if form == text or self.skeleton(form) == self.skeleton(text) else text


@cache
def _fixed() -> Alike:
    return Alike({})


def one_form(text: str) -> str:
    """Alike.one_form by the fixed pairs."""
    return _fixed().one_form(text)


def skeleton(text: str) -> str:
    """Alike.skeleton by the fixed pairs."""
    return _fixed().skeleton(text)


def _udf(spark: SparkSession, method: str) -> Callable[..., Column]:
    """A method of Alike with the full table, which is sent once to each task's process."""
    sent = spark.sparkContext.broadcast(Alike(prototypes(spark)))

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(getattr(sent.value, method))

    return run


def may_change(text: Column) -> Column:
    return ~text.rlike(f"^{PLAIN}$") | text.rlike("[\u00aa\u00b5\u00ba]")


def changed(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) of the rows whose text isn't in the one form; null texts are in no form, empty ones are."""
    rows = records.where(F.col(text).isNotNull() & may_change(F.col(text))).select(F.col(key).alias("key"), F.col(text).alias("_t"))
    return rows.withColumn("form", _udf(records.sparkSession, "member")("_t")).where("form <> _t").select("key", "form")


def records_of(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """Token texts and passages as (record, record_key, text)."""
    a = tokens.select(F.lit("token").alias("record"), F.col("token_id").cast("string").alias("record_key"), "text")
    return a.unionByName(mentions.select(F.lit("mention").alias("record"), F.col("id").alias("record_key"), F.col("passage").alias("text")))


def found(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """(record, record_key) of the token texts and passages that aren't the form of their group of equal skeleton.

    A key given twice is given back twice only if both rows change. Null and empty texts, and rows without a key, have none.
    """
    rows = records_of(tokens, mentions).where(F.col("text").isNotNull() & F.col("record_key").isNotNull() & may_change(F.col("text")))
    return rows.where(_udf(tokens.sparkSession, "member")("text") != F.col("text")).select("record", "record_key")


def groups(records: DataFrame) -> DataFrame:
    """records(record, record_key, text) -> one row per skeleton: its form, how many records and how many different spellings it has.

    The form is the one form of its most frequent spelling (the smallest of equally frequent ones).
    """
    texts = records.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    texts = texts.withColumn("skeleton", _udf(records.sparkSession, "skeleton")("text"))
    best = texts.groupBy("skeleton").agg(F.sum("n").alias("records"), F.count("*").alias("spellings"), F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("best"))
    return best.select(F.when(may_change(F.col("best.text")), _udf(records.sparkSession, "member")("best.text")).otherwise(F.col("best.text")).alias("form"), "records", "spellings")
