"""Title keys: one spelling for titles that differ in presentation only. Runs on Arrow batches, as Spark has no Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Commands that stand for a sign, besides the Greek letters, which are looked up by their names.
SIGNS = {
    "ell": "ℓ", "imath": "i", "jmath": "j", "times": "×", "cdot": "·", "pm": "±", "mp": "∓", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "infty": "∞", "partial": "∂", "nabla": "∇",
    "sum": "∑", "prod": "∏", "int": "∫", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "rightarrow": "→", "to": "→", "leftarrow": "←", "leftrightarrow": "↔", "ldots": "…", "dots": "…",
    "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł",
}
# Commands that only change how their argument looks, and accents written as letters.
PRESENTATION = set("emph textit textbf textrm textsf texttt textsc textnormal text mathrm mathbf mathit mathsf mathtt mathcal mathbb mathfrak boldsymbol bm rm bf it sf tt sc em mbox left right big displaystyle operatorname c v u H k r b d t".split())
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
COMMAND = re.compile(r"\\(?:([A-Za-z]+)(\s*)|(.)|$)", re.DOTALL)
# Signs that separate words and leave nothing.
SEPARATORS = set(".,:;!?'\"-…‘’‚‛“”„‟«»‹›‐‑‒–—―")
DROPPED = set("\u00ad\u200b\ufeff")


def _named(command: str) -> str | None:
    """What a command stands for; "" for one that only changes looks, None for an unknown one."""
    if command in SIGNS:
        return SIGNS[command]
    if command in PRESENTATION:
        return ""
    name = command.removeprefix("var").lower() if command.startswith("var") else command
    if name.lower() in GREEK and (name.islower() or name.istitle()):
        return unicodedata.lookup(f"GREEK {'SMALL' if name.islower() else 'CAPITAL'} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")
    return None


def decode_latex(title: str) -> str:
    """Known commands as the signs they stand for, presentation without its braces; unknown commands keep their name and arguments."""
    if not any(c in title for c in "\\${}~^_"):
        return title

    def command(m: re.Match) -> str:
        name, gap, sign = m[1], m[2], m[3]
        if name is None:
            if sign is None:
                return "\\"
            return "" if sign in "'\"`^~=.!()[]" else " " if sign in "\\ ,;:" else sign if sign in "&%#" else {"$": "\ue000", "{": "\ue001", "}": "\ue002", "_": "\ue004"}.get(sign, "\\" + sign)
        found = _named(name)
        if found is None:
            return f"\ue003{name} "
        return found + (" " if gap and found else "")

    text = COMMAND.sub(command, title)
    # arguments of unknown commands keep their braces, as their bounds may mean something
    text = re.sub("\ue003([A-Za-z]+) ((?:\\{[^{}]*\\}\\s*)+)", lambda m: f"\ue003{m[1]} " + m[2].replace("{", " \ue001 ").replace("}", " \ue002 "), text)
    text = re.sub(r"([\^_])\s*(?:\{([^{}]*)\}|(\S))", lambda m: f"{m[1]}\ue001{m[2] if m[2] is not None else m[3]}\ue002", text)
    if text.count("$") % 2:  # an unmatched dollar is currency
        head, _, tail = text.rpartition("$")
        text = head + "\ue000" + tail
    text = re.sub(r"\$\$?([^$]*)\$\$?", lambda m: m[1].replace("-", "−"), text)
    text = text.replace("{", "").replace("}", "").replace("~", " ")
    return text.translate({0xE000: "$", 0xE001: "{", 0xE002: "}", 0xE003: "\\", 0xE004: "_"})


def title_key(title: str | None) -> str | None:
    """Lower-case words with one blank between them; accents dropped, signs other than separators are words of their own.

    ≠ stays apart from =; ß is ss and ς is σ; soft hyphens, zero-width blanks and byte-order marks are dropped. Null for null.
    """
    if title is None:
        return None
    out: list[str] = []
    base = command = False
    for c in unicodedata.normalize("NFKD", decode_latex(title)):
        if command and c.isascii() and c.isalpha():
            out.append(c)
            continue
        command = False
        if unicodedata.category(c)[0] == "M":
            if base and c != "\u0338":
                continue
        else:
            base = c.isalpha()
        for x in c.lower():
            if x in DROPPED:
                continue
            if x == "\\":
                out.append(" \\")
                command = True
            elif x.isspace() or unicodedata.category(x) == "Cc" or x in SEPARATORS:
                out.append(" ")
            elif x.isalnum():
                out.append({"ß": "ss", "ς": "σ"}.get(x, x))
            else:
                out.append(f" {x} ")
    return " ".join("".join(out).split())


@F.pandas_udf(StringType())
def _title_key(text: pd.Series) -> pd.Series:
    return text.map(title_key, na_action="ignore")


def key_of(title: Column) -> Column:
    """title_key of a column; plain ASCII titles are keyed in the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(title), "[\\s.,:;!?'\"-]+", " "))
    return F.when(title.rlike("^[A-Za-z0-9\\s.,:;!?'\"-]*$"), plain).otherwise(_title_key(title))
