"""Printed references: where entries, authors, titles and venues begin and end. Python on single strings, for Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .titlekey import title_key

# Family-name particles, signs of a cut list, words of a name at most.
PARTICLES = ["van", "von", "de", "del", "della", "da", "dos", "das", "la", "der", "den"]
CUT = re.compile(r"(?:^|(?<=[,\s]))(?:and others|et al|others)[.,\s]*$", re.IGNORECASE)
MAX_WORDS = 6
YEAR = re.compile(r"\b(?:1[4-9]|20|21)\d\d[a-z]?\b")
LABEL = re.compile(r"\s*(?:\[([^\]\n]{1,24})\]|\((\d{1,4})\)|(\d{1,4})\.(?=\s))\s*")
NO_TITLE = re.compile(r"(?i)^(?:doi\s*:|https?://|arxiv\s*:)")
IDENTIFIER = re.compile(r"(?i)\b(?:doi\s*:|https?://|arxiv\s*:)|\b(?:18|19|20)\d{2}[a-z]?\b")
INITIALS = re.compile(r"(?:[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][.\s-]*)+")
QUOTES = {'"': '"', "“": "”", "‘": "’"}


def first_author_family(raw: str) -> str | None:
    """The last word of what stands before the first separator of a free author list, without full stops; None without a letter."""
    head = re.split(r",| and |&| et al|;", raw, maxsplit=1)[0].split()
    family = head[-1].rstrip(".") if head else ""
    return family if any(map(str.isalpha, family)) else None


def citation_family(author: str) -> str | None:
    """What stands before a comma, else the last word with the particles before it; None with digits, without letters, or in over six words."""
    author = author.strip()
    words = author.split()
    if "," in author:
        family = author.split(",", 1)[0].strip()
    elif words:
        k = len(words) - 1
        while k and words[k - 1] in PARTICLES:
            k -= 1
        family = " ".join(words[k:]).rstrip(".")
    else:
        return None
    bad = len(words) > MAX_WORDS or re.search(r"[0-9]", family) or not any(map(str.isalpha, family))
    return None if bad else family


def looks_like_person_name(author: str) -> bool:
    a = author.rstrip(".")
    return ":" not in a and "/" not in a and citation_family(a) is not None


def strip_truncation(author: str) -> tuple[str, bool]:
    """An author without "et al." and the like at the end, and whether there was one."""
    text, cut = author.strip(), False
    while m := CUT.search(text):
        text, cut = text[: m.start()].rstrip(", \t\n\r"), True
    return text, cut


def author_list_key(authors: Iterable[str]) -> tuple[list[str], bool]:
    """Keys of the family names in order, and whether the list is cut."""
    found = [strip_truncation(a) for a in authors]
    return [title_key(citation_family(n) or n) for n, _ in found if n], any(c for _, c in found)


def authors_agree(a: Iterable[str], b: Iterable[str]) -> bool:
    """Whether two lists name the same families in order, or a cut one is the start of the other; not transitive."""
    (x, cut_x), (y, cut_y) = author_list_key(a), author_list_key(b)
    if not x or not y:
        return False
    return x == y or (cut_x and y[: len(x)] == x) or (cut_y and x[: len(y)] == y)


def sentence_boundary(text: str) -> int | None:
    """Place of the first full stop that ends a part: not that of an initial, of a dotted or hyphenated word, or of et al."""
    for m in re.finditer(r"\.(?=\s)", text):
        before = text[: m.start()]
        last = re.split(r"[\s,]", before)[-1]
        lettered = all(c.isalpha() or c in "-." for c in last)
        if lettered and (sum(map(str.isalpha, last)) == 1 or "." in last or "-" in last):
            continue
        if last == "al" and before.endswith("et al"):
            continue
        return m.start()
    return None


def author_year_prefix(text: str) -> tuple[int, int] | None:
    """(end of the authors, end of the year with its bracket) of a text that starts with authors and a year."""
    m = YEAR.search(text)
    if not m:
        return None
    before = text[: m.start()].rstrip()
    start = len(before) - 1 if before.endswith(("(", "[")) else m.start()
    authors = text[:start].strip()
    if start >= 250 or not authors[:1].isalpha() or "/" in authors or ":" in authors or sentence_boundary(authors) is not None:
        return None
    return start, m.end() + text[m.end() :].startswith((")", "]"))


def split_authors(text: str) -> list[str]:
    """Authors of a printed list: divided at semicolons, and, &; at commas too, but initials stay with the name before them."""
    out: list[str] = []
    for item in re.split(r"\s+(?:and|&)\s+|\s*;\s*", text.strip().rstrip(",;")):
        named = False  # the last author of this item can take initials
        for part in filter(None, (p.strip() for p in item.split(","))):
            if named and INITIALS.fullmatch(part):
                out[-1] += f", {part}"
                named = False
            else:
                out.append(part)
                named = True
    return out


def _trimmed(text: str) -> str | None:
    return re.sub(r"^[\s.,;:]+|[\s.,;:]+$", "", text) or None


def clean_venue(text: str) -> str | None:
    """What stands before an identifier or a year, without open brackets."""
    m = IDENTIFIER.search(text)
    return _trimmed((text[: m.start()] if m else text).rstrip(" \t\n\r(["))


def title_venue(text: str) -> tuple[str | None, str | None]:
    """Title (quoted, or up to the first full stop, question or exclamation mark) and venue of what follows the authors."""
    if not text:
        return None, None
    close = QUOTES.get(text[0])
    if close and (end := text.find(close, 1)) > 0:
        return _trimmed(text[1:end]), clean_venue(text[end + 1 :])
    stop = sentence_boundary(text)
    stop = len(text) if stop is None else stop
    ask = re.search(r"[?!](?=\s|$)", text)
    end, rest = (ask.end(), text[ask.end() :]) if ask and ask.start() < stop else (stop, text[stop + 1 :])
    title = text[:end]
    if not any(map(str.isalpha, title)) or NO_TITLE.match(title):
        return None, None
    return _trimmed(title), clean_venue(rest)


def read_doi(raw: str) -> str | None:
    """The DOI at the start of a text, joined over line ends where a slash, hyphen or digit shows that it goes on."""
    out = ""
    lines = re.split(r"[ \t]*[\r\n]+[ \t\r\n]*", raw)
    for k, line in enumerate(lines):
        token = re.match(r"[^\s\"“”<>]*", line)[0]
        out += token
        if len(token) < len(line) or k + 1 == len(lines) or out.endswith((".", ",", ";")):
            break
        after = lines[k + 1]
        if not out.endswith(("/", "-", "_")) and not re.match(r"\d", after):
            if len(after.split()) == 1:  # a bare word: it can't be told whether it belongs
                return None
            break
    while out and (out[-1] in ".,;:'" or out[-1] in ")]}" and out.count(out[-1]) > out.count({")": "(", "]": "[", "}": "{"}[out[-1]])):
        out = out[:-1]
    return out if re.fullmatch(r"(?i)10\.\d{4,9}/\S+", out) else None


def extract_doi(raw: str) -> str | None:
    """The DOI of a reference that prints exactly one."""
    found = {d for m in re.finditer(r"(?i)\b10\.\d{4,9}/", raw) if (d := read_doi(raw[m.start() :]))}
    return found.pop() if len(found) == 1 else None


def extract_arxiv(raw: str) -> str | None:
    found = {m[1] or m[2] for m in re.finditer(r"(?i)arxiv\s*[:.]?\s*(?:org/(?:abs|pdf)/)?(?:(\d{4}\.\d{4,5}(?:v\d+)?)|([a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?))", raw)}
    return found.pop() if len(found) == 1 else None


def parse_fields(raw: str) -> dict:
    """printed_key, authors, title, year, venue, doi, arxiv_id of a printed reference; None where it can't be told."""
    label = LABEL.match(raw)
    text = " ".join(raw[label.end() if label else 0 :].split())
    year = next((m[0] for m in YEAR.finditer(text) if not re.search(r"[/:]", (w := re.split(r"\s", text[: m.start()])[-1])) and not w.endswith(".")), None)
    if span := author_year_prefix(text):
        authors, rest = text[: span[0]], text[span[1] :]
    elif (stop := sentence_boundary(text)) is not None:
        authors, rest = text[:stop], text[stop + 1 :]
    else:
        authors, rest = "", text
    title, venue = title_venue(rest.lstrip(" .,;:"))
    return {
        "printed_key": next((g for g in label.groups() if g), None) if label else None, "authors": (split_authors(authors) or None) if authors.strip(" ,;") else None,
        "title": title, "year": year, "venue": venue, "doi": extract_doi(raw), "arxiv_id": extract_arxiv(raw),
    }


def split_entries(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, printed key) of the entries of a list of references.

    A label at a line's start opens an entry; a year with a full stop does only where the number before is one less. In a
    list without labels an entry opens at each line that starts with authors and a year.
    """
    starts: list[tuple[int, str | None]] = []
    last = None
    for m in re.finditer(r"(?m)^", text):
        label = LABEL.match(text, m.start())
        if not label or "\n" in text[label.start() : label.end()].lstrip("\n"):
            continue
        key = next(g for g in label.groups() if g)
        number = int(key) if key.isdigit() else None
        if label[3] and YEAR.fullmatch(key) and last != number - 1:
            continue
        last = number if label[3] else None
        starts.append((m.start(), key))
    if not starts:
        at = 0
        for line in text.splitlines(keepends=True):
            if line.strip() and (not starts or author_year_prefix(line)):
                starts.append((at, None))
            at += len(line)
    ends = [s for s, _ in starts[1:]] + [len(text)] * bool(starts)
    return [(s, s + len(text[s:e].rstrip()), k) for (s, k), e in zip(starts, ends, strict=True)]
