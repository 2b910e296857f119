"""Problem 1: sentence boundaries across languages and scripts.

Method: stops that end no sentence (decimals, URLs, initials, abbreviations, ordinals, stops inside a quotation that the
sentence goes on after) are masked with private-use characters, one for one; the terminators of the script then divide
the text, and the masks are taken back. Every step is a SQL expression on one row, so there is no shuffle, and as every
replacement keeps the length, offsets into the masked text are offsets into the original.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import INVISIBLE_CLASS, fold_table

# Abbreviations that never end a sentence.
NEVER = {
    "en": "dr prof mr mrs ms st gov sen rep rev gen col capt lt hon messrs mt cf approx vs viz e.g i.e ca",
    "de": "dr prof hr fr frl vgl bzw ca sog evtl ggf inkl bspw z.b d.h u.a s.o s.u dipl ing",
    "fr": "dr prof mm m mme mlle mgr cf env p.ex c.-à-d av",
    "es": "dr dra sr sra srta prof profa ud uds p.ej cf aprox ee d dña",
    "ru": "проф акад доц им см ср ул т.е т.н напр канд докт",
    "hi": "डॉ श्री पृ प्रो सं",
    "ar": "د أ ص م",
}
# Abbreviations that stand before a number, a numeral or a bracket.
NUMBERED = {
    "en": "fig figs eq eqs sec secs no nos vol vols ch chap p pp tab tabs art ed eds ref refs app pt par",
    "de": "abb nr kap bd s tab art abs aufl hrsg jg gl",
    "fr": "fig éq sec no vol chap p pp tab art éd t n",
    "es": "fig ec sec núm vol cap pág págs p pp tab art ed n n.º",
    "ru": "рис стр гл табл т с г гг п пп разд ур",
}
# Abbreviations that can end a sentence; they don't where the text goes on in lower case, with a bracketed year or a comma.
MAYBE = {
    "en": "etc inc corp ltd co al jr sr u.s u.k a.m p.m a.s.l s.d dept univ assn bros ave jan feb mar apr jun jul aug sept oct nov dec approx ed no vol",
    "de": "usw etc chr jh jhd mio mrd u.s.w gmbh",
    "fr": "etc j.-c éd av apr s",
    "es": "etc c uu cía ltda ss",
    "ru": "др пр д г гг в вв тыс млн млрд руб э",
}
# Words that begin sentences; after a single letter or a number with a stop they show that it ended one.
STARTERS = (
    "The This These Those We Our However It In When Most Some Few Many Older No They He She There But And If For As At On A An Each "
    "Der Die Das Den Dem Des Ein Eine Unsere Sie Er Es Wir Ich Im In Wenn Aber Und Diese Dieser Dieses Nach Bei Gemessen "
    "Le La Les Un Une Il Elle On Notre Nos Cette Ce Ces Cet El Los Las Una Nuestro Nuestra Esta Este Esto Se Voir Véase"
).split()
MASKS = {".": "\ue000", "!": "\ue001", "?": "\ue002", "…": "\ue003", "。": "\ue004", "！": "\ue005", "？": "\ue006"}
CUT = "\ue00f"
CLOSE = "\\)\\]\\}\"'”’»›“」』）》"
CJK = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"


@cache
def _fold() -> tuple[str, str]:
    """The one-for-one folding without that of full-width punctuation, and all blanks as the plain one."""
    pairs = [(a, b) for a, b in zip(*fold_table(), strict=True) if not (0xFF01 <= ord(a) <= 0xFF5E and not b.isalnum()) and a not in "’ʼ"]
    known = {a for a, _ in pairs}
    pairs += [(chr(c), " ") for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x1680) if chr(c) not in known]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _words(kind: str) -> str:
    """Alternatives for the words of a fixed list, as folded text has them; inner stops may be masked and followed by a blank."""
    table = str.maketrans(dict(zip(*_fold(), strict=True)))
    lists = {"never": NEVER, "numbered": NUMBERED, "maybe": MAYBE}[kind]
    found = {w for x in lists.values() for w in x.split()}
    found |= {w.replace("fi", "ﬁ") for w in found}
    out = set()
    for w in found:
        w = w.translate(table)
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not "\u0300" <= c <= "\u036f")
        out.add("".join(f"[.{MASKS['.']}]\\s?" if c == "." else c for c in w))
    return "|".join(sorted(out, key=lambda x: (-len(x), x)))


def _mask(text: Column, before: str, after: str, which: str = ".") -> Column:
    """Masks each of the characters in which that stands between before (a lookbehind or "") and after."""
    return reduce(lambda t, c: F.regexp_replace(t, f"{before}{'[' + c + ']'}{after}", MASKS[c]), which, text)


def shadow(text: Column) -> Column:
    """The text with the same length, look-alikes folded and every stop masked that ends no sentence."""
    hidden = f"[{INVISIBLE_CLASS}\u0300-\u036f]"
    t = F.translate(text, *_fold())
    for _ in range(3):  # what is invisible goes before the word it stands in, so that words are whole
        t = F.regexp_replace(t, f"([\\p{{L}}\\p{{N}}]+)({hidden}+)(?=[\\p{{L}}\\p{{N}}.])", "$2$1")
    start = "(?<![\\p{L}\\p{N}])"
    alone = f"(?<![\\p{{L}}\\p{{N}}.{MASKS['.']}])"
    m = f"[.{MASKS['.']}]"
    gap = f"\\s+[{INVISIBLE_CLASS}\\u0300-\\u036f]*"
    # decimals, versions, names with dots, URLs
    t = _mask(t, "", "(?=[\\p{Ll}\\p{Nd}/_@-])(?<=[\\p{L}\\p{N}][.])")
    t = F.regexp_replace(t, "((?:https?://|www|(?!^)\\G)[^\\s.]*)[.](?=\\S)", f"$1{MASKS['.']}")
    # numbers that head a line of a list
    t = _mask(t, "(?<=(?:^|\\n)[ \\t]{0,8}\\d{1,2})", "(?=[ \\t])")
    # acronyms: all stops but the last
    t = _mask(t, f"(?<={start}\\p{{Lu}}|[.{MASKS['.']}]\\p{{Lu}})", "(?=\\p{Lu}[.])")
    t = _mask(t, f"(?<={start}\\p{{Lu}})", "(?=-\\p{Lu}[.])")
    # two-letter abbreviations written with a blank between their parts: the first stop
    t = F.regexp_replace(t, f"(?i)({start}(?:z|d|u|p|s|n|a|e|i|t|т|и т|т|н|v|o))[.](?=\\s?(?:B|h|a|o|u|ej|ex|c|g|chr|д|е|п|н|э|e)[.])", f"$1{MASKS['.']}")
    t = F.regexp_replace(t, f"(?i)({start}(?:z{m}\\s?B|d{m}\\s?h|p{m}\\s?ej|p{m}\\s?ex|[тt]{m}\\s?[еe]|[иu]{m}\\s?a|s{m}\\s?o|e{m}\\s?g|i{m}\\s?e|c{m}-a-d))[.](?=\\s|$)", f"$1{MASKS['.']}")
    t = F.regexp_replace(t, f"(?i)({alone}(?:{_words('never')}))[.]", f"$1{MASKS['.']}")
    t = F.regexp_replace(t, f"(?i)({alone}(?:{_words('numbered')}))[.](?=\\s*(?:[\\d(\\[º°]|[ivxlc]+(?![\\p{{L}}])))", f"$1{MASKS['.']}")
    t = F.regexp_replace(t, f"(?i)({start}(?:{_words('maybe')}))[.](?=[,;:]|{gap}(?:(?-i:\\p{{Ll}}|[({{\\[]\\d)|[,;:&]))", f"$1{MASKS['.']}")
    # a town's г. before its name; single letters of scripts without capitals
    t = _mask(t, f"(?<={start}г)(?<!\\d[\\s{INVISIBLE_CLASS}]?г)", f"(?={gap}\\p{{Lu}})")
    t = _mask(t, f"(?<={start}[؀-ۿ])", "(?=\\s)")
    t = _mask(t, "(?<=(?<![ऀ-ॿ])[ऀ-ॿ]{1,4})", "(?=\\s)")
    # initials, but not the end of an era (a. C., J.-C.), nor before a word that begins sentences
    first = "|".join(sorted(set(STARTERS)))
    t = _mask(t, f"(?<={start}\\p{{Lu}})(?<!(?<![\\p{{L}}])[ad]{m}\\s?C)(?<!J{m}-C)", f"(?={gap}\\p{{Lu}})(?!{gap}(?:{first})(?![\\p{{L}}.]))")
    # ordinals of German: one or two digits before a noun or month
    german = F.regexp_count(text, F.lit("(?i)(?<![\\p{L}])(?:der|die|das|und|den|im|nach|vor|dem|ist|nicht)(?![\\p{L}])")) > F.regexp_count(text, F.lit("(?i)(?<![\\p{L}])(?:the|of|and|la|de|el|les|le)(?![\\p{L}])"))
    t = F.when(german, _mask(t, f"(?<={start}\\d{{1,2}})", f"(?={gap}\\p{{Lu}})(?!{gap}(?:{first})(?![\\p{{L}}]))")).otherwise(t)
    # an ellipsis or quoted end after which the sentence goes on
    go_on = f"{gap}\\p{{Ll}}"
    t = _mask(t, "", f"(?=[.…]*{go_on})(?<=[.…\\s][.…])", ".…")
    t = _mask(t, "(?<=[.])", f"(?=[.]*{go_on})")
    t = _mask(t, "", f"(?=[.]+{go_on})")
    t = _mask(t, "", f"(?=[.!?…]*\\s?[{CLOSE}]+(?:{go_on}|\\s*[,;:—–]))", ".!?…")
    # a stop before lower case: an unknown abbreviation, unless a longer word stands before it
    t = _mask(t, "(?<![\\p{L}]{4})", f"(?={gap}\\p{{Ll}})(?!{gap}\\p{{Ll}}{{1,2}}[\\p{{Lu}}-])(?<!\\d[.])")
    # quotations of Chinese and Japanese: the sentence goes on after a particle, a verb of saying, or where it has begun before the quotation
    closers = "[”’」』]+"
    stops = "。！？"
    masked = "".join(MASKS[c] for c in stops)
    t = _mask(t, "", f"(?=[{stops}]*{closers}(?:と|って|など|の|は|が|を|に|も|で|や|か|、|，))", stops)
    t = _mask(t, "", f"(?=[{stops}]*{closers}[^。！？\\n：]{{0,30}}[说說問问道写寫答称稱述尋])", stops)
    t = reduce(lambda x, c: F.regexp_replace(x, f"([\\p{{L}}\\p{{N}}][“‘「『][^”’」』\\n]*?)[{c}](?=[{stops}{masked}]*{closers}[^\\s”’」』])", f"$1{MASKS[c]}"), stops, t)
    return t


def divided(text: Column) -> Column:
    """The masked text with a cut after each sentence and at each blank line."""
    t = shadow(text)
    end = ".!?…؟۔"
    t = F.regexp_replace(t, f"[{end}]+(?:[{CLOSE}]|\\s»(?=\\s|$))*(?=\\s|$)", f"$0{CUT}")
    t = F.regexp_replace(t, f"(?<=[\\p{{L}}\\p{{N}}%)]{{2}})[{end}]+[{CLOSE}]*(?=[(“„«¿¡\"]?[{INVISIBLE_CLASS}]*\\p{{Lu}}[\\p{{L}}{INVISIBLE_CLASS}]|[{CJK}])", f"$0{CUT}")
    t = F.regexp_replace(t, "(?<=\\p{Ll}{4})[.](?=\\d)", f"$0{CUT}")
    close = CLOSE.replace("“", "")  # opens a quotation in Chinese
    t = F.regexp_replace(t, f"[।॥。！？．]+[…]*[{close}]*|(?<=[{CJK}])[…]+[{close}]*|(?<=[{CJK}])[!?]+[{close}]*", f"$0{CUT}")
    return F.regexp_replace(t, "\\n[ \\t\\r]*\\n", f"$0{CUT}")


def ranges(text: Column) -> Column:
    """Array of (range_start, range_end), code points from 0, end exclusive, in order; null for null text."""
    parts = F.split(divided(text), CUT)
    blank = "\\s"

    def place(acc: Column, p: Column) -> Column:
        lead = F.length(p) - F.length(F.regexp_replace(p, f"^{blank}+", ""))
        body = F.length(F.regexp_replace(F.regexp_replace(p, f"^{blank}+", ""), f"{blank}+$", ""))
        one = F.struct((acc["at"] + lead).alias("range_start"), (acc["at"] + lead + body).alias("range_end"))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.when(body > 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    zero = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<range_start:int,range_end:int>>))")
    return F.aggregate(parts, zero, place, lambda acc: acc["out"])


def sentences(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """papers(key, text) -> (key, sentence_start, sentence_end, sentence), one row per sentence.

    Null, empty and blank texts give none. Equal rows are divided each by itself.
    """
    rows = papers.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), F.explode(ranges(F.col(text))).alias("r"))
    start, end = F.col("r.range_start"), F.col("r.range_end")
    return rows.select(key, start.cast("bigint").alias("sentence_start"), end.cast("bigint").alias("sentence_end"), F.expr("substring(_t, r.range_start + 1, r.range_end - r.range_start)").alias("sentence"))


def native_sentences(papers: DataFrame) -> DataFrame:
    """Sentence ranges of the papers all of whose pages are native; a paper without pages has no native ones."""
    native = papers.where(F.expr("size(pages) > 0 and forall(pages, p -> p.provenance = 'native')"))
    return sentences(native).drop("sentence")
