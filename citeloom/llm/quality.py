"""Problem 10: per-document text quality statistics.

Method: a text is read as runs of like lines. On each run twelve labelling functions, each a threshold on one statistic,
vote for a text type (prose, list, table or junk) or not at all. Their accuracies are learned without labels by
expectation-maximization on how often they agree, over the counts of all vote patterns of the whole corpus (at most 3 to
the power of the number of functions, however many documents there are). A document's posterior of each type is the mean
of its runs' posteriors by their characters, and it is prose if at least half of its characters are. Only pattern counts
and function accuracies reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Frequent function words of the languages with spaces between words.
COMMON = (
    "the of and to in is that for with as by on are was were be this it from at or an which we not have has their its than when each any "
    "der die das und den dem des von zu im ist nicht mit sich auf für ein eine einen einer nach um als bei aus laut vor seit am "
    "le la les de du des et en un une est que qui dans pour sur pas au aux par ce se selon vers il on ne "
    "el los las y una es no se por con para su al del como más según en que o lo esta este "
    "и в не на что с по из за от для при его это как к о у до"
).split()
KNOWN = frozenset(COMMON)
TYPES = ("prose", "list", "table", "junk")
PROSE, JUNK = 0, 3
#: Labelling functions, with how often each is held to give its first and its second vote on a prose, list, table and junk run before anything is learned; else it gives none.
FUNCTIONS = {
    "sentences": ((0.85, 0.05), (0.1, 0.6), (0.05, 0.7), (0.05, 0.85)), "common_words": ((0.85, 0.03), (0.3, 0.3), (0.05, 0.6), (0.15, 0.7)), "letters": ((0.9, 0.02), (0.45, 0.2), (0.15, 0.6), (0.6, 0.2)),
    "line_length": ((0.85, 0.05), (0.35, 0.4), (0.25, 0.4), (0.5, 0.3)), "last_end": ((0.85, 0.02), (0.15, 0.5), (0.05, 0.6), (0.1, 0.3)), "starts": ((0.03, 0), (0.6, 0), (0.1, 0), (0.03, 0)), "separators": ((0.01, 0), (0.15, 0), (0.7, 0), (0.1, 0)),
    "digits": ((0.01, 0), (0.15, 0), (0.6, 0), (0.1, 0)), "references": ((0.02, 0), (0.5, 0), (0.1, 0), (0.01, 0)), "symbols": ((0.01, 0), (0.05, 0), (0.25, 0), (0.4, 0)), "repeated": ((0.005, 0), (0.02, 0), (0.03, 0), (0.5, 0)), "word_shape": ((0.005, 0), (0.02, 0), (0.03, 0), (0.5, 0)),
}
EM_ROUNDS = 60
#: Words of a heading at most.
HEADING = 20
#: Runs' worth of belief that a function votes as it should, in parts of all runs, and at least.
BELIEF, BELIEF_LEAST = 0.1, 50.0


WORDS = re.compile(r"[^\W\d_]+(?:[’'-]+[^\W\d_]+)*")
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
SYMBOLS = "|&;\\{}_^=+*/<>#@~$%\t[]"
END_PROSE = re.compile(r"[.!?;:,。！？；：，…।؟][\"'”’»」』）)\]]*\s*$")
START_JUNK = re.compile(r"\s*(?:\[\d+\]|\(?[0-9ivx]{1,5}[).]\s|\(?[a-z]\)\s|[-–—*•·▪◦]\s|\d+(?:\.\d+)+\s|[|&])")
COMMAS = re.compile(r"(?:,[^, ]*){3}")
APART = re.compile(r"\S {3,}\S")
DIGIT = re.compile(r"\d")
REFERENCE = re.compile(r"\d\(\d+\)|, \d+(?:, \d+)*\s*$")
PAGES, DATED = re.compile(r"\d\s*[-–:]\s*\d"), re.compile(r"(?:19|20)\d\d[,;.)].*\d\s*[-–:]\s*\d")
SHAPE = re.compile(r"[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{6}|\S{45}|[a-z][A-Z0-9][a-z0-9]?[A-Z]")
SENTENCE_END = re.compile(r"[.!?।؟…](?<=[^\W\d_]{2}.)[”\"»’)\]]*(?:\s+[^\Wa-zß-öø-ÿа-яё_]|\s+[«“\"„¿¡(]|\s*$)|[。！？]")
BROKEN = re.compile("\ufffd.*\ufffd|(?:\u00c3[\u0080-\u00bf\u00c2].*){2}")
BLANK = re.compile(r"\n[ \t]*\n")


def spaced(x: str) -> bool:
    """Whether a line is set in columns or fields: tabs, wide gaps, dot leaders, or many separators."""
    return "\t" in x or "...." in x or ("   " in x and APART.search(x) is not None) or x.count("&") >= 3 or x.count(";") >= 4 or (x.count(",") >= 3 and COMMAS.search(x) is not None)


def reference(x: str) -> bool:
    """Whether a line reads like a bibliographic reference or an index entry."""
    return DIGIT.search(x) is not None and (REFERENCE.search(x) is not None or PAGES.search(x) is not None and DATED.search(x) is not None)


def signs(line: str) -> tuple[bool, bool, bool]:
    """Whether a line starts like a list item, is set in fields, reads like a reference."""
    return START_JUNK.match(line) is not None, spaced(line), reference(line)


def repeats(parts: list[str]) -> bool:
    """Whether most runs of three words, or three quarters of the pairs, stood before."""
    n = len(parts) - 2
    if n < 10 or len(set(parts)) > n / 2 + 2:  # fewer different words than runs of them
        return False
    return len(set(zip(parts, parts[1:], parts[2:], strict=False))) * 2 < n or len(set(pairwise(parts))) * 4 < n


def votes(run: list[str], own: list[tuple[bool, bool, bool]]) -> tuple[int, ...]:
    """The vote of each function on a run of lines with their signs: 0 or 1 for its first or second, 2 for none."""
    text = "\n".join(run)
    n, m = len(text), len(run)
    words = WORDS.findall(text)
    k = len(words)
    parts = CJK.findall(text) if not text.isascii() else []
    cjk = bool(parts)
    letters = sum(map(len, words)) / n
    common = sum(w in KNOWN for w in map(str.lower, words))
    digits = sum(map(str.isdigit, text)) if letters < 0.8 else 0
    symbols = sum(map(text.count, SYMBOLS)) if letters < 0.9 else 0
    ends = sum(1 for _ in SENTENCE_END.finditer(text))
    wide = len(parts) * 4 > n  # no blanks between words
    again = m > 3 and len(set(run)) * 2 <= m or repeats(parts if wide else words)
    last = run[-1].rstrip()
    share = [sum(x) * 2 >= m for x in zip(*own, strict=True)]
    return (
        0 if ends * 400 >= n else 1 if not ends else 2,
        2 if wide else 0 if common >= 0.12 * k and k >= 4 else 1 if common == 0 or common * 20 < k else 2,
        0 if letters >= 0.72 else 1 if letters < 0.6 else 2,
        (0 if n >= 12 * m else 1 if n < 9 * m else 2) if wide else 0 if k >= 8 * m else 1 if k <= 4 * m else 2,
        0 if END_PROSE.search(last) else 1 if last[-1].isdigit() or last[-1] in "|>&" or last.endswith("...") else 2,
        *(0 if x else 2 for x in share[:2]),
        0 if digits > 0.15 * n else 2,
        0 if share[2] else 2,
        0 if symbols > 0.07 * n else 2,
        0 if again else 2,
        0 if ("\ufffd" in text or "\u00c3" in text) and BROKEN.search(text) or not cjk and not common and SHAPE.search(text) else 2,
    )


def runs(text: str) -> Iterator[tuple[list[str], list[tuple[bool, bool, bool]]]]:
    """The runs of a text with the signs of their lines: its blocks between blank lines; a block with some structured lines, fewer than half, is divided between them and the others."""
    for block in BLANK.split(text):
        lines = [x for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        own = [signs(x) for x in lines]
        kind = [any(x) for x in own]
        if not any(kind) or sum(kind) * 2 >= len(kind):
            yield lines, own
            continue
        at = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or kind[i] != kind[at]:
                yield lines[at:i], own[at:i]
                at = i


def text_patterns(text: str) -> tuple[list[int], list[int]]:
    """Vote pattern (a number in base 3) and length of each run; runs that say the same as an earlier one of the text are read once.

    A heading (one line of at most HEADING words without an end, before another run) counts with the run that it heads.
    """
    patterns, sizes = [], []
    known: dict[tuple[str, ...], int] = {}
    found = list(runs(text))
    above = 0
    for i, (run, own) in enumerate(found):
        size = sum(map(len, run))
        if len(run) == 1 and i + 1 < len(found) and not any(own[0]) and not END_PROSE.search(run[0]) and len(run[0].split()) <= HEADING and len(run[0]) <= 10 * HEADING:
            above += size
            continue
        key = tuple(run)
        if key not in known:
            known[key] = sum(v * 3**j for j, v in enumerate(votes(run, own)))
        patterns.append(known[key])
        sizes.append(size + above)
        above = 0
    return patterns, sizes


def documents_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run array of (p, n)): the vote pattern and length of each run of the text.

    The votes are computed on Arrow batches: the same thresholds as SQL expressions took three times the CPU time, as
    each of a dozen patterns then converts every line and runs interpreted.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_patterns(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]).astype(np.int32)
            flat = lambda k: pa.array([v for x in found for v in x[k]], pa.int32())  # noqa: E731, B023
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([flat(0), flat(1)], ["p", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "run"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, run array<struct<p:int,n:int>>")


def believed() -> np.ndarray:
    """FUNCTIONS as [function, truth, vote]."""
    out = np.array(list(FUNCTIONS.values()), float)
    return np.clip(np.concatenate([out, 1 - out.sum(2, keepdims=True)], 2), 0.001, None)


def learn(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene EM on pattern counts -> (accuracy[function, truth, vote], share of each type); deterministic."""
    k = len(FUNCTIONS)
    keys = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[p] for p in keys.tolist()], float)
    cast = (keys[:, None] // 3 ** np.arange(k)[None, :]) % 3
    belief = believed()
    strength = max(BELIEF_LEAST, BELIEF * weight.sum())
    table, prior = belief / belief.sum(2, keepdims=True), np.full(len(TYPES), 1 / len(TYPES))
    for _ in range(EM_ROUNDS):
        post = posteriors(cast, table, prior)
        prior = (weight @ post + 1) / (weight.sum() + len(TYPES))
        for v in range(3):
            table[:, :, v] = ((cast == v) * weight[:, None]).T @ post + strength * belief[:, :, v]
        table /= table.sum(2, keepdims=True)
    return table, prior


def posteriors(cast: np.ndarray, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(type) of each row of votes."""
    log = np.log(prior) + sum(np.log(table[f, :, cast[:, f]]) for f in range(table.shape[0]))
    post = np.exp(log - log.max(1, keepdims=True))
    return post / post.sum(1, keepdims=True)


def text_types(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars, prose_share, p_prose, p_list, p_table, p_junk, text_type), one row per row with non-empty text.

    p_... are the document's posteriors; prose_share is the share of characters in runs that are prose with a posterior of
    a half or more; text_type is prose from a share of one half, else the likeliest other type. Text of nothing but white
    space is junk with share 0.
    """
    kept = docs.where("doc_id is not null and text is not null and text <> ''")
    read = cut(documents_runs(kept))
    counts = read.select(F.explode("run.p").alias("p")).groupBy("p").count()
    table, prior = learn({r["p"]: r["count"] for r in counts.collect()} or {0: 1})  # at most 3^12 rows, by construction

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            p, n = (np.asarray(x, np.int64) for x in lists.flatten().flatten())
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            post = posteriors((p[:, None] // 3 ** np.arange(len(FUNCTIONS))[None, :]) % 3, table, prior) if len(p) else np.zeros((0, len(TYPES)))
            total = np.bincount(owner, n, len(lists))
            per = lambda x: np.bincount(owner, n * x, len(lists)) / np.maximum(total, 1)  # noqa: B023, E731
            share, mean = per(post[:, PROSE] >= 0.5), np.column_stack([per(post[:, t]) for t in range(len(TYPES))])
            mean[total == 0] = np.eye(len(TYPES))[JUNK]
            best = np.where(share >= 0.5, PROSE, 1 + mean[:, 1:].argmax(1))
            columns = [batch.column(0), pa.array(total.astype(np.int64)), pa.array(share), *(pa.array(mean[:, t]) for t in range(len(TYPES))), pa.array([TYPES[b] for b in best])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "prose_share", *(f"p_{t}" for t in TYPES), "text_type"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(judge, f"doc_id {kind}, n_chars bigint, prose_share double, " + ", ".join(f"p_{t} double" for t in TYPES) + ", text_type string")


def statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> one row per doc_id with word, line, symbol and digit statistics; null text gives nulls, empty text zeros."""
    t = F.col("text")
    word = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n = F.length(t)
    per = lambda a, b: F.when(t.isNull(), None).when(b > 0, a / b).otherwise(F.lit(0.0))
    return docs.select(
        "doc_id",
        F.when(t.isNotNull(), F.size(word)).cast("bigint").alias("n_words"),
        F.round(per(F.aggregate(word, F.lit(0), lambda a, w: a + F.length(w)), F.size(word)), 6).alias("mean_word_length"),
        F.round(per(F.length(F.regexp_replace(t, r"[A-Za-z0-9\s]", "")), n), 6).alias("symbol_ratio"),
        F.round(per(F.length(F.regexp_replace(t, r"[^0-9]", "")), n), 6).alias("digit_ratio"),
        F.when(t.isNotNull(), F.size(lines)).cast("bigint").alias("n_lines"),
        F.round(per(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?。！？]\s*$"))), F.size(lines)), 6).alias("punctuated_share"),
        F.round(per(F.size(F.filter(word, lambda w: F.lower(w).isin(*sorted(KNOWN)))), F.size(word)), 6).alias("common_share"),
    )
