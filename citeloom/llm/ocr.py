"""Problem 3: noise in text from scanned pages.

Method: corrections are retrieved through an inverted join on character q-grams and ranked by gradient-boosted trees;
line-pair classifiers find page furniture (a line and its like on a neighbouring page) and decide joins (a line's end and
the next line's start). All three are trained here without labels: on what the corpus shows beyond doubt and on words of
native pages that are misread or divided on purpose. Each trains on at most SAMPLE rows; everything else covers all rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..session import cut
from .boost import Boosted

#: Rows that a classifier is trained on at most.
SAMPLE = 20_000
SEED = 11
#: How often a native word is misread on purpose to learn from.
MISREADINGS = 3
#: Lines at the top and the bottom of a page that may be furniture, and how many pages on a like one is looked for letter by letter; equal ones are found at any distance.
EDGE, REACH = 3, 4
#: Characters of a line that is nothing but a page number, at most.
NUMBER_LENGTH = 16
#: A word this frequent in its language can be what a misread word stands for, unless native pages, which should show it so often at least, hardly do.
TRUSTED, EXPECTED = 4, 3
SIGNS = "-‐‑¬­"
# What scanning reads for what (read, printed).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("5", "s"), ("6", "é"), ("6", "b"), ("8", "B"), ("9", "g"), ("3", "e"), ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("a", "e"), ("o", "c"), ("c", "o"), ("b", "h"), ("h", "b"), ("ii", "u"), ("u", "n"), ("n", "u"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("l", "i"), ("i", "l"), ("t", "f"), ("f", "t"), (".", "e"), ("li", "h"), ("O", "0"), ("l", "1"), ("I", "l"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"), ("s", "5"),
]
# Words that tell a language.
TELL = {"en": "the of and is with", "de": "der die das und den", "fr": "le la les et du", "es": "el la los y en", "ru": "и в на с по", "it": "il di che e per", "pt": "o de que e os"}
NUMBER = re.compile(r"^[\s\[\]()\-–—.|]*(?:(?:page|seite|p|pag|página|pág|стр|s)\.?\s*)?([0-9OolISB]{1,5}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})(?:\s*(?:of|/|von|de|sur|из)\s*[0-9OolISB]{1,5})?[\s\[\]()\-–—.|]*$", re.IGNORECASE)
LETTERS = r"[^\W\d_]"
WORD = re.compile(r"[^\s]+")


def number_of(line: str) -> int:
    """The number a line consists of (Arabic or Roman), or -1."""
    m = NUMBER.match(line.strip())
    if not m:
        return -1
    s = m[1]
    if re.fullmatch(r"[ivxlcdmIVXLCDM]+", s) and not re.fullmatch(r"[lI]", s):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in s.lower()]
        return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True))
    digits = s.translate(str.maketrans("OoIlSB", "001158"))
    return int(digits) if digits.isdigit() else -1


def language(text: str) -> str:
    words = Counter(m[0] for m in re.finditer(LETTERS + "+", text.lower()))
    count = {k: sum(words[w] for w in v.split()) for k, v in TELL.items()}
    best = max(count, key=lambda k: (count[k], k))
    return best if count[best] else "other"


def lines(papers: DataFrame) -> DataFrame:
    """One row per line that isn't blank, with its place on the page and in the text; noisy: the paper has a scanned page; trust: the page's confidence, -1 where it has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for paper, text, pages in zip(batch["paper_id"], batch["text"], batch["pages"], strict=True):
                lang, noisy = language(text), any(p["provenance"] == "ocr" for p in pages)
                for order, p in enumerate(pages):
                    found = [(m.start() + p["text_start"], m[0]) for m in re.finditer(r"[^\n]*\S[^\n]*", text[p["text_start"] : p["text_end"]])]
                    width = float(np.median([len(x) for _, x in found])) if found else 0.0
                    trust = -1.0 if p["confidence"] is None or p["confidence"] != p["confidence"] else float(p["confidence"])
                    out += [(paper, lang, noisy, order, p["provenance"], trust, i, len(found) - 1 - i, start, x, width) for i, (start, x) in enumerate(found)]
            yield pd.DataFrame(out, columns=["paper_id", "lang", "noisy", "page", "provenance", "trust", "line", "back", "start", "text", "width"])

    kept = papers.where("paper_id is not null and text is not null and pages is not null").select("paper_id", "text", "pages")
    return cut(kept.repartition("paper_id").mapInPandas(run, "paper_id string, lang string, noisy boolean, page int, provenance string, trust double, line int, back int, start bigint, text string, width double"))


PAIR = ["alike", "step", "number", "size", "end", "letters", "gap", "trust", "edge", "repeats", "support"]
#: Lines alike to this degree support each other.
ALIKE = 0.7


def _pair_features(batch: pd.DataFrame) -> np.ndarray:
    na, nb = batch["text_a"].map(number_of).to_numpy(), batch["text_b"].map(number_of).to_numpy()
    gap = (batch["page_b"] - batch["page_a"]).to_numpy()
    end = batch["text_a"].str.contains(r"[.!?;,][\"”’»)]*\s*$").to_numpy()
    size = batch["text_a"].str.len().to_numpy()
    step = (na >= 0) & (nb >= 0) & (nb - na == gap) & (gap > 0)
    return np.column_stack([batch["alike"].to_numpy(), step, na >= 0, size / np.maximum(batch["width"].to_numpy(), 1), end, batch["letters"].to_numpy(), gap, batch["trust"].to_numpy(), batch["edge"].to_numpy(), batch["repeats"].to_numpy(), batch["support"].to_numpy()]).astype(float)


def sure_pair(x: np.ndarray) -> np.ndarray:
    """What shows beyond doubt: equal or nearly equal lines with letters, or numbers that count the pages."""
    return ((x[:, 0] >= 0.9) & (x[:, 5] >= 6) & (x[:, 6] > 0)) | (x[:, 1] > 0)


def furniture(rows: DataFrame) -> DataFrame:
    """rows of lines() -> (paper_id, start, noise_kind) of running lines and page numbers.

    A classifier of line pairs decides: a line at an edge with a like one of another page, and a line of nothing but a
    number with itself. It learns from sure pairs of the edges against pairs of the same place within pages. Where a corpus
    has too few of either to learn from, the sure pairs and the numbers are taken.
    """
    bare = F.lower(F.regexp_replace("text", r"[\d\s]+", ""))
    near = rows.where("noisy").withColumn("bare", bare).withColumn("letters", F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).withColumn("edge", F.least("line", "back"))
    outer = near.where(F.col("edge") < EDGE).withColumn("side", F.explode(F.expr(f"filter(array(if(line < {EDGE}, 't', null), if(back < {EDGE}, 'b', null)), x -> x is not null)")))
    inner = near.where(F.col("edge") >= EDGE).withColumn("side", F.concat(F.lit("i"), F.col("line")))
    number = F.pandas_udf(lambda s: s.map(number_of).astype("int64"), LongType())

    def paired(x: DataFrame) -> DataFrame:
        x = x.join(x.where("letters >= 6").groupBy("paper_id", "side", "bare").agg(F.countDistinct("page").alias("repeats")), ["paper_id", "side", "bare"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
        a = x.withColumn("other", F.explode(F.array(*(F.col("page") + d for d in range(1, REACH + 1)))))
        b = x.select("paper_id", "side", F.col("page").alias("other"), F.col("start").alias("start_b"), F.col("text").alias("text_b"), F.col("bare").alias("bare_b"), F.col("trust").alias("trust_b"))
        both = a.join(b, ["paper_id", "side", "other"])
        # equal lines farther apart: each with the next page that has it
        ahead = x.where("repeats > 1").select("paper_id", "side", "bare", "page", "start", "text", "trust").groupBy("paper_id", "side", "bare").agg(F.array_sort(F.collect_list(F.struct("page", "start", "text", "trust"))).alias("s"))
        far = ahead.select("paper_id", "side", F.explode(F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda v, i: F.struct(v.alias("a"), F.get("s", i + 1).alias("b")))).alias("p")).where(F.col("p.b.page") - F.col("p.a.page") > REACH)
        far = far.select("paper_id", "side", F.col("p.a.start").alias("start"), F.col("p.b.page").alias("other"), F.col("p.b.start").alias("start_b"), F.col("p.b.text").alias("text_b"), F.col("p.b.trust").alias("trust_b")).join(x, ["paper_id", "side", "start"]).withColumn("bare_b", F.col("bare"))
        alone = x.where(F.length(F.trim("text")) <= NUMBER_LENGTH).where(number("text") >= 0)
        alone = alone.select("*", F.col("page").alias("other"), F.col("start").alias("start_b"), F.col("text").alias("text_b"), F.col("bare").alias("bare_b"), F.col("trust").alias("trust_b"))
        alike = F.when(F.col("start") == F.col("start_b"), 1.0).otherwise(1 - F.levenshtein("bare", "bare_b") / F.greatest(F.length("bare"), F.length("bare_b"), F.lit(1)))
        cols = ["paper_id", "side", F.col("page").alias("page_a"), F.col("other").alias("page_b"), F.col("start").alias("start_a"), "start_b", F.col("text").alias("text_a"), "text_b", "width", "letters", "edge", F.least("trust", "trust_b").alias("trust"), "repeats", alike.alias("alike")]
        found = cut(both.select(*cols).unionByName(far.select(*cols)).unionByName(alone.select(*cols)))
        ends = found.where((F.col("alike") >= ALIKE) & (F.col("start_a") != F.col("start_b"))).select("paper_id", F.explode(F.array("start_a", "start_b")).alias("start"))
        support = ends.groupBy("paper_id", "start").agg(F.count("*").alias("n"))
        per = lambda k: support.select("paper_id", F.col("start").alias(f"start_{k}"), F.col("n").alias(f"n_{k}"))
        known = found.join(per("a"), ["paper_id", "start_a"], "left").join(per("b"), ["paper_id", "start_b"], "left")
        return known.withColumn("support", F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))).drop("n_a", "n_b")

    pairs = cut(paired(outer))
    order = lambda df: df.orderBy(F.xxhash64("paper_id", "start_a", "start_b")).limit(SAMPLE // 2).toPandas()
    seen, other = order(pairs), order(paired(inner))
    model = None
    if len(seen) and len(other):
        x, bad = _pair_features(seen), _pair_features(other)
        sure = sure_pair(x)
        known = set(zip(seen["paper_id"][sure], seen["start_a"][sure], strict=True)) | set(zip(seen["paper_id"][sure], seen["start_b"][sure], strict=True))
        itself = np.array([(p, a) in known for p, a in zip(seen["paper_id"], seen["start_a"], strict=True)]) & (seen["start_a"] == seen["start_b"]).to_numpy()
        good = x[sure | itself]
        worse = x[sure & (x[:, 5] >= 6) & (x[:, 6] > 0)].copy()  # the same lines read worse
        worse[:, 0] -= np.random.default_rng(SEED).uniform(0, 0.3, len(worse))
        worse[:, PAIR.index("repeats")] = 0
        good = np.vstack([good, worse])
        unlike = x[(x[:, 0] < 0.5) & (x[:, 1] == 0)]
        bad = np.vstack([bad[~sure_pair(bad)], unlike])
        bad[:, PAIR.index("edge")] = np.minimum(bad[:, PAIR.index("edge")], EDGE - 1)  # where a line stands is no proof against it
        if len(good) >= 20 and len(bad) >= 20:
            model = Boosted(trees=40, depth=3).fit(np.vstack([good, bad]), np.r_[np.ones(len(good)), np.zeros(len(bad))])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _pair_features(batch)
            taken = model.predict(x) >= 0.5 if model else sure_pair(x) | ((x[:, 2] > 0) & (x[:, 6] == 0))
            hit = batch[taken]
            yield pd.DataFrame({"paper_id": pd.concat([hit["paper_id"], hit["paper_id"]]), "start": pd.concat([hit["start_a"], hit["start_b"]])})

    hits = pairs.mapInPandas(judge, "paper_id string, start bigint").distinct()
    kinds = outer.select("paper_id", "start", "text").distinct().join(hits, ["paper_id", "start"])
    bare_number = (F.length(F.trim("text")) <= NUMBER_LENGTH) & (number("text") >= 0)
    return cut(kinds.select("paper_id", "start", F.when(bare_number, "page_number").otherwise("running_line").alias("noise_kind")))


def body(rows: DataFrame, noise: DataFrame) -> DataFrame:
    """(paper_id, lang, lines array) of what isn't furniture, in order."""
    kept = rows.join(noise.select("paper_id", "start"), ["paper_id", "start"], "left_anti")
    return cut(kept.groupBy("paper_id", "lang", "noisy").agg(F.array_sort(F.collect_list(F.struct("start", "text", "provenance"))).alias("lines")))


def _trim(token: str) -> tuple[int, int]:
    """Start and end of the word in a token without the punctuation around it; ! before a small letter is part of it."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum() and not (token[a] in "!|" and a + 1 < b and token[a + 1].islower()):
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return a, b


def tokens(texts: DataFrame) -> DataFrame:
    """(paper_id, lang, start, word, scanned, sign, sign_start, right): words of the body; a word before a sign at a line's end comes with the next line's first word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for paper, lang, noisy, rows in zip(batch["paper_id"], batch["lang"], batch["noisy"], batch["lines"], strict=True):
                skip = None
                for k, row in enumerate(rows):
                    found = list(WORD.finditer(row["text"]))
                    for i, m in enumerate(found):
                        if skip == k and i == 0:
                            continue
                        a, b = _trim(m[0])
                        if a >= b:
                            continue
                        word, sign, right, at = m[0][a:b], None, None, -1
                        if noisy and i == len(found) - 1 and m[0][-1] in SIGNS and len(m[0]) - b == 1 and k + 1 < len(rows) and (after := WORD.search(rows[k + 1]["text"])):
                            c, d = _trim(after[0])
                            if c == 0 and d > 0 and re.search(LETTERS, word[-1]) and re.search(LETTERS + "|[!|0-9]", after[0][0]):
                                sign, right, at, skip = m[0][-1], after[0][c:d], row["start"] + m.start() + b, k + 1
                        out.append((paper, lang, row["start"] + m.start() + a, word, row["provenance"] == "ocr", sign, at, right))
            yield pd.DataFrame(out, columns=["paper_id", "lang", "start", "word", "scanned", "sign", "sign_start", "right"])

    return cut(texts.mapInPandas(run, "paper_id string, lang string, start bigint, word string, scanned boolean, sign string, sign_start bigint, right string"))


def vocabulary(found: DataFrame) -> DataFrame:
    """(lang, word, n, capital, native): how often each word of whole lines stands, in lower case."""
    w = F.translate(F.lower("word"), "‐‑", "--")
    return cut(found.where("sign is null").groupBy("lang", w.alias("word")).agg(F.count("*").alias("n"), F.avg((F.lower("word") != F.col("word")).cast("double")).alias("capital"), F.sum((~F.col("scanned")).cast("long")).alias("native")))


def _join_features(x: pd.DataFrame) -> np.ndarray:
    log = lambda c: np.log1p(x[c].fillna(0).to_numpy(float))
    return np.column_stack([log("n_joined"), log("n_compound"), log("n_left"), log("n_right"), x["left"].str.len(), x["right"].str.len(), x["soft"].to_numpy(float), x["small"].to_numpy(float)]).astype(float)


def divided(found: DataFrame, words: DataFrame) -> DataFrame:
    """(paper_id, start, sign_start, word): signs that divide a word, and the word they divide."""
    ends = found.where("sign is not null").select("paper_id", "lang", "start", "sign_start", F.lower("word").alias("left"), F.lower("right").alias("right"), F.col("sign").isin("¬", "­").alias("soft"), F.col("right").rlike(r"^[\p{Ll}!|0-9]").alias("small"), F.concat("word", "right").alias("whole"))
    count = words.select("lang", F.col("word").alias("w"), F.col("n").alias("c"))
    with_count = lambda df, key, name: df.withColumn("w", key).join(count.withColumnRenamed("c", name), ["lang", "w"], "left").drop("w")

    def described(df: DataFrame) -> DataFrame:
        df = with_count(df, F.concat("left", "right"), "n_joined")
        df = with_count(df, F.concat("left", F.lit("-"), "right"), "n_compound")
        return with_count(with_count(df, F.col("left"), "n_left"), F.col("right"), "n_right")

    # training: words of whole lines divided on purpose, and compounds that stand with their sign within a line
    whole = words.where(r"length(word) >= 6 and n >= 2 and word rlike '^\\p{L}+$'").withColumn("k", (F.pmod(F.xxhash64("word"), F.length("word") - 3) + 2).cast("int"))
    yes = whole.select("lang", F.expr("left(word, k)").alias("left"), F.expr("substr(word, k + 1)").alias("right"), (F.pmod(F.xxhash64("word", F.lit(1)), F.lit(3)) == 0).alias("soft"), F.lit(True).alias("small"), F.lit(1).alias("y"), "word")
    compound = words.where(r"word rlike '^\\p{L}{2,}-\\p{L}+(-\\p{L}+)*$'")
    no = compound.select("lang", F.expr("regexp_extract(word, '^(.*)-', 1)").alias("left"), F.expr("substring_index(word, '-', -1)").alias("right"), F.lit(False).alias("soft"), F.lit(True).alias("small"), F.lit(0).alias("y"), "word")
    take = lambda df: df.orderBy(F.xxhash64("lang", "word")).limit(SAMPLE // 2)
    train = described(take(yes).unionByName(take(no))).toPandas()
    model = Boosted(trees=30, depth=3, least=3).fit(_join_features(train), train["y"].to_numpy(float)) if len(train) >= 20 and train["y"].nunique() == 2 else None

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if model:
                keep = model.predict(_join_features(x)) >= 0.5
            else:
                joined, compound = (x[c].fillna(0).to_numpy(float) for c in ("n_joined", "n_compound"))
                keep = x["soft"].to_numpy(bool) | (compound <= joined)
            yield x.loc[keep, ["paper_id", "start", "sign_start", "whole"]]

    return cut(described(ends).mapInPandas(judge, "paper_id string, start bigint, sign_start bigint, whole string").withColumnRenamed("whole", "word"))


_READ = {r: p for r, p in reversed(CONFUSIONS) if len(r) == 1 and not r.isalpha() and r != "."}  # the first of several counts


def shape(word: str) -> str:
    """The word as q-grams are taken of it: without accents, digits and signs as the letters they are read for."""
    w = "".join(_READ.get(c, c) for c in word.lower())
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return w.replace("rn", "m").replace("ii", "u").replace("vv", "w").replace("cl", "d")


_COARSE = str.maketrans({c: g[0] for g in ("eco", "a", "nu", "hb", "iltf", "gqyv", "s", "m", "d") for c in g} | {"a": "e"})


def coarse(word: str) -> str:
    """The shape with letters that are read for each other as one: a misread word mostly has the coarse shape of what was printed."""
    return shape(word).translate(_COARSE)


def coarse_forms(word: str) -> list[str]:
    """The coarse shape with cl as d, and without: cl may stand for d or for two letters, one of them misread."""
    parts = re.split("(?<=c)(?=l)", word.lower().replace("1", "l"))
    return sorted({coarse(word), "".join(coarse(p) for p in parts)})


def misread_cost(read: str, printed: str) -> float:
    """Weighted edit distance from what was printed to what was read; a known confusion costs a quarter."""
    known = set(CONFUSIONS)
    n, m = len(read), len(printed)
    row = [[float(j) for j in range(m + 1)]] + [[float(i + 1)] + [0.0] * m for i in range(n)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = read[i - 1], printed[j - 1]
            best = min(row[i - 1][j - 1] + (0 if a == b else 0.25 if (a, b) in known else 1.0), row[i - 1][j] + 1, row[i][j - 1] + 1)
            for la, lb in ((2, 1), (1, 2)):
                if i >= la and j >= lb and (read[i - la : i], printed[j - lb : j]) in known:
                    best = min(best, row[i - la][j - lb] + 0.25)
            row[i][j] = best
    return row[n][m]


def misread(word: str, rng: random.Random) -> str:
    """A word with one to three of its characters misread."""
    table = [(r, p) for r, p in CONFUSIONS if p in word and r != p]
    out = word
    for r, p in rng.sample(table, min(len(table), rng.choice([1, 1, 2, 3]))):
        places = [m.start() for m in re.finditer(re.escape(p), out)]
        if places:
            k = rng.choice(places)
            out = out[:k] + r + out[k + len(p) :]
    return out


#: Share of a suspect's q-grams that a correction has at least.
SHARED = 0.6


def grams(shape: Column) -> Column:
    """Character triples of the padded shape."""
    padded = F.concat(F.lit("^"), shape, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


#: more: how many times more often the correction stands than the suspect; a larger corpus has more of both.
FEATURES = ["cost", "edits", "more", "length", "odd", "capital", "odd_right", "same_shape"]


#: How much rarer on native pages than on scanned ones, by its share of the words, a suspect is at least.
RARER = 8


def counted(words: DataFrame) -> DataFrame:
    """Adds trusted: whether a word is frequent and not one that only scanned pages show; and rare: whether native pages lack it."""
    total = words.groupBy("lang").agg(F.sum("native").alias("natives"), F.sum(F.col("n") - F.col("native")).alias("scans"))
    scanned = F.col("n") - F.col("native")
    rare = F.col("native") * F.col("scans") * RARER <= scanned * F.col("natives")
    missed = rare & (F.col("natives") > 0) & (scanned * F.col("natives") >= EXPECTED * F.col("scans"))
    return words.join(F.broadcast(total), "lang").select(*words.columns, ((F.col("n") >= TRUSTED) & ~missed).alias("trusted"), rare.alias("rare"))


def indexed(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trusted words with the triples of each form, inverted index, triples by how many forms have them), built once for all searches."""
    forms = F.pandas_udf(lambda s: s.map(coarse_forms), ArrayType(StringType()))
    good = counted(words).where(F.col("trusted") & F.col("word").rlike(r"^\p{L}[\p{L}’'-]*\p{L}$")).select("lang", F.col("word").alias("right"), F.col("n").alias("m"))
    b = cut(good.withColumn("form", F.explode(forms("right"))).withColumn("other", grams(F.col("form"))))
    index = cut(b.select("lang", "right", "form", "m", F.size("other").alias("size"), F.explode(F.array_distinct("other")).alias("g")))
    return b, index, cut(index.groupBy("lang", "g").agg(F.count("*").alias("df")))


def candidates(suspects: DataFrame, words: DataFrame, built: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """suspects(lang, word, n, capital) -> with each trusted word (right) of the language that shares enough q-grams, or its own shape."""
    shaped = F.pandas_udf(lambda s: s.map(shape), StringType())
    forms = F.pandas_udf(lambda s: s.map(coarse_forms), ArrayType(StringType()))
    b, index, rare = built or indexed(words)
    a = cut(suspects.withColumn("rough", F.explode(forms("word"))).withColumn("grams", grams(F.col("rough"))))
    # prefix filter: of a suspect's different grams, rarest first, a correction that shares the least number of them has one of the first
    least = F.greatest(F.lit(1), F.ceil(SHARED * F.size("grams") - 1).cast("int"))
    own = a.select("lang", "word", "rough", "n", F.size("grams").alias("k"), (F.size(F.array_distinct("grams")) - least + 1).alias("take"), F.explode(F.array_distinct("grams")).alias("g")).join(rare, ["lang", "g"], "left")
    first = own.groupBy("lang", "word", "rough", "n", "k", "take").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("s"))
    first = first.select("lang", "word", "rough", "n", "k", F.explode(F.slice("s", F.lit(1), F.greatest(F.col("take"), F.lit(0)))).alias("y")).where("y.df > 0").withColumn("g", F.col("y.g"))
    hit = first.join(index, ["lang", "g"]).where("word <> right and m >= n and abs(k - size) <= 2").select("lang", "word", "rough", "right", "form").distinct()
    full = hit.join(a, ["lang", "word", "rough"]).join(b, ["lang", "right", "form"])
    near = full.where(F.size(F.array_intersect("grams", "other")) >= SHARED * F.size("grams") - 1).select("lang", "word", "n", "capital", "right", "m").distinct()
    own_shape = suspects.where(F.col("word").rlike(r"\p{L}[0-9!|]|[0-9!|]\p{L}")).withColumn("right", shaped("word")).where("right <> word")
    return near.unionByName(own_shape.select("lang", "word", "n", "capital", "right", F.lit(0).cast("bigint").alias("m")))


def features(x: pd.DataFrame) -> np.ndarray:
    odd = x["word"].str.count(r"[^\W\d_][0-9!|.]+(?=[^\W\d_])|^[0-9!|](?=[^\W\d_])|(?<=[^\W\d_]{2})[0-9]$").to_numpy()
    cost = np.array([misread_cost(w, r) for w, r in zip(x["word"], x["right"], strict=True)])
    edits = np.array([sum(p != q for p, q in zip(w, r)) + abs(len(w) - len(r)) for w, r in zip(x["word"], x["right"], strict=True)])
    same = np.array([shape(w) == shape(r) for w, r in zip(x["word"], x["right"], strict=True)])
    more = np.where(x["m"] > 0, np.log(np.maximum(x["m"], 1) / np.maximum(x["n"], 1)), -1.0)
    return np.column_stack([cost, edits, more, x["word"].str.len(), odd > 0, x["capital"], x["m"] == 0, same]).astype(float)


def trained(words: DataFrame, built: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Boosted | None:
    """Ranker of corrections: native words misread on purpose with their origin, against rare native words with what is near them."""
    letters = words.where((F.length("word") >= 4) & F.col("word").rlike(r"^\p{L}+$"))
    take = lambda df: df.orderBy(F.xxhash64("lang", "word")).limit(SAMPLE // 4)
    native = take(letters.where("native > 0")).toPandas()
    few = len(native) < 50
    if few:  # trusted words of scanned pages serve as well
        native = take(letters.where((F.col("native") > 0) | (F.col("n") >= TRUSTED))).toPandas()
    if native.empty:
        return None
    # a stream of its own for each word and turn, so that one word more or less changes nothing for the others
    made = [(l, misread(w, random.Random(f"{SEED} {k} {l} {w}")), 1, c, w) for l, w, c in zip(native["lang"], native["word"], native["capital"], strict=True) for k in range(MISREADINGS)]
    made = pd.DataFrame([x for x in made if x[1] != x[4]], columns=["lang", "word", "n", "capital", "truth"]).drop_duplicates(["lang", "word"])
    made = made[~made["word"].isin(set(native["word"]))]
    if made.empty:
        return None
    spark = words.sparkSession
    truth = spark.createDataFrame(made)
    rare = words.where((F.col("native") > 0) & (F.col("n") == F.col("native")) & (F.col("n") <= 3) & (F.length("word") >= 4)).orderBy(F.xxhash64("lang", "word")).limit(SAMPLE // 4).select("lang", "word", "n", "capital")
    if few:
        rare = take(letters.where(F.col("n") >= TRUSTED)).select("lang", "word", F.lit(1).cast("bigint").alias("n"), "capital")
    known = truth.select("lang", "word", "truth")
    asked = truth.drop("truth").unionByName(rare.join(known, ["lang", "word"], "left_anti").select("lang", "word", "n", "capital"))
    found = candidates(asked, words, built).join(known, ["lang", "word"], "left").withColumn("truth", F.coalesce("truth", F.lit("")))
    data = found.orderBy(F.xxhash64("lang", "word", "right")).limit(SAMPLE).toPandas()
    y = ((data["truth"] == data["right"]) | ((data["m"] == 0) & (data["truth"].map(shape) == data["right"]))).to_numpy(float)
    return Boosted(trees=100, depth=4).fit(features(data), y) if 0 < y.sum() < len(y) else None


def by_rule(x: np.ndarray) -> np.ndarray:
    """Where nothing can be learned: known confusions of a far more frequent trusted word; a digit or sign within may cost more."""
    cost, odd = x[:, FEATURES.index("cost")], x[:, FEATURES.index("odd")] > 0
    return np.where((x[:, FEATURES.index("more")] > 0) & ((cost <= 0.5) | (odd & (cost <= 1))), 1 / (1 + cost), 0.0)


def corrections(words: DataFrame) -> DataFrame:
    """(lang, word, right): misread words of scanned pages and the best ranked correction of each."""
    known = counted(words)
    suspects = known.where((F.length("word") >= 3) & (F.col("n") > F.col("native")) & ((F.col("native") == 0) | F.col("rare")) & F.col("word").rlike(r"\p{L}.*\p{L}|[!|0-9]\p{L}"))
    built = indexed(words)
    model = trained(words, built)
    judge = model.predict if model else by_rule

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x = x[x["m"].eq(0) | (x["m"] >= 8 * x["n"])]
            yield x.assign(p=judge(features(x)))[["lang", "word", "right", "p"]] if len(x) else pd.DataFrame(columns=["lang", "word", "right", "p"])

    ranked = candidates(suspects.select("lang", "word", "n", "capital"), words, built).mapInPandas(rank, "lang string, word string, right string, p double")
    # candidates share the belief that a word is misread: the best one stands for it if any is right with a half or more
    none = F.sum(F.log(1 - F.least("p", F.lit(0.999))))
    best = ranked.where("p >= 0.02").groupBy("lang", "word").agg(F.max(F.struct("p", "right")).alias("best"), none.alias("none"))
    return cut(best.where(F.exp("none") <= 0.5).select("lang", "word", F.col("best.right").alias("right")))


def analysed(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(furniture, dividing signs, misread words with corrections, lines) of the papers with scanned pages."""
    rows = lines(papers)
    noise = furniture(rows)
    found = tokens(body(rows, noise))
    words = vocabulary(found)
    signs = divided(found, words)
    whole = found.join(signs.select("paper_id", "start", F.col("word").alias("joined")), ["paper_id", "start"], "left")
    whole = cut(whole.select("paper_id", "lang", "start", "scanned", F.coalesce("joined", "word").alias("word")))
    counts = vocabulary(whole.withColumn("sign", F.lit(None).cast("string")))
    wrong = corrections(counts)
    bad = whole.where("scanned").withColumn("key", F.translate(F.lower("word"), "‐‑", "--")).join(wrong.withColumnRenamed("word", "key"), ["lang", "key"]).select("paper_id", "start", "word", "right")
    return noise, signs, bad, rows


def noise(papers: DataFrame) -> DataFrame:
    """papers(paper_id, text, pages) -> (paper_id, noise_start, noise_kind), once per place and kind.

    Papers without a scanned page, with null text or null pages have none; a page without text has none.
    """
    furniture_rows, signs, bad, _ = analysed(papers)
    return (
        furniture_rows.select("paper_id", F.col("start").alias("noise_start"), "noise_kind")
        .unionByName(signs.select("paper_id", F.col("sign_start").alias("noise_start"), F.lit("hyphen").alias("noise_kind")))
        .unionByName(bad.select("paper_id", F.col("start").alias("noise_start"), F.lit("misread").alias("noise_kind"))).distinct()
    )


def repaired(papers: DataFrame) -> DataFrame:
    """(paper_id, text): the papers with scanned pages as paragraphs, without furniture, with divided and misread words put right.

    A paragraph ends at a blank line. Corrections keep a capital first letter.
    """
    furniture_rows, signs, bad, rows = analysed(papers)
    marks = (
        furniture_rows.select("paper_id", F.struct("start", F.lit("f").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b")).alias("m"))
        .unionByName(signs.select("paper_id", F.struct(F.col("sign_start").alias("start"), F.lit("h").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b")).alias("m")))
        .unionByName(bad.select("paper_id", F.struct("start", F.lit("w").alias("kind"), F.col("word").alias("a"), F.col("right").alias("b")).alias("m")))
        .groupBy("paper_id").agg(F.array_sort(F.collect_list("m")).alias("marks"))
    )
    scanned = papers.join(rows.where("noisy").select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", "text").join(marks, "paper_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"paper_id": batch["paper_id"], "text": [put_right(t, [] if m is None else list(m)) for t, m in zip(batch["text"], batch["marks"], strict=True)]})

    return scanned.mapInPandas(run, "paper_id string, text string")


def put_right(text: str, marks: list[dict]) -> str:
    """Text with marked furniture lines dropped, divided words joined and misread words replaced, as one line per paragraph."""
    chars: list[str] = list(text)
    for m in marks:
        k = m["start"]
        if m["kind"] == "f":
            end = text.find("\n", k)
            end = len(text) if end < 0 else end + 1
            for i in range(k, end):
                chars[i] = ""
    for m in marks:
        k = m["start"]
        if m["kind"] == "h":
            i = k
            chars[i] = ""
            i += 1
            while i < len(text) and (chars[i] == "" or text[i].isspace()):
                chars[i] = ""
                i += 1
        elif m["kind"] == "w":
            i, left = k, len(m["a"])
            right = m["b"][:1].upper() + m["b"][1:] if m["a"][:1].isupper() else m["b"]
            first = True
            while i < len(text) and left:
                if chars[i] and not text[i].isspace() and text[i] not in SIGNS or (text[i] in SIGNS and chars[i] and m["a"][len(m["a"]) - left] == text[i]):
                    left -= 1
                    chars[i] = right if first else ""
                    first = False
                i += 1
    out = "".join(chars)
    return "\n\n".join(re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", out) if p.strip())
