"""Problem 7: matching entities across sources without keys.

Method: similarity vectors of candidate pairs are modelled by two Gaussians, matched and unmatched, fitted without labels
by expectation-maximisation with covariances regularised by the distance of the means. Between rounds transitivity is
enforced: pairs that are firmly matched join their texts into groups, and a pair inside a group is held to be at least as
likely as the firm chain that connects it, unless its own facts contradict. The posteriors are the confidences.

Queries and entries are first reduced to classes of equal (title, first author, year, part), so a publication with any
share of the rows is compared once per way of writing it. Vectors are counted on a grid whose size doesn't depend on the
data; EM runs over these counts, that is over all candidate pairs whose titles share two fifths of their weight.

Candidate pairs are never shuffled or kept as such: every part of the queries meets every part of the entries in a task,
which finds the pairs that share a block key and keeps those that may still match; of the others it gives the counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .lookalike import fold

# Words of organisations' names that many share.
GENERIC = ["university", "univ", "institute", "inst", "office", "stat", "statistical", "statistics", "national", "natl", "laboratory", "lab", "consortium", "citation", "oceanography", "oceanogr", "oceanographic", "centre", "center", "department", "dept", "society", "association", "collab", "the", "for", "and", "von", "van", "del", "dos"]
STOP = ["the", "and", "for", "from", "with", "how", "its", "their", "into", "under", "upon", "new", "approach", "theory", "toward", "towards", "using"]
MARK = r"\s((?:an? )?(?:reply|comment|response|rejoinder|addendum|erratum|corrigendum|correction|supplement)|revisited|part (?:[ivx]+|\d+|one|two|three)|[ivx]{2,4}(?: \w+)?)$"
GRID = 20
FIRM = 0.95
#: Least weight (logarithm of rarity) of a word that makes block keys.
TELLING = 2.5
#: A matched pair's mean similarities lie at least here, so that the two Gaussians can't change places.
ANCHOR = np.array([0.88, 0.85, 0.85, 0.98])
ROUNDS = 40
TURNS = 2


def plain_title(text: Column) -> Column:
    """Folded, lower case, words divided at a line's end joined, one blank between words."""
    t = F.lower(fold(text))
    t = F.regexp_replace(t, r"(?<=\p{L})[-‐]\s+(?=\p{L})", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\p{M}\p{Cf}]", ""), r"[^\p{L}\p{N}]+", " "))


def generic(word: Column) -> Column:
    """Whether a word is generic, or a long one with one letter changed, added or dropped."""
    long = F.array(*(F.lit(g) for g in GENERIC if len(g) >= 6))
    return F.array_contains(F.array(*map(F.lit, GENERIC)), word) | ((F.length(word) >= 6) & F.exists(long, lambda g: F.levenshtein(word, g, 1) >= 0))


def surname(author: Column) -> Column:
    """The folded family name of a person, or the most telling word of an organisation; null where there is none."""
    a = F.lower(fold(F.trim(author)))
    head = F.when(a.contains(",") & ~a.rlike(r"\b(institute|office|universit|laborator)"), F.substring_index(a, ",", 1)).otherwise(a)
    words = F.filter(F.split(F.regexp_replace(head, r"[\p{M}\p{Cf}]", ""), r"[^\p{L}']+"), lambda w: (F.length(w) >= 3) & ~generic(w))
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def described(rows: DataFrame, key: str, title: Column, author: Column, year: Column) -> DataFrame:
    """(key, title, mark, author, year) for comparison."""
    t = plain_title(title)
    mark = F.regexp_extract(t, MARK, 1)
    kind = F.regexp_replace(F.regexp_replace(mark, r"^(an? |part )", ""), r"^([ivx]{2,4}) .*", "$1")
    return rows.select(
        F.col(key), F.when(mark != "", F.regexp_replace(t, MARK, "")).otherwise(t).alias("title"), kind.alias("mark"), surname(author).alias("author"), year.cast("int").alias("year")
    ).where("title is not null and title <> ''")


def of_queries(queries: DataFrame) -> DataFrame:
    return described(queries.where("query_id is not null"), "query_id", F.col("title"), F.col("first_author"), F.col("year"))


def printed_title(raw: Column) -> Column:
    """The title as a printed reference shows it: in quotation marks, after the year, or the longest part."""
    t = F.regexp_replace(raw, r"\s+", " ")
    quoted = F.regexp_extract(t, "[“\"]([^”\"]{8,})[”\"]", 1)
    after = F.regexp_extract(t, r"\((?:\d{4}[a-z]?|n\.d\.)\)[.,:]? (.{8,}?)\. (?=\p{Lu})", 1)
    parts = F.split(t, r"(?<=\p{L}{3})[.,] ")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(after, F.lit("")), longest)


def of_entries(entries: DataFrame) -> DataFrame:
    """Titles, authors and years of the parsed fields where they are known, else as raw_text prints them."""
    field = lambda p: F.nullif(F.get_json_object("fields", p), F.lit(""))
    authors = F.from_json(F.get_json_object("fields", "$.authors.value"), "array<string>")
    first = F.substring_index(F.substring_index(F.substring_index(F.substring_index(F.regexp_replace(F.regexp_replace("raw_text", r"\s+", " "), r"(?<=\p{L}{3})\. .*$", ""), ",", 1), "&", 1), "(", 1), " and ", 1)
    year = F.expr(r"try_cast(regexp_extract(coalesce(get_json_object(fields, '$.year.value'), regexp_extract(raw_text, '[(\\[ ]((1[89]|20)\\d\\d)[a-z]?[)\\].]', 1)), '\\d{4}', 0) as int)")
    rows = entries.where("id is not null and raw_text is not null")
    return described(rows, "id", F.coalesce(field("$.title.value"), printed_title(F.col("raw_text"))), F.coalesce(F.get(authors, F.lit(0)), first), year).withColumnRenamed("id", "entry_id")


def classes(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(class table with a number as cls, membership key -> class)."""
    parts = ["title", "mark", "author", "year"]
    tagged = cut(rows.withColumn("text", F.unhex(F.md5(F.concat_ws("\u0001", "title", "mark", F.coalesce("author", F.lit("\u0002")), F.coalesce(F.col("year").cast("string"), F.lit("\u0002")))))))
    # numbers are given to rows that are written already, so they stay the same however often they are read
    found = cut(tagged.groupBy("text").agg(*(F.any_value(p).alias(p) for p in parts))).withColumn("cls", F.monotonically_increasing_id())
    return found.select("cls", *parts), tagged.select(key, "text").join(found.select("text", "cls"), "text").select(key, "cls")


def weighted(side: DataFrame, rarity: DataFrame) -> DataFrame:
    """The title of words that one blank divides, and the weight of each, the logarithm of how rare it is among all titles."""
    words = side.select("cls", F.posexplode(F.split("title", " ")).alias("i", "word")).where("word <> ''")
    both = words.join(rarity, "word").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("i", "word", "weight"))).alias("x"))
    both = both.select("cls", F.concat_ws(" ", F.transform("x", lambda x: x["word"])).alias("title"), F.transform("x", lambda x: x["weight"]).alias("weights"))
    return side.drop("title").join(both, "cls")


def rarity_of(sides: list[DataFrame], total: int) -> DataFrame:
    """(word, weight) over the titles of all classes of both sides."""
    words = sides[0].select("title").unionByName(sides[1].select("title")).select(F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    return cut(words.groupBy("word").agg(F.count("*").alias("n")).select("word", (F.log(F.lit(total + 1.0) / F.col("n")) + 0.05).alias("weight")))


def near(a: str, b: str) -> bool:
    """Whether two different words are the same one mistyped (one letter changed, added, dropped, or two swapped) or cut short."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) >= 3 and len(b) - len(a) >= 2:
        return b.startswith(a)
    if len(a) < 4 or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def title_similarity(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> float:
    """Mean of the shared weight's part in both titles and in the lighter one; a mistyped or divided word counts nine tenths."""
    left = dict(zip(b, wb, strict=True))
    heavy_a, heavy_b, shared, rest = sum(wa), sum(wb), 0.0, []
    for w, x in zip(a, wa, strict=True):
        if w in left:
            shared += x
            del left[w]
        else:
            rest.append((w, x))
    joined = {p + q: (p, q) for p, q in zip(b, b[1:])}
    for k, (w, x) in enumerate(rest):
        if w in joined and all(p in left for p in joined[w]):
            shared += 0.9 * x
            for p in joined[w]:
                left.pop(p, None)
        elif k + 1 < len(rest) and w + rest[k + 1][0] in left:
            shared += 0.9 * left.pop(w + rest[k + 1][0])
        elif (hit := next((p for p in left if near(w, p)), None)) is not None:
            shared += 0.9 * min(x, left.pop(hit)) if x < 1 else 0.9 * x
            left.pop(hit, None)
    return min(1.0, 0.5 * 2 * shared / max(heavy_a + heavy_b, 1e-9) + 0.5 * shared / max(min(heavy_a, heavy_b), 1e-9))


#: Classes of queries and of entries that one task compares at most, tasks at least, and pairs that it compares at once.
PART_Q, PART_E, LEAST_BLOCKS, AT_ONCE = 250_000, 500_000, 16, 40_000
#: Different words of a title, and letters of an author, that are compared as columns of a matrix; what has more is compared by itself.
WIDE, NAME = 14, 24
BITS = 22


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of several whole numbers, row by row."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.int64).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def near_words(words: list[str]) -> list[tuple[int, int]]:
    """All pairs (i, j), i < j, of different words that are near."""
    at, by = {w: i for i, w in enumerate(words)}, defaultdict(list)
    found = set()
    for i, w in enumerate(words):
        for k in range(3, len(w) - 1):
            if (j := at.get(w[:k])) is not None:
                found.add((min(i, j), max(i, j)))
        if len(w) >= 4:
            for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                by[v].append(i)
    for same in by.values():
        found |= {(i, j) for x, i in enumerate(same) for j in same[x + 1 :] if (i, j) not in found and near(words[i], words[j])}
    return sorted(found)


class Side:
    """The classes of one side of a block as arrays; the words of both sides have numbers in common."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows = rows.combine_chunks()
        self.cls = rows["cls"].to_numpy()
        lists = pc.split_pattern(rows["title"], " ").combine_chunks()
        self.start = np.asarray(lists.offsets, np.int64)
        self.start, self.flat = self.start - self.start[0], lists.flatten()
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.start))
        self.weight = rows["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.year = rows["year"].fill_null(0).to_numpy().astype(np.int64)
        self.dated = rows["year"].is_valid().to_numpy()
        self.named = rows["author"].is_valid().to_numpy()

    def arranged(self, word: np.ndarray, mark: np.ndarray, author: np.ndarray, divides: np.ndarray) -> None:
        """Different words of each class as a matrix; odd: classes of too many words or with words that join to another one."""
        n = len(self.rows)
        self.word, self.mark, self.author = word, mark, author
        self.heavy = np.bincount(self.row, self.weight, n)
        once = np.unique(self.row * (1 << 32) + word, return_index=True, return_counts=True)
        order = np.argsort(once[1], kind="stable")  # in the order of the title
        first, times = once[1][order], once[2][order]
        row = self.row[first]
        place = np.arange(len(first)) - np.searchsorted(row, row)
        fits = place < WIDE
        self.words, self.again = np.full((n, WIDE), -1, np.int32), np.zeros((n, WIDE), bool)
        for to, what in ((self.words, word[first]), (self.again, times > 1)):
            to[row[fits], place[fits]] = what[fits]
        self.odd = np.zeros(n, bool)
        self.odd[row[~fits]] = True
        for k in range(0, n, AT_ONCE):
            self.odd[k : k + AT_ONCE] |= hit(divides, self.words[k : k + AT_ONCE], self.words[k : k + AT_ONCE]).any((1, 2))

    def keys(self, a: int, b: int, short: np.ndarray, usable: np.ndarray, ends: tuple[np.ndarray, np.ndarray], years: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(class, key) of the classes from a to b: first author with a title word, three telling title words in a row, two of them with the year.

        Words that over a twelfth of all titles have tell nothing and make no keys, unless the title has too few others.
        """
        n, s = b - a, slice(self.start[a], self.start[b])
        row, word, weight = self.row[s] - a, self.word[s], self.weight[s]
        named, dated, year, ends = self.named[a:b], self.dated[a:b], self.year[a:b], [x[self.author[a:b]] for x in ends]
        ok = usable[word]
        telling = ok & (weight >= TELLING)
        ok = np.where((np.bincount(row, telling, n) >= 3)[row], telling, ok)
        row, w = row[ok], short[word[ok]]
        many = np.bincount(row, minlength=n)
        at = np.arange(max(0, len(row) - 2))
        at = at[row[at] == row[at + 2]]
        by_name = named[row]
        out = [(row[by_name], mixed(kind, end[row[by_name]], w[by_name])) for kind, end in zip((1, 2), ends, strict=True)]
        out.append((row[at], mixed(3, w[at], w[at + 1], w[at + 2])))
        at = at[dated[row[at]]]
        for y in years:
            out += [(row[at], mixed(4, w[at], w[at + k], year[row[at]] + y)) for k in (1, 2)]
        few = np.flatnonzero(many < 3)
        one, two = np.full(n, -1), np.full(n, -1)
        lead = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        one[row[lead]], two[row[~lead]] = w[lead], w[~lead]
        out.append((few, mixed(5, one[few], two[few])))
        return np.concatenate([x for x, _ in out]).astype(np.int32) + np.int32(a), np.concatenate([x for _, x in out])

    def title(self, k: int, vocabulary: list[str]) -> tuple[list[str], list[float]]:
        s = slice(self.start[k], self.start[k + 1])
        return [vocabulary[i] for i in self.word[s]], self.weight[s].tolist()


def places(pairs: list[tuple[int, int]]) -> np.ndarray:
    """A table of bits that holds pairs of numbers; a few others seem to be in it."""
    out = np.zeros(1 << BITS, bool)
    if pairs:
        a, b = np.array(pairs).T
        out[_slot(a, 1) ^ _slot(b, 2)] = True
    return out


def _slot(word: np.ndarray, side: int) -> np.ndarray:
    return (mixed(side, word) >> np.uint64(64 - BITS)).astype(np.int32)


def hit(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of the rows of a and of b are pairs of the table."""
    return table[_slot(a, 1)[:, :, None] ^ _slot(b, 2)[:, None, :]] & (a >= 0)[:, :, None] & (b >= 0)[:, None, :]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, left + (x != y))
    return row[-1]


def distances(letters: np.ndarray, size: np.ndarray, names: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of names, given by their numbers, all at once."""
    x, y, m, n = letters[a].T, letters[b].T, size[a], size[b]
    rows, each = [np.full(len(a), j, np.int16) for j in range(n.max(initial=0) + 1)], np.arange(len(a))
    out = n.astype(np.int16)
    for i in range(min(m.max(initial=0), NAME)):
        last, rows = rows, [np.full(len(a), i + 1, np.int16)]
        for j in range(min(len(last) - 1, NAME)):
            rows.append(np.minimum(np.minimum(last[j + 1], rows[j]) + 1, last[j] + (x[i] != y[j])))
        done = (m == i + 1) & (n < len(rows))
        out[done] = np.stack(rows)[n[done], each[done]]
    out = out.astype(np.int64)
    for k in np.flatnonzero((m > NAME) | (n > NAME)):
        out[k] = levenshtein(names[a[k]], names[b[k]])
    return out


def stepped(x: np.ndarray) -> np.ndarray:
    return np.floor(x * GRID + 0.5).astype(np.int64)


def numbered(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Numbers of the values of two columns, null as one of its own, and the values."""
    both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode("encode")
    n = both.indices.to_numpy(zero_copy_only=False)
    return n[: len(a)].astype(np.int64), n[len(a) :].astype(np.int64), both.dictionary.to_pylist()


def compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part of the queries with a part of the entries: the pairs (q, e, cell) that share a block key, title similarity
    of two fifths and no fact that rules a match out, and how many others (n) of each cell there are."""
    schema = pa.schema([("q", pa.list_(pa.int64())), ("e", pa.list_(pa.int64())), ("cell", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    if not len(left) or not len(right):
        return schema.empty_table()
    q, e = Side(left), Side(right)
    wq, we, vocabulary = numbered(q.flat, e.flat)
    mq, me, _ = numbered(q.rows["mark"].combine_chunks(), e.rows["mark"].combine_chunks())
    aq, ae, names = numbered(q.rows["author"].combine_chunks(), e.rows["author"].combine_chunks())
    names = [x or "" for x in names]
    weights = np.zeros(len(vocabulary))
    weights[wq], weights[we] = q.weight, e.weight
    at = {w: i for i, w in enumerate(vocabulary)}
    divides = places([(at[w[:k]], at[w[k:]]) for w in vocabulary for k in range(1, len(w)) if w[:k] in at and w[k:] in at])
    close = near_words(vocabulary)
    close = places(close + [(j, i) for i, j in close])
    q.arranged(wq, mq, aq, divides)
    e.arranged(we, me, ae, divides)
    letters, size = np.zeros((len(names), NAME), np.int32), np.array([len(x) for x in names], np.int64)
    for k, x in enumerate(names):
        letters[k, : min(len(x), NAME)] = [ord(c) for c in x[:NAME]]
    number = lambda words: np.unique(np.array(words, object), return_inverse=True)[1]
    short, usable = number([w[:5] for w in vocabulary]), np.array([len(w) >= 3 and w not in STOP for w in vocabulary])
    first, final = number([x[:6] for x in names]), number([x[-6:] for x in names])
    row, key = q.keys(0, len(q.rows), short, usable, (first, final), [-1, 0, 1])
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    out, dead = [], np.zeros((GRID + 2) ** 4, np.int64)
    for pairs in sharing(row, key, len(q.rows), e, (short, usable, (first, final))):
        for k in range(0, len(pairs), AT_ONCE):
            i, j = pairs[k : k + AT_ONCE] % len(q.rows), pairs[k : k + AT_ONCE] // len(q.rows)
            a, b = q.words[i], e.words[j]
            same = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
            in_a, in_b = same.any(2), same.any(1)
            shared = (weights[a] * in_a).sum(1)
            alone = q.odd[i] | e.odd[j] | (hit(close, a, b) & (~in_a | q.again[i])[:, :, None] & ~in_b[:, None, :]).any((1, 2))
            title = np.minimum(1.0, shared / np.maximum(q.heavy[i] + e.heavy[j], 1e-9) + 0.5 * shared / np.maximum(np.minimum(q.heavy[i], e.heavy[j]), 1e-9))
            for x in np.flatnonzero(alone):
                title[x] = title_similarity(*q.title(i[x], vocabulary), *e.title(j[x], vocabulary))
            title = stepped(title)
            kept = title >= GRID * 0.4
            i, j, title = i[kept], j[kept], title[kept]
            x, y = q.author[i], e.author[j]
            two, back = np.unique(x * len(names) + y, return_inverse=True)
            apart = distances(letters, size, names, two // len(names), two % len(names))[back]
            author = np.where(q.named[i] & e.named[j], stepped(1 - apart / np.maximum(np.maximum(size[x], size[y]), 1)), -1)
            gap = np.abs(q.year[i] - e.year[j])
            year = np.where(q.dated[i] & e.dated[j], stepped(np.select([gap == 0, gap == 1, gap == 2], [1.0, 0.75, 0.2], 0.0)), -1)
            mark = np.where(q.mark[i] == e.mark[j], GRID, 0)
            cell = packed(title, author, year, mark)
            live = may_match(title / GRID, author / GRID, year / GRID, mark / GRID)
            dead += np.bincount(cell[~live], minlength=len(dead))
            if live.any():
                out.append((q.cls[i[live]], e.cls[j[live]], cell[live].astype(np.int32), None))
    rest = np.flatnonzero(dead)
    out.append((None, None, rest.astype(np.int32), dead[rest]))
    return pa.Table.from_arrays([pa.array([x[k] for x in out], schema.field(k).type) for k in range(4)], schema=schema)


def sharing(row: np.ndarray, key: np.ndarray, n_q: int, e: Side, known: tuple) -> Iterator[np.ndarray]:
    """Pairs (entry times n_q plus query) that share a key, once each; row and key are those of the queries, by key."""
    for a in range(0, len(e.rows), AT_ONCE):
        row_e, key_e = e.keys(a, min(a + AT_ONCE, len(e.rows)), *known, [0])
        low, many = np.searchsorted(key, key_e, "left"), np.searchsorted(key, key_e, "right")
        many -= low
        order = np.flatnonzero(many)
        order = order[np.argsort(row_e[order], kind="stable")]
        row_e, low, many = row_e[order], low[order], many[order]
        sums = np.r_[0, many.cumsum()]
        begin = 0
        while begin < len(row_e):
            end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + 4 * AT_ONCE, "right")) - 1)
            end = int(np.searchsorted(row_e, row_e[end - 1], "right"))  # all keys of an entry together
            n = many[begin:end]
            place = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low[begin:end], n)
            yield np.unique(np.repeat(row_e[begin:end].astype(np.int64), n) * n_q + row[place])
            begin = end


def packed(*features: np.ndarray) -> np.ndarray:
    """The number of a grid cell."""
    out = 0
    for x in features:
        out = out * (GRID + 2) + x + 1
    return out


def unpacked(cell: np.ndarray) -> np.ndarray:
    return np.stack([cell // (GRID + 2) ** k % (GRID + 2) - 1 for k in (3, 2, 1, 0)], 1)


def never(title: np.ndarray, author: np.ndarray, year: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """What no matched pair shows: another part, half of the title missing, or author and year both wrong."""
    return (mark == 0) | (title < 0.5) | ((year == 0) & (author >= 0) & (author < 0.6))


def chainable(title: np.ndarray, author: np.ndarray, year: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """What doesn't contradict a chain of firm matches."""
    return (mark > 0) & (year != 0) & ((author < 0) | (author >= 0.6))


def may_match(*features: np.ndarray) -> np.ndarray:
    return ~never(*features) | chainable(*features)


def densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log density of known features (unknown ones are left out)."""
    part = -0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var)
    return np.where(x < 0, 0.0, part).sum(1)


def fit(cell: np.ndarray, weight: np.ndarray, held: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each grid cell; held is the least posterior that transitivity leaves a cell's pairs on average."""
    x = cell / GRID
    x[cell < 0] = -1
    known = x >= 0
    out = never(*x.T)
    post = start if start is not None else ((x[:, 0] > 0.85) & (x[:, 3] > 0.5) & ((x[:, 1] > 0.75) | (x[:, 2] > 0.7))).astype(float) * 0.98 + 0.01
    for _ in range(ROUNDS):
        post = np.where(out, 0.0, np.maximum(post, held))
        mean, var = np.zeros((2, 4)), np.zeros((2, 4))
        for k, w in enumerate((weight * (1 - post), weight * post)):
            wk = w[:, None] * known
            mean[k] = (wk * x).sum(0) / np.maximum(wk.sum(0), 1e-9)
            mean[k] = np.maximum(mean[k], ANCHOR) if k else mean[k]
            var[k] = (wk * (x - mean[k]) ** 2).sum(0) / np.maximum(wk.sum(0), 1e-9)
        var = np.maximum(var + 0.15 * (mean[1] - mean[0]) ** 2, 0.004)
        prior = np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.9)
        logit = np.log(prior / (1 - prior)) + densities(x, mean[1], var[1]) - densities(x, mean[0], var[0])
        # a vector above the matched mean is no worse a match for it
        top = np.minimum(x, mean[1])
        top[x < 0] = -1
        logit = np.maximum(logit, np.log(prior / (1 - prior)) + densities(top, mean[1], var[1]) - densities(top, mean[0], var[0]))
        post = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    return np.where(out, 0.0, post)


def matches(queries: DataFrame, entries: DataFrame, least: float = 0.5) -> DataFrame:
    """queries(query_id, title, year, first_author), entries(id, raw_text, fields) -> (query_id, entry_id, confidence).

    One row per pair of rows that mean the same publication with a confidence of at least `least`. Null or empty titles
    and raw texts match nothing; a null year or author leaves that feature out; repeated rows match each by themselves
    under their id.
    """
    qc, qm = classes(of_queries(queries), "query_id")
    ec, em = classes(of_entries(entries), "entry_id")
    sizes = qc.count(), ec.count()
    rarity = rarity_of([qc, ec], sum(sizes))
    vectors = candidates(weighted(qc, rarity), weighted(ec, rarity), sizes)
    live = vectors.where("q is not null").select(F.explode(F.arrays_zip("q", "e", "cell")).alias("x")).select("x.*")
    dead = vectors.where("q is null").select(F.explode(F.arrays_zip("cell", "n")).alias("x")).select("x.*")
    grid = live.select("cell", F.lit(1).cast("bigint").alias("n")).unionByName(dead).groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()  # at most 22 to the power of 4 cells
    if grid.empty:
        return queries.select("query_id", F.lit(None).cast("string").alias("entry_id"), F.lit(0.0).alias("confidence")).where("false")
    cell, weight = unpacked(grid["cell"].to_numpy(int)), grid["n"].to_numpy(float)
    held, post = np.zeros(len(grid)), None
    spark = queries.sparkSession
    for turn in range(TURNS):
        post = fit(cell.astype(float), weight, held, post)
        x = cell / GRID
        firm = (post >= FIRM) & (x[:, 0] >= 0.9) & (x[:, 1] >= 0.8) & (x[:, 2] >= 0.7)
        table = spark.createDataFrame([(int(c), float(p), bool(f), bool(t)) for c, p, f, t in zip(grid["cell"], post, firm, chainable(*x.T), strict=True)], "cell int, p double, firm boolean, chainable boolean")
        scored = live.join(F.broadcast(table.where(f"p >= {least} or firm or chainable")), "cell")
        # queries and entries as even and odd numbers
        groups = components(scored.where("firm").select((F.col("q") * 2).alias("a"), (F.col("e") * 2 + 1).alias("b")))
        groups = cut(groups.select(F.floor(F.col("vertex") / 2).alias("v"), (F.col("vertex") % 2).alias("side"), "group"))
        of = lambda side, v, g: groups.where(f"side = {side}").select(F.col("v").alias(v), F.col("group").alias(g))  # noqa: E731, B023
        if turn < TURNS - 1:
            chained = scored.where("chainable").join(of(0, "q", "gq"), "q").join(of(1, "e", "ge"), "e").where("gq = ge")
            share = {r["cell"]: r["n"] for r in chained.groupBy("cell").agg(F.count("*").alias("n")).collect()}
            held = np.array([share.get(c, 0) for c in grid["cell"].tolist()]) / weight * FIRM
    able = scored.where(f"chainable or p >= {least}").join(of(0, "q", "gq"), "q", "left").join(of(1, "e", "ge"), "e", "left")
    p = F.when(F.col("chainable") & (F.col("gq") == F.col("ge")), F.greatest("p", F.lit(FIRM))).otherwise(F.col("p"))
    good = able.select("q", "e", p.alias("p")).where(F.col("p") >= least).select("q", "e", F.round("p", 6).alias("confidence"))
    return good.join(qm.withColumnRenamed("cls", "q"), "q").join(em.withColumnRenamed("cls", "e"), "e").select("query_id", "entry_id", "confidence")


def candidates(qc: DataFrame, ec: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """compared() of every part of the queries with every part of the entries; parts are bounded, so their number grows with the tables."""
    parts_q, parts_e = (max(1, -(-n // most)) for n, most in zip(sizes, (PART_Q, PART_E), strict=True))
    parts_e = max(parts_e, -(-LEAST_BLOCKS // parts_q))
    rows = lambda side: side.select("cls", "title", "weights", "author", "year", "mark", F.xxhash64("cls").alias("h"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows(qc).select("*", F.pmod("h", F.lit(parts_q)).cast("int").alias("part"), all_of(parts_e).alias("other"))
    right = rows(ec).select("*", all_of(parts_q).alias("part"), F.pmod("h", F.lit(parts_e)).cast("int").alias("other"))
    block = ["part", "other"]
    return cut(left.drop("h").groupBy(*block).cogroup(right.drop("h").groupBy(*block)).applyInArrow(compared, "q array<bigint>, e array<bigint>, cell array<int>, n array<bigint>"))
