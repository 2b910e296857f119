"""Problem 9: evaluation texts leaking into training text.

Method: prefix-filtered set join. Five-word shingles of each item-sized window are ordered by rarity in the corpus; a
window of W words with at most e changed words keeps at least T = (W - 4) - 5e of its shingles, so at least one of its
W - 4 - T + 1 rarest is in any document that contains it. Only these prefix shingles are joined. Length and positional
bounds thin the candidates, and an exact alignment over item-sized windows verifies them.

A run of 20 to 29 words may have two changes and so holds a 20-word window with at most two; one of 30 to 39 may have
three and holds a 30-word window with at most three; a longer run holds a part of 20 to 39 words that satisfies the
rule itself. Windows of 20 and 30 words therefore miss nothing. Items shorter than 20 words are one window; items of
fewer than five words are one shingle of all their words, as they may have no change.

The items are the stated query set: they meet the corpus in blocks of at most BLOCK_WORDS words, each sent to all tasks.
A block reads the corpus twice, once for the rarity of its shingles and once to join and verify; no text is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import words_of

SHINGLE = 5
RUN = 20
WINDOWS = ((20, 2), (30, 3))
#: Words of the items that are sent to all tasks at once (some 60 bytes each); more items make more blocks. A block holds one item at least.
BLOCK_WORDS = 400_000
#: Words of the documents that one task handles at once.
CHUNK_WORDS = 500_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def windows(n: int) -> list[tuple[int, int, int]]:
    """(start, words, changes allowed) of the windows of an item of n words."""
    return [(0, n, n // 10)] if n < RUN else [(i, w, e) for w, e in WINDOWS for i in range(n - w + 1)]


def codes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; 0 where a word is in no item."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.full(n, k, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        known &= part > 0
        out = (out ^ (part.astype(np.uint64) * MIX[j])) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    out[out == 0] = 1
    out[~known] = 0
    return out


class Items:
    """A block of items as numbers: words by their place in the block's vocabulary, shingles by their place among its codes."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        same: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for item_id, text in rows:
            w = tuple(words_of(text))
            if w:
                same[w].add(item_id)
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for w in same]
        self.ids = [sorted(v) for v in same.values()]
        own = [codes(w, min(SHINGLE, len(w))) for w in self.words]
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.lengths = sorted({min(SHINGLE, len(w)) for w in self.words})
        self.shingles = [np.searchsorted(self.known, c) for c in own]  # by item: the shingle at each place
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.prefix: dict[int, list[int]] = {}

    def order(self, df: np.ndarray) -> None:
        """Keeps, by shingle, the items that have it among the rarest of some window."""
        prefix = defaultdict(set)
        for i, s in enumerate(self.shingles):
            k = min(SHINGLE, len(self.words[i]))
            rank = np.lexsort((s, df[s]))
            place = np.empty(len(s), np.int64)
            place[rank] = np.arange(len(s))
            chosen = set()
            for start, w, e in windows(len(self.words[i])):
                n = w - k + 1
                need = max(1, n - k * e)
                chosen.update((start + np.argsort(place[start : start + n])[: n - need + 1]).tolist())
            for at in chosen:
                prefix[int(s[at])].add(i)
        self.prefix = {c: sorted(v) for c, v in prefix.items()}

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known shingles in a row of words, and the shingles."""
        at, found = [], []
        for k in self.lengths:
            c = codes(ids, k)
            p = np.flatnonzero(self.filter[(c & np.uint64((1 << 22) - 1)).astype(np.int64)] & (c != 0))
            s = np.minimum(np.searchsorted(self.known, c[p]), len(self.known) - 1)
            right = self.known[s] == c[p]
            at.append(p[right])
            found.append(s[right])
        return np.concatenate(at), np.concatenate(found)


def contains_run(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> bool:
    """Whether doc holds a run of item: 20 to 39 of its words (all, if it has fewer than 20) with at most one change in ten.

    Banded edit distance from every start of the item at once, along each given shift (place in doc less place in item).
    """
    n = len(item)
    low, high = (n, n) if n < RUN else (RUN, min(n, 2 * RUN - 1))
    band = high // 10
    starts = np.arange(n - low + 1)
    width = 2 * band + 1
    for shift in shifts:
        cost = np.zeros((len(starts), width), np.int32)  # column k: place in doc is start + step + shift + k - band
        for step in range(high):
            i = starts + step
            inside = i < n
            word = item[np.minimum(i, n - 1)]
            j = i[:, None] + shift + np.arange(width)[None, :] - band
            ok = (j >= 0) & (j < len(doc))
            same = ok & (doc[np.clip(j, 0, len(doc) - 1)] == word[:, None])
            new = cost + ~same + np.where(ok, 0, 9)
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # the item's word is missing in doc: same place, one step on
            for k in range(1, width):
                new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)  # doc has a word more
            cost = np.where(inside[:, None], new, 99)
            if step + 1 >= low and (cost.min(1) <= (step + 1) // 10).any():
                return True
    return False


def _shifts(at: np.ndarray, found: np.ndarray, shingles: np.ndarray, need: int) -> list[int]:
    """Shifts along which enough different shingles of the item lie: those of one run differ by at most its changes."""
    order = np.argsort(shingles, kind="stable")
    lo, hi = np.searchsorted(shingles[order], found), np.searchsorted(shingles[order], found, "right")
    size = hi - lo
    pos = order[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    shift = np.repeat(at, size) - pos
    out: set[int] = set()
    for zone in (shift // 8, (shift + 4) // 8):
        pairs = np.unique(np.column_stack([zone, pos]), axis=0)
        zones, count = np.unique(pairs[:, 0], return_counts=True)
        out.update(shift[np.isin(zone, zones[count >= need])].tolist())
    return sorted(out)


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(doc ids, start of each document, words of all documents with four blanks between them), by chunks of bounded size."""
    get = vocabulary.get
    docs, starts, flat = [], [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append(doc_id)
            starts.append(len(flat))
            flat += [get(w, 0) for w in words_of(text.as_py())]
            flat += (0, 0, 0, 0)
            if len(flat) >= CHUNK_WORDS:
                yield docs, np.array(starts), np.array(flat, np.int64)
                docs, starts, flat = [], [], []
    if docs:
        yield docs, np.array(starts), np.array(flat, np.int64)


def _block(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    """The pairs of all documents and one block of items."""
    items = Items(rows)
    spark = docs.sparkSession
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint"
    if not items.words:
        return spark.createDataFrame([], kind)
    sent = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        df = np.zeros(len(own.known), np.int64)
        for _, starts, flat in _chunks(batches, own.vocabulary):
            at, found = own.hits(flat)
            doc = np.searchsorted(starts, at, "right")
            df += np.bincount(np.unique(doc * len(df) + found) % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["s", "df"])

    rarity = docs.mapInArrow(count, "s bigint, df bigint").groupBy("s").agg(F.sum("df").alias("df"))
    df = np.zeros(len(items.known), np.int64)
    for r in rarity.collect():  # at most BLOCK_WORDS rows, by construction of the block
        df[r["s"]] = r["df"]
    items.order(df)
    ordered = spark.sparkContext.broadcast(items)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ordered.value
        for doc_ids, starts, flat in _chunks(batches, own.vocabulary):
            at, found = own.hits(flat)
            doc = np.searchsorted(starts, at, "right") - 1
            order = np.argsort(doc, kind="stable")
            at, found, doc = at[order], found[order], doc[order]
            edge = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
            out_doc, out_item = [], []
            for d in np.unique(doc).tolist():
                a, f = at[edge[d] : edge[d + 1]], found[edge[d] : edge[d + 1]]
                candidates = {i for s in np.unique(f).tolist() for i in own.prefix.get(s, ())}
                if not candidates:
                    continue
                end = (starts[d + 1] if d + 1 < len(starts) else len(flat)) - 4
                text = flat[starts[d] : end]
                for i in sorted(candidates):
                    n = len(own.words[i])
                    low, k = min(n, RUN), min(SHINGLE, n)
                    changes = low // 10
                    if len(text) < low - changes:
                        continue
                    shifts = _shifts(a - starts[d], f, own.shingles[i], max(1, low - k + 1 - k * changes))
                    if shifts and contains_run(text, own.words[i], shifts):
                        out_doc += [doc_ids[d]] * len(own.ids[i])
                        out_item += own.ids[i]
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, batch_type), pa.array(out_item, pa.int64())], ["doc_id", "item_id"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.mapInArrow(join, kind)


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id), once per pair.

    Null ids, null and empty texts and texts without a word match nothing. An item of one to nine words matches only
    where all its words stand in order. Repeated rows count once; other columns are ignored.
    """
    doc = docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    item = items.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("bigint"), "text")
    total = item.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // (4 * block_words)) or 1  # most words have more than four characters with the blank after them
    parts = []
    for b in range(blocks):
        own = item.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        parts.append(_block(doc, [(r["item_id"], r["text"]) for r in own.toLocalIterator()]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
