"""Problem 8: filling fixed-capacity containers with items.

Method: vector best-fit decreasing. A container has three residual capacities: tokens, documents and attention cost (sum
of squared lengths). Items go, longest first, into the open container that fits under every constraint and has the
largest weighted dot product of item and residual capacities, or the smallest residual norm.

Items are first divided at random into shards of a bounded number of tokens, each packed by one task. Containers that
stay emptier than wanted give their items back; these are sharded and packed again, so each round leaves only about one
open container per shard of the round before, until one shard holds all that is left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 4096
MAX_DOCUMENTS = 64
#: Attention cost (sum of squared lengths) of a container, under that of one item that fills it.
MAX_ATTENTION = int(0.9 * CAPACITY**2)
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Tokens in one shard: what one task packs at once.
SHARD_TOKENS = 256 * CAPACITY
#: A container filled to this share is closed for later rounds.
WANTED = 0.995


@cache
def encoder(path: str):
    """The public tokenizer at path (tiktoken ranks)."""
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces_of(text: str, enc, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, char_start, char_end, n_tokens): one piece, or several of at most capacity tokens, cut between characters."""
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, 0, len(text), len(tokens))]
    parts = enc.decode_tokens_bytes(tokens)
    whole = lambda k: k == len(parts) or parts[k][0] & 0xC0 != 0x80  # noqa: E731  a character starts at token k
    out, at, char = [], 0, 0
    while at < len(parts):
        to = min(at + capacity, len(parts))
        while to > at + 1 and not whole(to):
            to -= 1
        n = sum(b & 0xC0 != 0x80 for p in parts[at:to] for b in p)
        out.append((len(out), char, char + n, to - at))
        at, char = to, char + n
    return out


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_attention: int, rule: str) -> np.ndarray:
    """Bin of each item; rule is "dot" or "norm". An item alone in a bin always fits."""
    cap = np.array([capacity, max_docs, max_attention], float)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    bins = np.full(len(sizes), -1, np.int64)
    rest = np.zeros((max(16, len(sizes)), 3))
    opened = 0
    weight = np.array([4.0, 0.05, 0.05])
    for i in order:
        item = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        free = rest[:opened]
        fits = np.flatnonzero((free >= item).all(1))
        if len(fits):
            left = (free[fits] - item) / cap
            score = (weight * left**2).sum(1) if rule == "norm" else -(weight * (item / cap) * (1 - free[fits] / cap)).sum(1)
            k = fits[np.argmin(score)]
        else:
            k = opened
            rest[k] = np.maximum(cap, item)
            opened += 1
        rest[k] -= item
        bins[i] = k
    return bins


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """docs(doc_id, text) -> (row, doc_id, piece, char_start, char_end, n_tokens); null and empty texts have no piece."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            out = [(d, *p) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for p in pieces_of(t, enc, capacity)]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "char_start", "char_end", "n_tokens"])

    kept = docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    return cut(kept.mapInPandas(measure, "doc_id bigint, piece int, char_start int, char_end int, n_tokens int").withColumn("row", F.xxhash64("doc_id", "piece", "char_end", "n_tokens")))


PACKED = "doc_id bigint, piece int, char_start int, char_end int, n_tokens int, row bigint, shard bigint, container string, full boolean"


def _filler(turn: int, capacity: int, max_docs: int, max_attention: int, rule: str, wanted: float):
    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        sizes = rows["n_tokens"].to_numpy()
        bins = best_fit(sizes, capacity, max_docs, max_attention, rule)
        rows["container"] = [f"{turn}-{s}-{b}" for s, b in zip(rows["shard"], bins, strict=True)]
        rows["full"] = np.bincount(bins, sizes)[bins] >= wanted * capacity
        return rows

    return fill


def pack(docs: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCUMENTS, max_attention: int = MAX_ATTENTION, tokenizer: str = TOKENIZER, rule: str = "norm", shard_tokens: int = SHARD_TOKENS, wanted: float = WANTED) -> DataFrame:
    """docs(doc_id, text) -> (container, doc_id, piece, char_start, char_end, n_tokens), each text once and whole.

    Only texts of more than capacity tokens are divided: into pieces of at most capacity tokens, cut between characters.
    No container exceeds a capacity, except that a single piece may cost more attention than max_attention. Equal rows
    are packed each by itself. Null and empty texts, and rows without doc_id, have nothing to pack. The containers depend
    on the rows alone, not on their order or files. Where a round fills few containers to the wanted share, the next wants
    less, so the rounds end.
    """
    rest = pieces(docs, capacity, tokenizer)
    done: list[DataFrame] = []
    turn = 0
    while True:
        total = rest.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
        if not total:
            break
        shards = -(-total // shard_tokens)
        shard = rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)).cast("bigint"))
        packed = cut(shard.groupBy("shard").applyInPandas(_filler(turn, capacity, max_docs, max_attention, rule, wanted), PACKED))
        left = packed.where("not full").agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
        if shards == 1:
            done.append(packed)
            break
        if left > 0.9 * total:  # little can be filled so well (many items of over half a container): less will do
            wanted *= 0.9
        done.append(packed.where("full"))
        rest = packed.where("not full").select(*rest.columns)
        turn += 1
    out = ["container", "doc_id", "piece", "char_start", "char_end", "n_tokens"]
    if not done:
        return rest.selectExpr("cast(null as string) as container", *out[1:])
    result = done[0].select(*out)
    for x in done[1:]:
        result = result.unionByName(x.select(*out))
    return result


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: documents, tokens, attention cost and share of the capacity used."""
    return packed.groupBy("container").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"),
        F.sum(F.col("n_tokens").cast("bigint") * F.col("n_tokens")).alias("attention"), F.round(F.sum("n_tokens") / capacity, 6).alias("filled"),
    )
