"""Blocks of queries and entries against every pair by itself."""

import random
from collections import Counter

import pyarrow as pa

from citeloom.llm import linkage


def keys(title, weights, author, year, years):
    rows = [(w, x) for w, x in zip(title.split(), weights, strict=True) if len(w) >= 3 and w not in linkage.STOP]
    telling = [r for r in rows if r[1] >= linkage.TELLING]
    w = [x[:5] for x, _ in (telling if len(telling) >= 3 else rows)]
    out = {(k, a, x) for k, a in (("a", author[:6]), ("z", author[-6:])) for x in w} if author else set()
    for i in range(len(w) - 2):
        out.add(("t", *w[i : i + 3]))
        if year is not None:
            out |= {("y", w[i], w[i + k], year + y) for k in (1, 2) for y in years}
    return out | ({("f", *w)} if len(w) < 3 else set())


def cell_of(a, b):
    title = linkage.title_similarity(a[1].split(), a[2], b[1].split(), b[2])
    author = 1 - linkage.levenshtein(a[3], b[3]) / max(len(a[3]), len(b[3]), 1) if a[3] and b[3] else None
    year = {0: 1.0, 1: 0.75, 2: 0.2}.get(abs(a[4] - b[4]), 0.0) if None not in (a[4], b[4]) else None
    return tuple(-1 if x is None else int(x * linkage.GRID + 0.5) for x in (title, author, year, float(a[5] == b[5])))


def test_blocks_keep_what_may_match_and_count_the_rest(monkeypatch):
    monkeypatch.setattr(linkage, "AT_ONCE", 50)
    rng = random.Random(5)
    words = ["lattice", "morphism", "granule", "policy", "policies", "sediment", "tangent", "tan", "gent", "of", "the", "ori", "oric", "signal", "signla", "signals", "abcd", "acbd", "a", "bcd"]
    heavy = {w: 0.3 + 0.37 * i for i, w in enumerate(words)}

    def side(n, first):
        out = []
        for i in range(n):
            title = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 6, 8, 25]))]
            author = rng.choice([None, "marlowe", "marlow", "kant", "x" * 30 + "y", "x" * 30 + "yz"])
            out.append((first + i, " ".join(title), [heavy[w] for w in title], author, rng.choice([None, 1990, 1991, 1992, 1999]), rng.choice(["", "ii"])))
        return out

    q, e = side(60, 100), side(90, 1000)
    names = ["cls", "title", "weights", "author", "year", "mark"]
    table = lambda rows: pa.table({n: pa.array([r[k] for r in rows], pa.int32() if n == "year" else None) for k, n in enumerate(names)})
    live, dead = Counter(), Counter()
    for a in q:
        for b in e:
            if keys(*a[1:5], [-1, 0, 1]) & keys(*b[1:5], [0]) and (cell := cell_of(a, b))[0] >= linkage.GRID * 0.4:
                if linkage.may_match(*(linkage.np.array([x / linkage.GRID]) for x in cell))[0]:
                    live[a[0], b[0], cell] += 1
                else:
                    dead[cell] += 1
    got_live, got_dead = Counter(), Counter()
    for r in linkage.compared(table(q), table(e)).to_pylist():
        cells = [tuple(int(x) for x in c) for c in linkage.unpacked(linkage.np.array(r["cell"], int))]
        if r["q"] is None:
            got_dead.update(dict(zip(cells, r["n"], strict=True)))
        else:
            got_live.update(zip(r["q"], r["e"], cells, strict=True))
    assert len(live) > 100 and sum(dead.values()) > 100
    assert got_live == live and got_dead == dead
    assert len(linkage.compared(table([]), table(e))) == 0


def test_near_words_are_all_near_pairs():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(400)})
    assert linkage.near_words(words) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if linkage.near(words[i], words[j])]


def test_edit_distances_at_once():
    names = ["", "a", "kant", "cant", "marlowe", "marlow", "x" * 30, "x" * 29 + "y"]
    letters = linkage.np.zeros((len(names), linkage.NAME), linkage.np.int32)
    for k, x in enumerate(names):
        letters[k, : min(len(x), linkage.NAME)] = [ord(c) for c in x[: linkage.NAME]]
    a, b = (x.ravel() for x in linkage.np.indices((len(names), len(names))))
    size = linkage.np.array([len(x) for x in names])
    assert linkage.distances(letters, size, names, a, b).tolist() == [linkage.levenshtein(names[i], names[j]) for i, j in zip(a, b, strict=True)]


def test_pairs_that_cannot_match_are_not_kept(spark):
    rows = [(k, "lattice granule sediment tangent " + "abcdefghij"[k % 10] * 5, [2.0] * 5, "name" + "klmnopqrst"[k // 10] * 6, 1900 + k, "") for k in range(100)]
    side = spark.createDataFrame(rows, "cls long, title string, weights array<double>, author string, year int, mark string")
    got = linkage.candidates(side, side, (100, 100)).collect()
    kept, others = sum(len(r["q"]) for r in got if r["q"]), sum(sum(r["n"]) for r in got if r["n"])
    assert kept + others == 100 * 100 and kept < 1500
