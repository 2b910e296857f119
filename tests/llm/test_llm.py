"""Training-data operators against brute force and on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import components, leaks, linkage, names, ocr, oneform, packing, quality, sentences, survivor
from citeloom.llm.boost import Boosted


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def split(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "paper_id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in sentences.sentences(df).orderBy("paper_id", "sentence_start").collect():
        assert texts[r["paper_id"]][r["sentence_start"] : r["sentence_end"]] == r["sentence"]
        out[r["paper_id"]].append(r["sentence"])
    return list(out.values())


def test_sentences_of_many_scripts(spark):
    cases = {
        'Dr. A. B. Smith paid 3.14 USD at www.x.org. "Why?" he asked. See Fig. 3, e.g. here.': ['Dr. A. B. Smith paid 3.14 USD at www.x.org.', '"Why?" he asked.', "See Fig. 3, e.g. here."],
        "It rose until 4 p.m. Then it fell.See more.\n\nNew part": ["It rose until 4 p.m.", "Then it fell.", "See more.", "New part"],
        "Am 3. Mai kam z. B. Dr. Weber. „Gut.“ Die Reihe endet usw. Der Rest folgt.": ["Am 3. Mai kam z. B. Dr. Weber.", "„Gut.“", "Die Reihe endet usw.", "Der Rest folgt."],
        "Hacia 12 a. C. La serie crece. «¿Sí?» dijo.": ["Hacia 12 a. C.", "La serie crece.", "«¿Sí?» dijo."],
        "数据到此为止……他们写道：“无法判断。”新的。“行吗？”他问道。": ["数据到此为止……", "他们写道：“无法判断。”", "新的。", "“行吗？”他问道。"],
        "「これは可能か。」と問う。終わり！": ["「これは可能か。」と問う。", "終わり！"],
        "क्या यह संभव है? डॉ. वेरल ने कहा।यह सही है।": ["क्या यह संभव है?", "डॉ. वेरल ने कहा।", "यह सही है।"],
        "هل هذا ممكن؟ ذكر د. فيران. انتهى.": ["هل هذا ممكن؟", "ذكر د. فيران.", "انتهى."],
        "В г. Верхнем, т. е. тут. С 1990 г. по 1991 г. Новый год.": ["В г. Верхнем, т. е. тут.", "С 1990 г. по 1991 г.", "Новый год."],
        "See https://x.org/" + "a" * 300 + ".pdf.Final.part for it. More text.": ["See https://x.org/" + "a" * 300 + ".pdf.Final.part for it.", "More text."],
        "(One alone.) Tw​o, etс. and more.": ["(One alone.)", "Tw​o, etс. and more."],
    }
    for text, got in zip(cases, split(spark, *cases), strict=True):
        assert got == cases[text], text


def test_sentences_of_nothing(spark):
    assert split(spark, None, "", " \n\n ", "no end") == [[], [], [], ["no end"]]
    empty = spark.createDataFrame([], "paper_id int, text string, sentence string, extra int")
    assert sentences.sentences(empty).count() == 0


def test_one_form_rules():
    same = ["x² + ½ “a” – Δt μm β-decay", "λόγος слово", "中文（括号）、。", "क्‍ष", "plain\nline", "", "H₂O 10⁻³"]
    for text in same:
        assert oneform.one_form(text) == text, text
    cases = {"ｗｏｒｄ １２": "word 12", "été": "été", "ﬁt ﬂow": "fit flow", "a b c　d\te": "a b c d e", "in​vi­si﻿ble": "invisible", "lаttіce": "lattice", "Наблюдаeмый": "Наблюдаемый", "Τhe hiνer": "The hiver", "हमा‍रा": "हमारा", "ﾊﾝ": "ハン"}
    for text, form in cases.items():
        assert oneform.one_form(text) == form
        assert oneform.one_form(form) == form
        assert oneform.skeleton(text) == oneform.skeleton(form)


def test_one_form_found_and_prefilter(spark):
    texts = ["plain", "lаttіce", None, "", "été", "a b", "x" * 50_000, "ª µ º"]
    tokens = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "token_id long, text string, record string")
    mentions = spark.createDataFrame([("m1", "ﬁg"), (None, "ﬁg")], "id string, passage string")
    assert rows(oneform.found(tokens, mentions)) == [("mention", "m1"), ("token", "1"), ("token", "5")]
    assert {r["form"]: (r["records"], r["spellings"]) for r in oneform.groups(oneform.records_of(tokens, mentions)).collect()}["lattice"] == (1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(f"v{rng.randrange(60):03}", f"v{rng.randrange(60):03}") for _ in range((40, 70, 150)[seed])]
    links += [(f"p{i:03}", f"p{i + 1:03}") for i in range(37)] + [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("h", f"l{i}") for i in range(20)] + [("x", "x"), (None, "y"), ("x2", None)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in links:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = rows(components.components(spark.createDataFrame(links, "a string, b string")))
    assert got == sorted((v, find(v)) for v in list(parent))


def test_links_by_key_ignores_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), (None, "c"), ("k", None), ("j", "d")], "key string, m string")
    assert rows(components.components(components.links_by_key(df, ["key"], "m"))) == [("a", "a"), ("b", "a")]
    assert components.components(components.links_by_key(df.where("false"), ["key"], "m")).count() == 0
    assert rows(components.attach(df.where("key = 'j'"), "m", components.components(components.links_by_key(df, ["key"], "m"))).select("m", "group")) == [("d", "d")]


def claim(i, field, value, origin="paper", confidence="explicit", state="unreviewed", gone=None, day=1, **more):
    return ("w", field, f"id{i}", value, origin, confidence, state, gone, dt.datetime(2025, 1, day), more.get("source"), more.get("entry"), more.get("locator"))


CLAIM = "work_id string, field string, id string, value string, origin string, confidence string, review_state string, retracted_at timestamp, created_at timestamp, source_record_id string, entry_id string, locator string"


def test_survivor_policy_and_filling(spark):
    data = [
        claim(1, "title", '"A"', "openalex", day=1), claim(2, "title", '"B"', day=3), claim(3, "title", '"C"', day=2), claim(4, "title", '"b!"', day=4), claim(5, "title", "null", "user"), claim(6, "title", '"  "', "user"), claim(7, "title", '"D"', "user", state="rejected"),
        claim(8, "year", '"2000"', "user"), claim(9, "year", "2000.5", "user"), claim(10, "year", "1999"),
        claim(11, "author", '["A B", "et al."]', day=1), claim(12, "author", '["A B", "C D"]', day=2), claim(13, "author", "[]", "user"), claim(14, "author", '["x", null]', "user"), claim(15, "author", '["x", 1]', "user"),
        claim(16, "venue", '"V"', "user"), claim(17, "venue", '"V2"', "openalex", locator="p.1"), claim(18, "venue", '"V3"', "citing_bibliography", locator="p.9", entry="e"), claim(19, "venue", '"W"', None, None, None),
    ]
    got = {r["field"]: r for r in survivor.survivors(spark.createDataFrame(data, CLAIM).repartition(5)).collect()}
    assert {f: r["claim_id"] for f, r in got.items()} == {"title": "id2", "year": "id10", "author": "id12", "venue": "id16"}
    assert (got["venue"]["locator"], got["venue"]["entry_id"]) == ("p.1", "e") and got["venue"]["layers"] == 4
    assert survivor.survivors(spark.createDataFrame([], CLAIM)).count() == 0


def test_layers_and_filling_equal_brute_force_on_claims(spark):
    rng = random.Random(1)
    data = [claim(i, "title", f'"{rng.choice("abcdef")}"', rng.choice(survivor.ORIGINS), rng.choice(survivor.CONFIDENCES), day=rng.randrange(1, 28), locator=f"p{i}" if rng.random() < 0.1 else None, entry=f"e{i}" if rng.random() < 0.05 else None) for i in range(90)]
    data += [("v", *claim(i, "title", '"x"', o, day=d, locator=p)[1:]) for i, o, d, p in ((900, "publisher", 5, None), (901, "publisher", 9, "late"), (902, "openalex", 1, "layer-one"))]
    got = {r["work_id"]: r for r in survivor.survivors(spark.createDataFrame(data, CLAIM)).collect()}
    assert (got["v"]["claim_id"], got["v"]["locator"], got["v"]["layers"]) == ("id900", "layer-one", 2)
    for work in "wv":
        rows = [c for c in data if c[0] == work]
        tier = lambda c: survivor.ORIGINS.index(c[4]) * 4 + survivor.CONFIDENCES.index(c[5])
        support = {(tier(c), c[3]): sum(tier(d) == tier(c) and d[3] == c[3] for d in rows) for c in rows}
        key = lambda c: (tier(c), -support[tier(c), c[3]], c[8].date())  # noqa: B023, E731
        layer = {}
        for x in sorted({key(c) for c in rows}):
            layer[x] = 1 + max([layer[y] for y in layer if all(p <= q for p, q in zip(y, x, strict=True))], default=0)
        order = sorted(rows, key=lambda c: (*key(c), c[8], c[2]))
        assert got[work]["claim_id"] == order[0][2] and got[work]["layers"] == max(layer.values())
        for name, at in (("entry_id", 10), ("locator", 11)):
            having = [c for c in order if c[at]]
            assert got[work][name] == (order[0][at] or (min(having, key=lambda c: layer[key(c)])[at] if having else None))


def brute_contains(doc, item):
    n = len(item)
    for i, j in itertools.combinations(range(n + 1), 2):
        if j - i < min(20, n) or (j - i > 39 and n >= 20):
            continue
        part, row = item[i:j], [0] * (len(doc) + 1)
        for a, w in enumerate(part, 1):
            new = [a]
            for b, v in enumerate(doc, 1):
                new.append(min(row[b - 1] + (v != w), row[b] + 1, new[b - 1] + 1))
            row = new
        if min(row) <= (j - i) // 10:
            return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 45, 30, 22, 12, 7, 4, 2, 1)]
    docs = []
    for k in range(60):
        item = rng.choice(items)
        size = rng.randrange(min(5, len(item)), len(item) + 1)
        at = rng.randrange(len(item) - size + 1)
        part = item[at : at + size]
        for _ in range(rng.randrange(0, 6)):
            p = rng.randrange(len(part))
            part = rng.choice([part[:p] + ["zz"] + part[p + 1 :], part[:p] + part[p + 1 :], part[:p] + ["yy"] + part[p:]]) or ["q"]
        docs.append([rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))] + part + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))])
    expected = sorted((d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute_contains(doc, item))
    style = lambda ws, k: (" " if k % 2 else "\n").join(w.upper() if k % 3 == 0 else w + "," for w in ws)
    df = spark.createDataFrame([(d, style(ws, d), None) for d, ws in enumerate(docs)] + [(900, None, 1), (901, "", 1), (None, " ".join(items[0]), 1)], "doc_id long, text string, h int")
    it = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)] + [(90, None), (91, "one two")], "item_id long, text string")
    assert sorted(map(tuple, leaks.leaks(df, it).collect())) == expected and 10 < len(expected) < 80
    assert sorted(map(tuple, leaks.leaks(df, it, block_words=60).collect())) == expected  # several blocks
    twice = it.unionByName(it.selectExpr("item_id + 1000 as item_id", "upper(text) as text"))
    assert leaks.leaks(df.unionByName(df), twice).count() == 2 * len(expected)
    assert leaks.leaks(df.where("false"), it).count() == 0 and leaks.leaks(df, it.where("false")).count() == 0


def test_packing_keeps_every_text_whole(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Überfluss", "数据", "x"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["語" * 500, None, "", "dup", "dup"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = packing.encoder(packing.TOKENIZER)
    for rule in ("norm", "dot"):
        got = packing.pack(df, capacity=128, max_docs=6, max_attention=128 * 128, rule=rule, shard_tokens=2048).toPandas()
        assert got.groupby("container").n_tokens.sum().max() <= 128 and got.groupby("container").size().max() <= 6
        for i, own in got.sort_values("piece").groupby("doc_id"):
            assert "".join(texts[i][a:b] for a, b in zip(own.char_start, own.char_end, strict=True)) == texts[i]
            assert (len(own) > 1) == (len(enc.encode_ordinary(texts[i])) > 128)
        assert set(got.doc_id) == {i for i, t in enumerate(texts) if t}
        assert got.n_tokens.sum() / got.container.nunique() > 0.9 * 128
        assert got.groupby("container").n_tokens.apply(lambda n: (n**2).sum() if len(n) > 1 else 0).max() <= 128 * 128
    tight = packing.pack(df.where("doc_id < 300"), capacity=128, max_docs=6, max_attention=6000, shard_tokens=512).toPandas()
    assert tight.groupby("container").n_tokens.apply(lambda n: (n**2).sum() if len(n) > 1 else 0).max() <= 6000 and tight.doc_id.nunique() == 300
    again = packing.pack(df.where("doc_id < 300").repartition(7), capacity=128, max_docs=6, max_attention=6000, shard_tokens=512).toPandas()
    assert set(map(tuple, again.itertuples(index=False))) == set(map(tuple, tight.itertuples(index=False)))
    assert packing.pack(df.where("false")).count() == 0


def test_pieces_end_between_characters():
    enc = packing.encoder(packing.TOKENIZER)
    text = "𝔘𝔫𝔦 語言 " * 40
    out = packing.pieces_of(text, enc, 7)
    assert [p[0] for p in out] == list(range(len(out))) and out[0][1] == 0 and out[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(out, out[1:])) and max(p[3] for p in out) <= 7


def test_text_types(spark):
    prose = "The lattice of the model is small and it does not change with the season. We found that it was so. "
    texts = [prose * 3, "[1] A, B. On the x. 1999, 1(2):3-4\n" * 9, "a\tb\tc\n1\t2\t3\n" * 20, prose + "\n" + "Home |\n" * 4, "", None, "   ", "沿海冰川降低了热量平衡。数据到此为止。" * 3, "x" * 100_000, prose.upper() * 2]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts * 8)], "doc_id long, text string, p int")
    got = {r["doc_id"]: r["text_type"] for r in quality.text_types(df).collect()}
    kinds = [got.get(i) for i in range(len(texts))]
    assert kinds == ["prose", "list", "table", "prose", None, None, "junk", "prose", "junk", "prose"]
    assert quality.text_types(df.where("false")).count() == 0
    junk = ["Read the lattice here now\n" * 30, " ".join(["model", "wage", "tree", "crust"][k * k % 7 % 4] for k in range(200)), "Title of a text\n\n沿海冰川降低了热量平衡。数据到此为止。", "References\n" + "[1] Doe, J. How the models of the season shape a lattice. 1999, 1(2):3-44\n" * 2 + "[2] Roe, K. On the state of the art in a cold climate. 2001, 5(1):1-9"]
    more = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts * 8 + junk)], "doc_id long, text string, p int")
    r = {x["doc_id"] - 8 * len(texts): x for x in quality.text_types(more).collect()}
    assert [r[k]["text_type"] for k in range(4)] == ["junk", "junk", "prose", "list"]
    assert all(abs(x["p_prose"] + x["p_list"] + x["p_table"] + x["p_junk"] - 1) < 1e-9 for x in r.values())
    s = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert s[5]["n_words"] is None and s[4]["n_words"] == 0 and s[0]["punctuated_share"] == 0.0 or s[0]["n_lines"] == 1


def test_names_read_and_resolve(spark):
    assert names.read("Doe, Jane Q.") == names.read("Jane Q. Doe") == ("person", "do", "jane", "jq")
    assert names.read("Doe JQ")[1:] == ("do", "", "jq") and names.read("J.Q. DOE")[1:] == ("do", "", "jq")
    assert names.read("Univ. of Xanadu") == names.read("University of Xanadu")
    groups = [["Robert J. Marlowe", "Marlowe, R. J.", "Bob Marlowe", "Robret Marlowe", "Marlowe RJ", "Rob. Marlowe"], ["Anna Marlowe", "A. Marlowe"], ["Inst. of Oceanography Zed", "Zed Oceanographic Institute"]]
    filler = [(f"Robert {w}",) for w in ("Kant", "Bell", "Moon", "Reed", "Wood", "Lake")]
    df = spark.createDataFrame([(n,) for g in groups for n in g for _ in range(2)] + filler + [(None,), (" ",), ("et al.",)], "name string")
    got = {}
    for r in names.resolve(df).collect():
        got.setdefault(r["entity"], set()).add(r["name"])
    assert sorted(map(sorted, (g for g in got.values() if len(g) > 1))) == sorted(map(sorted, groups))
    assert names.resolve(df.where("false")).count() == 0


def test_linkage_tells_parts_and_authors_apart(spark):
    rng = random.Random(2)
    nouns = [f"{a}{b}" for a in ("lat", "mor", "gra", "pol", "sed", "tan") for b in ("tice", "phism", "nule", "icy", "iment", "gent", "ory")]
    q, e = [], []
    for i in range(80):
        title = " ".join(rng.sample(nouns, 5))
        author, year = f"Author{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}son", 1950 + i % 60
        q.append((i, title, year if i % 7 else None, f"A. {author}" if i % 5 else None))
        for k in range(2):
            e.append((f"e{i}-{k}", f"{author} A ({year}) {title}. Journal of x {k}", None))
        e.append((f"r{i}", f"{author} A ({year + 3}) {title}: a reply. Journal of x", None))
    df = spark.createDataFrame(q + [(900, None, None, None), (901, "", 1, "")], "query_id long, title string, year int, first_author string")
    en = spark.createDataFrame(e + [("n", None, None), ("m", "", None)], "id string, raw_text string, fields string")
    got = {(r["query_id"], r["entry_id"]) for r in linkage.matches(df, en).collect()}
    assert got == {(i, f"e{i}-{k}") for i in range(80) for k in range(2)}
    assert linkage.matches(df.where("false"), en).count() == 0


def test_ocr_lines_and_marks():
    assert [ocr.number_of(x) for x in ("[353]", "- 56 -", "Page 3 of 9", "xciv", "12 Names", "l2")] == [353, 56, 3, 94, -1, 12]
    text = "12\nThe net-\nwork is sma11 and\n\nlow-\ncost."
    marks = [{"start": 0, "kind": "f", "a": "", "b": ""}, {"start": 10, "kind": "h", "a": "", "b": ""}, {"start": text.index("sma11"), "kind": "w", "a": "sma11", "b": "small"}]
    assert ocr.put_right(text, marks) == "The network is small and\n\nlow- cost."
    assert ocr.misread_cost("rnade", "made") == 0.25 and ocr.misread_cost("same", "same") == 0


def test_ocr_noise_of_empty_tables(spark):
    kind = "paper_id string, text string, pages array<struct<page_number:int,text_start:int,text_end:int,provenance:string,confidence:float>>"
    data = [("a", None, None), ("b", "x", []), ("c", "One line.", [(1, 0, 9, "native", None)]), ("d", "Only a l!ne.", [(1, 0, 12, "ocr", 0.5), (2, 12, 12, "unavailable", None)])]
    assert ocr.noise(spark.createDataFrame([], kind)).count() == 0
    assert ocr.noise(spark.createDataFrame(data, kind)).count() == 0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = Boosted(trees=40, depth=3).fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
