"""Core operators on small tables with the edge cases: nulls, ties, repeated rows, empty tables, extra columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import changes, matching, metrics, prominence, traversal
from citeloom.operators.alignment import distance
from citeloom.operators.topk import last_by, top_k
from citeloom.sources import files
from citeloom.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_top_k_equals_a_plain_window_whatever_the_salts(spark):
    data = [(None if i % 5 == 0 else i % 3, i % 4, i) for i in range(200)]
    df = spark.createDataFrame(data, "g int, v int, id int")
    order = [F.desc("v"), F.asc("id")]
    assert rows(top_k(df, ["g"], order, 3, "id", salts=1)) == rows(top_k(df.repartition(7), ["g"], order, 3, "id", salts=16))
    assert top_k(df.where("false"), ["g"], order, 3, "id").count() == 0


def test_last_by_takes_ties_by_the_next_column(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", None, 3)], "k string, at int, id int")
    assert rows(last_by(df, ["k"], ["at", "id"])) == [("a", 1, 2), ("b", None, 3)]


def test_prominence_leaves_unknown_components_out(spark):
    df = spark.createDataFrame([(8, 0, None, None, True, 10, 0, 0), (0, 0, 100000, 2025, False, 0, 1, 0)], "citing long, cited long, global_count long, year int, local boolean, mentions long, methods long, backgrounds long")
    got = [r["score"] for r in prominence.score(prominence.components(df, 2025)).orderBy("citing").collect()]
    assert got[1] == 1.0
    assert got[0] == pytest.approx((0.25 + 0.10 + 0.10) / 1.0, abs=1e-4)


def test_redirects_stop_after_eight_hops_and_in_cycles(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (None, 3)]
    got = {r["old"]: r["target"] for r in traversal.resolve_redirects(spark.createDataFrame(chain, "old int, new int")).collect()}
    assert got[0] == 8 and got[15] == 20 and got[100] in (100, 101) and None not in got


def test_levels_and_empty_seeds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "citing int, cited int")
    assert rows(traversal.levels(edges, spark.createDataFrame([(1,), (1,)], "node int"), 3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert traversal.levels(edges, spark.createDataFrame([], "node int"), 3).count() == 0


def test_plan_frontier_a_taken_child_costs_no_fanout(spark):
    data = [(0, 1, 10, 0.9, None, None), (0, 1, 11, 0.8, None, None), (0, 2, 10, 0.9, None, None), (0, 2, 12, 0.7, None, None), (0, 2, 13, 0.6, None, "hidden"), (0, 2, 14, 0.5, None, None), (0, 3, 15, 0.5, None, None)]
    df = spark.createDataFrame(data, "g int, parent int, work int, score double, year int, mark string")
    assert rows(traversal.plan_frontier(df, "g", 2, 4).select("parent", "work")) == [(1, 10), (1, 11), (2, 12), (2, 14)]
    assert traversal.plan_frontier(df.where("false"), "g", 2, 4).count() == 0


def test_reading_order_breaks_cycles_and_puts_the_seed_last():
    item = lambda i, depth=0, score=0.0, year=None, seed=False: {"id": i, "depth": depth, "score": score, "year": year, "title_key": "t", "is_seed": seed}
    assert traversal.suggest_order([item("s", seed=True), item("a"), item("b"), item("c", depth=2)], [("a", "b"), ("b", "a"), ("s", "a"), ("c", "a")]) == ["c", "a", "b", "s"]
    assert traversal.suggest_order([item("a"), item("b")], [("a", "b")]) == ["b", "a"]
    assert traversal.suggest_order([], []) == []


def test_title_similarity_is_symmetric_and_bounded(spark):
    pairs = [("a b c", "a b c"), ("", "x"), ("graph", "graphs"), ("aaaa", "aaab"), ("x" * 1025, "y" * 1025)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", matching.title_similarity(F.col("a"), F.col("b")).alias("x"), matching.title_similarity(F.col("b"), F.col("a")).alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"]) and 0 <= r["x"] <= 1
    pad = lambda s: ["".join(t) for t in zip("\0\0" + s + "\0\0", ("\0\0" + s + "\0\0")[1:], ("\0\0" + s + "\0\0")[2:])]
    a, b = pad("graph"), pad("graphs")
    expected = 2 * sum(min(a.count(g), b.count(g)) for g in set(a)) / (len(a) + len(b))
    assert df.where("a = 'graph'").select(matching.title_similarity(F.col("a"), F.col("b")).alias("x")).first()["x"] == pytest.approx(expected)


def test_weighted_mean_without_known_parts_is_null(spark):
    assert one(spark, matching.weighted_mean([(F.lit(None).cast("double"), 1.0)])) is None
    assert one(spark, matching.year_agreement(F.lit(2000), F.lit(None).cast("int"))) is None
    assert one(spark, matching.words_found(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) is None


def test_alignment_distance():
    assert distance(["b", "c"], ["a", "b", "c", "d"]) == 0
    assert distance(["b", "x", "c"], ["a", "b", "c"]) == 1
    assert distance(["a", "b"], []) == 2
    assert distance([], ["a"]) == 0


def test_metrics(spark):
    low, high = metrics.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) is None and one(spark, high) is None
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None)], "k string, v double")
    assert rows(metrics.upper_median(df, "k", "v")) == [("a", 3.0)]
    years = spark.createDataFrame([(y,) for y in (2000, 2000, 2002, 2006, 2011, None)], "year int")
    assert rows(metrics.histogram_slots(years, "year")) == [(2000, 2000, 2), (2001, 2001, 0), (2002, 2002, 1), (2003, 2003, 0), (2004, 2004, 0), (2005, 2005, 0), (2006, 2006, 1), (2007, 2010, 0), (2011, 2011, 1)]


def test_upsert_twice_changes_nothing_more(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, s string, v int")
    new = spark.createDataFrame([("a", None, 5), ("a", None, 4), ("c", "y", 6)], "k string, s string, v int")
    once = changes.upsert(old, new, ["k", "s"], ["v"])
    assert rows(once) == [("a", None, 5), ("b", "x", 2), ("c", "y", 6)] == rows(changes.upsert(once, new, ["k", "s"], ["v"]))
    kept = changes.insert_ignore(old, new, ["k", "s"], ["v"])
    assert rows(kept) == [("a", None, 1), ("b", "x", 2), ("c", "y", 6)] == rows(changes.insert_ignore(kept, new, ["k", "s"], ["v"]))
    assert rows(changes.upsert(old, new.where("false"), ["k", "s"], ["v"])) == rows(old)


def test_reconcile_moves_replaces_and_tombstones(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5"), (None, "9")], "path string, sha string")
    scan = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "3"), ("d2", "3"), ("f", "1"), ("g", "7")], "path string, sha string")
    assert rows(changes.reconcile(old, scan).select("path", "decision")) == [("a", "unchanged"), ("b", "replaced"), ("d", "moved"), ("d2", "duplicate"), ("e", "tombstoned"), ("f", "duplicate"), ("g", "added")]
    assert ("e", "unchanged") in rows(changes.reconcile(old, scan, partial=True).select("path", "decision"))


def test_text_functions(spark):
    f = lambda fun, s, *a: one(spark, fun(F.lit(s), *a))
    assert f(T.normalize_doi, " https://doi.org/10.1234/AbC. ") == "10.1234/abc"
    assert f(T.normalize_doi, "10.12/x") is None
    assert f(T.normalize_arxiv, "arXiv:2101.00001v3") == "2101.00001"
    assert f(T.strip_markup, "<i>a</i>&amp;lt;  b") == "a &lt; b"
    assert f(T.shorten, "one two three", 9) == "one two…"
    assert f(T.citation_keys, "[1, 3–5; 3]") == [1, 3, 4, 5]
    assert f(T.citation_keys, "[1-99]") == [1]
    assert f(T.color, "#aBc") == "#aabbcc" and f(T.color, "red") is None
    assert f(T.leading_year, "1999a") == 1999 and f(T.leading_year, "1200") is None
    assert f(T.trim_punctuation, "(a).") == "(a)" and f(T.trim_punctuation, "a).") == "a"
    assert f(T.escape_markdown, "a*b<c") == r"a\*b&lt;c"
    assert f(T.without_truncation, "A. Bee et al.") == "A. Bee"


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.pdf").write_bytes(b"abc")
    (tmp_path / "b.epub").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = rows(files.library_files(spark, str(tmp_path), content=True))
    assert [g[:3] for g in got] == [("b.epub", 1, "epub"), ("x/a.pdf", 3, "pdf")]
    (tmp_path / "log.jsonl").write_text('{"stage": "a", "cost_usd": 1.5}\nbroken\n')
    assert files.json_lines(spark, str(tmp_path / "log.jsonl"), files.SPEND).count() == 1
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), files.SPEND).count() == 0
    m = one(spark, files.metadata_from_filename(F.lit("Doe - 1999 - On - x")))
    assert tuple(m) == ("Doe", 1999, "On - x")
    assert tuple(one(spark, files.metadata_from_filename(F.lit("bare")))) == (None, None, "bare")
    assert one(spark, files.parse_work(F.lit('{"title": "x"}'))) is None
    assert one(spark, files.parse_cited_by_count(F.lit('{"cited_by_count": "5"}'))) is None
    assert one(spark, files.parse_cited_by_count(F.lit('{"cited_by_count": 5.9}'))) == 5
    assert one(spark, files.parse_pdf_info(F.lit("Title: A: b\nPages: 3\nnone"))) == {"title": "A: b", "pages": "3"}
    c = one(spark, files.parse_crossref(F.lit('{"DOI": "10.1/X", "title": ["<b>T</b>"], "author": [{"given": "A", "family": "B"}, {"name": "Org"}], "issued": {"date-parts": [[2001, 2]]}}')))
    assert (c["doi"], c["title"], c["authors"], c["year"]) == ("10.1/x", "T", ["A B", "Org"], 2001)
    tsv = spark.createDataFrame([(1, "5\t" * 10 + "90\tword"), (1, "5\t" * 10 + "10\tweak"), (1, "bad")], "page int, line string")
    assert rows(files.parse_ocr_tsv(tsv)) == [(1, 1, 0.9)]
    w = one(spark, files.page_words(F.lit('<word xMin="1" yMin="2" xMax="3" yMax="4">a&amp;b</word>')))
    assert w[0]["text"] == "a&b" and w[0]["xMax"] == 3.0


def test_budget_equals_a_plain_running_sum(spark):
    data = [("g", dt.datetime(2024, 1, 1, i % 24, i % 60), i, float(i % 7)) for i in range(300)] + [("h", dt.datetime(2024, 1, 1), 1, 5.0)]
    df = spark.createDataFrame(data, "g string, at timestamp, id int, cost double")
    got = {r["id"] for r in jobs.within_budget(df.where("g = 'g'"), "g", ["at", "id"], "cost", 100.0).collect()}
    total, expected = 0.0, set()
    for _, at, i, c in sorted(x for x in data if x[0] == "g"):
        if total < 100:
            expected.add(i)
        total += c
    assert got == expected


def test_windowed_counts_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "a"), (dt.datetime(2024, 1, 1, 0, 50), "a"), (dt.datetime(2024, 1, 1, 1, 5), "b")], "ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["events"]) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]


def test_every_query_has_a_name_and_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_walks_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    ids = list(range(60))
    edges = [(a, b) for a in ids for b in rng.sample(ids, rng.randrange(0, 12)) if a != b]
    works = {i: (rng.randrange(5) / 4, rng.choice([None, 1990, 2000]), rng.choice([None, None, None, "pinned", "hidden"])) for i in ids}
    seeds = [0, 1, 2, 3]
    for fanout, budget in ((2, 6), (3, 100), (10, 5)):
        want = set()
        for seed in seeds:
            visited, level = {seed}, [seed]
            want.add((seed, 0, 0, None, seed))
            for step in (1, 2):
                lists = {p: sorted((b for a, b in set(edges) if a == p and works[b][2] != "hidden" and b not in visited), key=lambda b: (-works[b][0], works[b][1] is None, -(works[b][1] or 0), b)) for p in level}
                chosen, _ = traversal.planned(level, lists, fanout, max(0, budget - len(visited)), set())
                want |= {(seed, step, i, p, w) for i, (p, w) in enumerate(chosen)}
                level = [w for _, w in chosen]
                visited |= set(level)
        e = spark.createDataFrame(edges + edges[:5] + [(None, 1)], "citing long, cited long")
        w = spark.createDataFrame([(i, *v) for i, v in works.items()], "id long, score double, year int, mark string")
        got = traversal.walk(e, w, spark.createDataFrame([(x,) for x in seeds], "seed long"), 3, fanout, budget)
        assert {tuple(r)[:5] for r in got.collect()} == want
        paths = {(r["seed"], r["work"]): r["path"] for r in traversal.paths(got, 3).collect()}
        assert len(paths) == len(want) and all(p[0] == s and p[-1] == x for (s, x), p in paths.items())
    assert traversal.walk(e, w, spark.createDataFrame([], "seed long"), 3).count() == 0
