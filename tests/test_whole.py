"""Whole-table queries against brute force on small tables."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from citeloom.operators import matching, titles
from citeloom.plans.registry import queries


@pytest.fixture
def run(spark, tmp_path):
    def call(name, table, data, schema):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        assert name in queries()
        return {r[0]: tuple(r[1:]) if len(r) > 2 else r[1] for r in queries()[name](spark, str(tmp_path)).collect()}

    return call


def trim(t):
    while t and (t[-1] in ".,;:\"'<>" or t[-1] in ")]}" and t.count(t[-1]) > t.count("([{"[")]}".index(t[-1])])):
        t = t[:-1]
    return t


TEXTS = ["plain text", "a * b_c [d] \\ & <e>", "Über  uns   hier ", " 中文 文本\n。", "x" * 300, "é" * 250 + " y", ""]


def test_text_queries_take_every_document(run):
    data = [(i, t, "landing_page") for i, t in enumerate(TEXTS)] + [(90, None, "note"), (91, "<p>caf&#233; &amp;lt; &#x4E2D;&nbsp;x</p>", "landing_page")]
    schema = "doc_id int, text string, source string"
    texts = {i: t for i, t, _ in data if t is not None}
    assert run("f35_clean", "documents", data, schema) == {i: " ".join(t.split()) for i, t in texts.items()}
    assert run("f39_shown_text", "documents", data, schema) == {i: " ".join(t.split())[:200] for i, t in texts.items()}
    escape = lambda t: re.sub(r"([\\*_\[\]])", r"\\\1", t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    assert run("f109_escape_text", "documents", data, schema) == {i: escape(t) for i, t in texts.items()}
    assert run("f47_strip_markup", "documents", data, schema)[91] == "café &lt; 中 x"


def test_other_whole_queries(run):
    got = run("f73_objects", "reading_index", list(enumerate(TEXTS)), "paper_id int, text string")
    assert got == {i: (len(re.findall(r"\w+", t)), len(t.split()), len([p for p in t.split("\n\n") if p.strip()]), len(t)) for i, t in enumerate(TEXTS)}
    entries = ["A (b).", "a) b).", "x (y))).,", "see [1]]", "end)", "", "{a}}", "(a", '"q".\'']
    assert run("f08_trim_trailing_punctuation", "bibliography_entry", list(enumerate(entries)), "id int, raw_text string") == {i: trim(t) for i, t in enumerate(entries)}
    marks = [(1, "numeric", "[1, 3–5]"), (2, "numeric", "[7]"), (3, "numeric", "[9-4; 2]"), (4, "numeric", "(1-99)"), (5, None, "[1]"), (6, "numeric", "[2 − 4]")]
    got = run("f89_citation_keys", "citation_mention", [(str(i), s, m) for i, s, m in marks], "id string, style string, marker_text string")
    assert {k: v for k, v in got.items() if k.isdigit()} == {"1": "1,3,4,5", "2": "7", "3": "2", "4": "", "6": "2,3,4"}
    titles = ["On the Ground", "Übergröße ﬁn", "œuvre 中"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t).replace("ß", "ss").replace("œ", "oe") if c.isascii() and c.isalnum()).lower()
    assert run("f125_compact", "graph_work", list(enumerate(titles)), "id int, display_title string") == {i: plain(t) for i, t in enumerate(titles)}


def test_titles_meet_without_a_common_head(spark):
    works = [("a", "Spectral markets: a joint trial of queues", 2001), ("b", "Uniform clouds", None), ("c", "spectral markets: a joint trial of queues", 1990), ("d", "aaaa", 2000), ("e", None, 2000)]
    asked = [(1, "speciral markets: a joint trial of queues", 2001), (2, "On uniform clouds", 2000), (3, "nothing like it", 2000), (4, None, None), (5, "aaab", None), (6, "", 2000)]
    w = spark.createDataFrame(works, "id string, display_title string, display_year int")
    schema = "query_id bigint, title string, year int"
    q = spark.createDataFrame(asked, schema).where("title is not null").select("query_id", F.lower("title").alias("qt"), F.col("year").alias("qy"))
    w = w.where("display_title is not null").select("id", F.lower("display_title").alias("wt"), F.col("display_year").alias("wy"))
    brute = q.crossJoin(w).where(matching.title_similarity(F.col("qt"), F.col("wt")) >= 0.3).select("query_id", "id")
    for block in (20_000, 2):
        found = titles.near(q.select(F.col("qt").alias("t")), w.select(F.col("wt").alias("t")), 0.3, block)
        assert found.count() == found.select("qt", "wt").distinct().count()
    got = titles.close(q, w, 0.3).select("query_id", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect())) and got.count() >= 3


def test_decisions(spark):
    from citeloom.plans.matching import decisions

    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "b", "c", "d", "e", "f", "g"])], "id int, qt string")
    scored = [
        (1, "x", None, None, None, "match", 1.0), (2, "y", 0.9, 2000, 2000, "conflict", 0.0), (2, "x", 0.2, None, None, "match", 1.0), (3, "x", 0.9, 2000, 2000, "conflict", 0.0),
        (4, "x", 0.9, 2000, 2005, "unknown", 0.8), (4, "y", 0.3, 2000, 2000, "unknown", 0.4), (5, "x", 0.9, 2000, 2001, "unknown", 0.8), (5, "y", 0.9, None, 2000, "unknown", 0.78), (6, "x", 0.9, 2000, 2001, "unknown", 0.8), (6, "z", 0.5, 2000, 2001, "unknown", 0.79), (7, "x", 0.4, 2000, 2000, "unknown", 0.6),
    ]
    got = {r["id"]: (r["cid"], r["verdict"], r["reason"]) for r in decisions(asked, spark.createDataFrame(scored, "id int, cid string, title double, qy int, wy int, agreement string, total double")).collect()}
    assert got == {
        0: (None, "rejected", "no_candidates"), 1: (None, "rejected", "no_title"), 2: ("x", "accepted", "identifier"), 3: (None, "rejected", "identifier_conflict"), 4: (None, "rejected", "year_disagrees"),
        5: ("x", "ambiguous", "score"), 6: ("x", "accepted", "score"), 7: (None, "rejected", "title_disagrees"),
    }
