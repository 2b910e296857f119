"""Reading of printed references and title keys on fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import bibliography as B
from citeloom.functions.titlekey import key_of, title_key
from citeloom.operators import selection as S
from citeloom.operators.topk import ranked


def test_title_keys(spark):
    cases = {"  Title:  Subtitle...  ": "title subtitle", "state-of-the-art": "state of the art", "C++": "c + +", r"\notknown{abc}": r"\notknown { abc }", r"Caf\'e \"{U}ber": "cafe uber", "Größe ς": "grosse σ", "": "", "$": "$"}
    assert {t: title_key(t) for t in cases} == cases and title_key(None) is None
    assert title_key("a ≠ b") != title_key("a = b") and title_key("ab cd") != title_key("a bcd")
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", key_of(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == cases | {None: None}


def test_references():
    f = B.parse_fields("[12] Doe, J. A., Roe, K. & van der Waals, J. (2001a). On things: a view? J. of X, 5(3), 1-9. doi:10.1234/ab-\ncd.5")
    assert f == {"printed_key": "12", "authors": ["Doe, J. A.", "Roe, K.", "van der Waals, J."], "title": "On things: a view?", "year": "2001a", "venue": "J. of X, 5(3), 1-9", "doi": "10.1234/ab-cd.5", "arxiv_id": None}
    assert all(v is None for v in B.parse_fields("").values())
    assert B.split_entries("1. A. One.\n1999. Not this.\n2. B. Two.") == [(0, 26, "1"), (27, 37, "2")]
    assert B.split_entries("") == [] and B.split_entries("Doe J (2001) X.\nmore\nRoe K (2002) Y.") == [(0, 20, None), (21, 36, None)]
    assert B.title_venue("") == (None, None) and B.title_venue("doi: 10.1/x") == (None, None)


def test_agreement_is_not_transitive():
    a, b, c = ["Doe, J.", "et al."], ["J. Doe", "K. Roe"], ["Jane Doe", "L. Poe"]
    assert B.authors_agree(a, b) and B.authors_agree(a, c) and not B.authors_agree(b, c)
    assert not B.authors_agree([], []) and not B.authors_agree(["et al."], ["J. Doe"])


CLAIM = "work_id string, field string, id string, value string, origin string, confidence string, review_state string, retracted_at timestamp, created_at timestamp"


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_pairwise_brute_force(spark, seed):
    import datetime as dt
    import json

    rng = random.Random(seed)
    lists = [["Doe, J."], ["Doe, J.", "Roe, K."], ["Doe, J.", "et al."], ["Doe, J.", "Roe, K.", "et al."], ["Doe, J.", "Poe, L."], ["et al."], []]
    rows = []
    for i in range(80):
        value = json.dumps(rng.choice(lists)) if rng.random() < 0.9 else rng.choice(["null", "[1]", "x", None])
        rows.append((f"w{rng.randrange(5)}", "author", f"id{i:02}", value, rng.choice(["user", "paper", None]), "explicit", rng.choice(["unreviewed", "unreviewed", "rejected", None]), dt.datetime(2025, 1, 1) if rng.random() < 0.1 else None, dt.datetime(2025, 1, rng.randrange(1, 5))))
    got = {r["work_id"]: r for r in S.selected(spark.createDataFrame(rows, CLAIM)).collect()}
    for w in {r[0] for r in rows}:
        fit = []
        for r in (r for r in rows if r[0] == w and r[6] != "rejected" and r[7] is None):
            try:
                v = json.loads(r[3])
            except (TypeError, ValueError):
                continue
            if isinstance(v, list) and v and all(isinstance(x, str) for x in v):
                fit.append((r, v))
        tier = [(r, v) for r, v in fit if (r[4] or "~") == min({r[4] or "~" for r, _ in fit}, key=["user", "paper", "~"].index)]
        if not tier:
            assert got[w]["state"] == "unknown" and got[w]["claim_id"] is None
            continue
        support = {r[2]: sum(x[2] == r[2] or B.authors_agree(v, y) for x, y in tier) for r, v in tier}
        size = lambda v: -1 if B.author_list_key(v)[1] else len(B.author_list_key(v)[0])
        best = min(tier, key=lambda t: (-support[t[0][2]], -size(t[1]), t[0][8], t[0][2]))  # noqa: B023
        assert got[w]["claim_id"] == best[0][2] and got[w]["support"] == support[best[0][2]]
        assert (got[w]["state"] == "conflicting") == any(n < len(tier) for n in support.values())
    assert S.selected(spark.createDataFrame([], CLAIM)).count() == 0


def test_ranked_equals_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {r["i"]: r["rank"] for r in ranked(df, ["g"], ["v", "i"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert ranked(df.where("false"), ["g"], ["v"]).count() == 0
    assert sorted(r["rank"] for r in ranked(df, [], ["v", "i"]).collect()) == list(range(1, 501))
