"""Noise of scanned pages: retrieval, training and languages."""


from citeloom.llm import ocr


def test_candidates_equal_brute_force(spark):
    right = ["modell", "cellular", "deltas", "relevés", "thermal", "annals", "data", "class", "banana", "model"]
    read = ["modcll", "ccllular", "dcltas", "rclevés", "th.rmal", "an.als", "clata", "c1ass", "bananaa", "xyz"]
    words = spark.createDataFrame([("en", w, 100, 0.0, 0) for w in right], "lang string, word string, n long, capital double, native long")
    suspects = spark.createDataFrame([("en", w, 1, 0.0) for w in read], "lang string, word string, n long, capital double")
    triples = lambda s: [f"^{s}$"[i : i + 3] for i in range(len(s))]

    def near(w, r):
        for a in map(triples, ocr.coarse_forms(w)):
            for b in map(triples, ocr.coarse_forms(r)):
                if abs(len(a) - len(b)) <= 2 and len(set(a) & set(b)) >= 0.6 * len(a) - 1 and set(a) & set(b):
                    return True
        return False

    got = {(r["word"], r["right"]) for r in ocr.candidates(suspects, words).collect() if r["m"] > 0}
    assert got == {(w, r) for w in read for r in right if w != r and near(w, r)}
    assert set(zip(read[:8], right[:8])) <= got


def test_corrections_without_native_words_and_with_a_native_typo(spark):
    schema = "lang string, word string, n long, capital double, native long"
    right = ["network", "thermal", "gradient", "household", "estimate"]
    scans = [("en", w, 100, 0.0, 0) for w in right] + [("en", "netw0rk", 1, 0.0, 0)]
    assert {r["word"]: r["right"] for r in ocr.corrections(spark.createDataFrame(scans, schema)).collect()}.get("netw0rk") == "network"
    both = [("en", w, 4000, 0.0, 2000) for w in right] + [("en", "netw0rk", 21, 0.0, 1)]
    assert {r["word"]: r["right"] for r in ocr.corrections(spark.createDataFrame(both, schema)).collect()}.get("netw0rk") == "network"


def test_language_of_the_whole_text():
    assert ocr.language("the cat " * 2500 + "der Hund " * 9000) == "de"
    assert ocr.language("12 345") == "other"


def test_furniture_is_what_the_classifier_decides(spark, monkeypatch):
    import random

    rng = random.Random(6)
    words = ["model", "season", "wage", "tree", "market", "lattice", "sample", "graph", "reader", "winter", "margin", "corpus"]
    papers = []
    for p in range(12):
        text, pages = "", []
        for k in range(9):
            body = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6, 10))) + rng.choice([".", ",", ""]) for _ in range(14))
            head = f"Annals of Things, Vol. {p}" if k % 2 else f"Annals of Thimgs, Vol. {p}"
            page = f"{head}\n{body}\n{100 + k}\n"
            pages.append((k + 1, len(text), len(text) + len(page), "ocr", 0.8 if k % 3 else None))
            text += page
        papers.append((f"p{p}", text, pages))
    kind = "paper_id string, text string, pages array<struct<page_number:int,text_start:int,text_end:int,provenance:string,confidence:float>>"
    rows = ocr.lines(spark.createDataFrame(papers, kind))
    got = {(r["paper_id"], r["start"]): r["noise_kind"] for r in ocr.furniture(rows).collect()}
    want = {}
    for p, text, pages in papers:
        for _, a, b, _, _ in pages:
            want[p, a] = "running_line"
            want[p, text.rindex("\n", a, b - 1) + 1] = "page_number"
    wrong = [(k, v, dict((q[0], q[1]) for q in papers)[k[0]][k[1] : k[1] + 30]) for k, v in got.items() if want.get(k) != v]
    assert len(set(got.items()) & set(want.items())) >= 0.97 * len(want) and len(got) <= 1.03 * len(want)

    class Never:
        def __init__(self, **_):
            pass

        def fit(self, x, y):
            return self

        def predict(self, x):
            return x[:, 0] * 0

    monkeypatch.setattr(ocr, "Boosted", Never)
    assert ocr.furniture(rows).count() == 0
