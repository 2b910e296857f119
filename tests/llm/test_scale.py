"""Misread words that repeat, as they do in a larger corpus."""

import random

import numpy as np
import pandas as pd

from citeloom.llm import ocr


def test_features_are_those_of_the_ratio():
    x = pd.DataFrame({"word": ["liueor", "sma11"], "right": ["linear", "small"], "n": [1, 1], "capital": [0.0, 0.0], "m": [400, 0]})
    assert np.array_equal(ocr.features(x), ocr.features(x.assign(n=x["n"] * 60, m=x["m"] * 60)))


def test_a_misread_word_that_repeats_is_corrected(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) + rng.choice("nrsl")
    words = sorted({name() for _ in range(150)})
    rows = [("en", w, 2000 + 7 * i, 0.0, 1000 + 3 * i) for i, w in enumerate(words)]
    # rare native words, most of them near a frequent one
    rare = {w[:k] + rng.choice("xzkw") + w[k + 1 :] for w in words for k in (1, 4)} - set(words)
    rows += [("en", w, 1 + i % 3, 0.0, 1 + i % 3) for i, w in enumerate(sorted(rare))]
    wrong = {w.replace(p, r, 1): w for w in words for r, p in (("c", "e"), ("rn", "m"), ("b", "h"), ("o", "a")) if p in w}
    wrong = {r: w for r, w in wrong.items() if r not in rare and r not in words}
    rows += [("en", r, (1, 6)[i % 2], 0.0, 0) for i, r in enumerate(sorted(wrong))]
    got = {r["word"]: r["right"] for r in ocr.corrections(spark.createDataFrame(rows, "lang string, word string, n long, capital double, native long")).collect()}
    for repeats in (0, 1):
        asked = sorted(wrong)[repeats::2]
        assert len(asked) > 50 and sum(got.get(r) == wrong[r] for r in asked) >= 0.9 * len(asked)
