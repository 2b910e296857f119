"""The pre-filter of the one form."""

import re

from citeloom.llm import oneform


def test_plain_characters_are_in_the_one_form():
    plain = [c for c in map(chr, range(0x3000)) if re.fullmatch(oneform.PLAIN, c)]
    assert len(plain) > 500 and [c for c in plain if oneform.one_form(c) != c] == []
    assert not re.fullmatch(oneform.PLAIN, "d\u0133k") and oneform.one_form("d\u0133k") == "dijk"


def test_full_table_of_the_class_path(spark):
    table = oneform.prototypes(spark)
    assert len(table) > 5000
    alike = oneform.Alike(table)
    words = {"Аrmenіаn": "Armenian", "Ꭺlpha": "Alpha", "冠сat": "冠cat", "TNFα": "TNFα", "слово": "слово", "": "", "x" * 9999 + "а": "x" * 9999 + "a"}
    assert {w: alike.member(w) for w in words} == words
    assert all(alike.skeleton(w) == alike.skeleton(f) for w, f in words.items())
    assert alike.skeleton("Ꭺlpha") == alike.skeleton("Alpha") != alike.skeleton("Alphas")
