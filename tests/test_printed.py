"""Printed references and HTML."""

from pyspark.sql import functions as F

from citeloom.functions import html as H
from citeloom.functions import reference as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reference_parts(spark):
    f = lambda fun, *a: one(spark, fun(*map(F.lit, a)))
    got = f(R.parse_fields, "Doe J (1999a) A study of things. Journal of X 1998, 3:4. doi:10.1234/ab.c.")
    assert tuple(got) == ("A study of things", 1999, "10.1234/ab.c", None)
    got = f(R.parse_fields, 'J. Doe. “Quoted title here”, in Y, 2001. arXiv:2101.00001')
    assert tuple(got) == ("Quoted title here", 2001, None, "2101.00001")
    assert f(R.doi_of, "10.1234/a and 10.1234/b") is None and f(R.doi_of, "10.1234/ ab") == "10.1234/ab"
    assert f(R.year_of, "no year 12345") is None
    assert f(R.range_tail, "1–3") == [2, 3] and f(R.range_tail, "1-99") == [] and f(R.range_tail, "x") == []
    assert f(R.is_references_heading, "7. References") and not f(R.is_references_heading, "References to")
    assert f(R.has_dot_leader, "Intro ........ 12") and not f(R.has_dot_leader, "Intro... ")
    assert f(R.is_equation_label, "(A.3)") and not f(R.is_equation_label, "(see 3)")
    assert f(R.looks_like_heading, "2.1 Methods of Study") and not f(R.looks_like_heading, "It ended.")
    assert f(R.subsequence_score, "ab", "a-b") == 2 + 2 + 2 and f(R.subsequence_score, "ba", "ab") is None and f(R.subsequence_score, "", "x") == 0


def test_links(spark):
    page = "<A HREF='x.html#a'>T <b>1</b></A><a href=\"x.html\">2</a><a href=/y?q=1&amp;r=2>3</a><a href='mailto:z'>4</a><a name=n>5</a>"
    base = F.lit("https://h.org/d/p")
    assert one(spark, H.page_links(base, F.lit(page))) == ["https://h.org/d/x.html", "https://h.org/y?q=1&r=2"]
    assert one(spark, H.page_links(base, F.lit(page), 1)) == ["https://h.org/d/x.html"]
    assert one(spark, H.anchors(F.lit(page)))[0]["text"] == "T 1"
    assert one(spark, H.page_links(base, F.lit(None).cast("string"))) is None
    assert one(spark, H.pdf_link(base, F.lit("<a href=a.pdf>x</a><a href=b.pdf>y</a>"))) is None
    assert one(spark, H.pdf_link(base, F.lit('<link type="application/pdf" href="//c.org/f">'))) == "https://c.org/f"
    assert one(spark, H.resolve_http(F.lit("ftp://x"), F.lit("a"))) is None
