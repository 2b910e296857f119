"""HTML functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_entities, strip_markup


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, quoted either way or bare; null without it."""
    found = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return decode_entities(F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit("")))


def anchors(html: Column) -> Column:
    """Anchors in page order as array<struct<href, text>>."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(tags, lambda a: F.struct(attribute(F.regexp_extract(a, r"(?is)^(<a\s[^>]*>)", 1), "href").alias("href"), strip_markup(a).alias("text")))


def resolve_http(base: Column, link: Column) -> Column:
    """A link against its page as an absolute http(s) URL without fragment; null for other schemes."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    absolute = (
        F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).when(link.startswith("/"), F.concat(root, link)).when(link == "", F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(folder, F.lit("/"), link))
    )
    return F.when(root != "", absolute)


def page_links(base: Column, html: Column, limit: int = 200) -> Column:
    """Distinct absolute links of a page in page order, at most limit."""
    links = F.transform(anchors(html), lambda a: resolve_http(base, a["href"]))
    return F.slice(F.array_distinct(F.filter(links, lambda x: x.isNotNull())), 1, limit)


def pdf_link(base: Column, html: Column) -> Column:
    """The PDF a landing page names: its citation_pdf_url, else an alternate link of that type, else its only anchor to one."""
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    named = F.get(F.filter(metas, lambda m: F.lower(attribute(m, "name")) == "citation_pdf_url"), F.lit(0))
    alternates = F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>)"), F.lit(1))
    alternate = F.get(F.filter(alternates, lambda m: F.lower(attribute(m, "type")) == "application/pdf"), F.lit(0))
    pdfs = F.filter(page_links(base, html, 100_000), lambda x: F.lower(x).rlike(r"\.pdf(\?.*)?$"))
    return F.coalesce(resolve_http(base, attribute(named, "content")), resolve_http(base, attribute(alternate, "href")), F.when(F.size(pdfs) == 1, F.get(pdfs, F.lit(0))))
