"""Links, provider addresses and short codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a link came from, best first.
LINK_ORIGINS = ["arxiv", "openalex_best", "openalex_oa_url", "openalex_location", "unpaywall_best", "unpaywall_location", "openalex_landing", "unpaywall_landing", "landing_meta", "model"]
OA_LOCATION = "struct<pdf_url:string,landing_page_url:string,is_oa:boolean>"
OPENALEX_OA = f"best_oa_location {OA_LOCATION}, open_access struct<oa_url:string>, locations array<{OA_LOCATION}>"
UNPAYWALL = "best_oa_location struct<url:string,url_for_pdf:string>, oa_locations array<struct<url:string,url_for_pdf:string>>"
DATACITE_ARXIV = "10.48550/arxiv."


def http(url: Column) -> Column:
    """The trimmed URL if it is http or https, else null."""
    t = F.trim(url)
    return F.when(t.rlike("(?i)^https?://[^/?#\\s]+"), t)


def normalize_link(raw: Column) -> Column:
    """Scheme and host in lower case, no fragment, a path; abstracts of the preprint archive as their PDF. Null for other schemes."""
    t = F.regexp_replace(http(raw), "#.*$", "")
    head = F.lower(F.regexp_extract(t, "^([A-Za-z]+://[^/?#]+)", 1))
    tail = F.regexp_replace(t, "^[A-Za-z]+://[^/?#]+", "")
    path = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    id_ = F.regexp_replace(F.regexp_extract(path, "^/(?:abs|pdf)/([^?]+)", 1), r"\.pdf$", "")
    archive = head.rlike(r"^https?://(www\.)?arxiv\.org$")
    query = F.regexp_extract(path, r"(\?.*)$", 1)
    return F.when(archive, F.concat(F.lit("https://arxiv.org"), F.when(id_ != "", F.concat(F.lit("/pdf/"), id_, query)).otherwise(path))).otherwise(F.concat(head, path))


def _found(*parts: tuple[Column, str]) -> Column:
    """array(struct(url, origin)) of arrays of URLs with their origin, in order, http(s) only."""
    def from_(urls: Column, origin: str) -> Column:
        return F.transform(urls, lambda u: F.struct(http(u).alias("url"), F.lit(origin).alias("origin")))

    each = [from_(urls, origin) for urls, origin in parts]
    return F.filter(F.concat(*each), lambda x: x["url"].isNotNull())


def openalex_links(payload: Column) -> Column:
    """Open-access links of a provider record: best PDF, its URL, PDFs of open locations, then landing pages of the best and of these."""
    j = F.from_json(payload, OPENALEX_OA)
    best, open_ = F.array(j["best_oa_location"]), F.filter(F.coalesce(j["locations"], F.array()), lambda x: F.coalesce(x["is_oa"], F.lit(False)))
    pdf = lambda xs: F.transform(xs, lambda x: x["pdf_url"])
    page = lambda xs: F.transform(xs, lambda x: x["landing_page_url"])
    return _found((pdf(best), "openalex_best"), (F.array(j["open_access"]["oa_url"]), "openalex_oa_url"), (pdf(open_), "openalex_location"), (page(F.concat(best, open_)), "openalex_landing"))


def unpaywall_links(payload: Column) -> Column:
    """The other provider's links: best PDF, PDFs of locations, then pages of the best and of locations without a PDF."""
    j = F.from_json(payload, UNPAYWALL)
    best, rest = F.array(j["best_oa_location"]), F.filter(F.coalesce(j["oa_locations"], F.array()), lambda x: x.isNotNull())
    pdf = lambda xs: F.transform(xs, lambda x: x["url_for_pdf"])
    pages = F.transform(F.filter(F.concat(best, rest), lambda x: http(x["url_for_pdf"]).isNull()), lambda x: x["url"])
    return _found((pdf(best), "unpaywall_best"), (pdf(rest), "unpaywall_location"), (pages, "unpaywall_landing"))


def encode_uuid(text: Column) -> Column:
    """A UUID as 22 characters of URL-safe base64; null if it isn't one."""
    hexed = F.regexp_replace(F.lower(text), "-", "")
    code = F.regexp_replace(F.translate(F.base64(F.unhex(hexed)), "+/", "-_"), "=+$", "")
    return F.when(F.lower(text).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), code)


def decode_uuid(code: Column) -> Column:
    """The inverse; null for another length, another alphabet, or loose bits at the end."""
    ok = code.rlike("^[A-Za-z0-9_-]{21}[AQgw]$")
    h = F.lower(F.hex(F.unbase64(F.concat(F.translate(F.when(ok, code), "-_", "+/"), F.lit("==")))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(ok, F.concat_ws("-", *parts))


def status_class(status: Column) -> Column:
    """What an HTTP status means for a fetch."""
    return F.when(status.between(200, 299), "ok").when(status == 429, "throttled").when(status.isin(401, 403, 451), "denied").when(status.isin(404, 410), "gone").when(status >= 500, "retry").otherwise("failed")


def safe_filename(name: Column, suffix: str = ".pdf", longest: int = 120) -> Column:
    """A file name without signs that file systems reserve, one blank between words, no dot at its ends, cut to length."""
    t = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1F]+', " "), " +", " "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^[. ]+|[. ]+$", ""), " +", " "))
    return F.concat(F.when(t == "", "untitled").otherwise(F.trim(F.left(t, F.lit(longest - len(suffix))))), F.lit(suffix))
