"""URL checks and rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Publishers behind paywalls, in order; and signs of a paywall in a response.
PAYWALLED = {
    "pubs.acs.org": "American Chemical Society (ACS)", "www.sciencedirect.com": "Elsevier/ScienceDirect", "onlinelibrary.wiley.com": "Wiley Online Library",
    "www.nature.com": "Nature/Springer", "link.springer.com": "Springer", "pubs.rsc.org": "Royal Society of Chemistry", "www.tandfonline.com": "Taylor & Francis",
    "www.science.org": "AAAS/Science", "chemistry.acs.org": "ACS", "www.chemistryworld.com": "Royal Society of Chemistry",
}
LOGIN = ("login", "signin", "sign-in", "authenticate", "access-denied", "subscribe", "purchase")
PHRASES = (
    "you do not have access", "purchase access", "subscribe to read", "sign in to view", "full text available to subscribers", "access the full article", "get access to the full version",
)


def domain(url: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("")))


def is_valid(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#]+"), F.lit(False))


def doi(url: Column) -> Column:
    patterns = (r"doi\.org/(10\.\d{4,}/\S+)$", r"/doi/(?:abs/|full/|pdf/)?(10\.\d{4,}/\S+)$", r"(10\.\d{4,}/\S+)")
    found = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])
    return F.regexp_replace(found, r"[).,;]+$", "")


def normalize(url: Column) -> Column:
    """arXiv abstracts and PDFs become their readable HTML page, without version."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    paper = F.nullif(F.regexp_extract(path, r"(?:abs|pdf)/(.+?)(?:v\d+)?(?:\.pdf)?$", 1), F.lit(""))
    return F.when(F.contains(domain(url), F.lit("arxiv.org")) & paper.isNotNull(), F.concat(F.lit("https://ar5iv.org/abs/"), paper)).otherwise(url)


def publisher(url: Column, paywalled: dict[str, str] = PAYWALLED) -> Column:
    """The first listed publisher whose domain is in the URL's; null if none."""
    return F.coalesce(*[F.when(F.contains(domain(url), F.lit(d)), F.lit(name)) for d, name in paywalled.items()])


def paywalled_response(final_url: Column, html: Column, status: Column | None = None) -> Column:
    any_in = lambda c, signs: reduce(lambda a, b: a | b, [F.contains(c, F.lit(s)) for s in signs])
    out = any_in(F.lower(final_url), LOGIN) | any_in(F.substring(F.lower(html), 1, 5000), PHRASES)
    return F.coalesce(out if status is None else out | status.isin(401, 403), F.lit(False))


def alternatives(found_doi: Column) -> Column:
    with_doi = [F.concat(F.lit(p), found_doi) for p in ("Open version: https://unpaywall.org/", "Semantic Scholar: https://api.semanticscholar.org/graph/v1/paper/DOI:", "Google Scholar: https://scholar.google.com/scholar?q=")]
    return F.array_compact(F.array(*with_doi, F.lit("Through an institution: upload the document instead."), F.lit("ArXiv: https://arxiv.org/search/")))


def input_error(url: Column, html: Column, n_words: Column) -> Column:
    """First fault of a page as an input; null if none."""
    return F.when(~is_valid(url), "INVALID_URL").when(publisher(url).isNotNull() | paywalled_response(url, html), "PAYWALL_DETECTED").when(html.isNull(), "HTTP_ERROR").when(n_words < 100, "EXTRACTION_FAILED")


def link(url: Column) -> Column:
    return F.when(url.isNull() | (url == ""), "unknown").when(is_valid(url), F.concat(F.lit("[Open original paper]("), url, F.lit(")"))).otherwise("invalid source URL")
