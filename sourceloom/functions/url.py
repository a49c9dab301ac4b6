"""URL columns.  Built-in functions only; see fuzzy.normal_url for the exact re-encoding form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def is_valid(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def without_tracking(url: Column) -> Column:
    """Lower-cased scheme and host, no default port, path at least "/", no tracking parameters, no fragment."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING))
    bare = F.regexp_replace(host(url), ":(80|443)$", "")
    path_ = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.concat(scheme(url), F.lit("://"), bare, path_, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def resolved(href: Column, engine: str = "duckduckgo.com") -> Column:
    """Where a result link leads: a redirect of the search engine to what it carries, its advertisements nowhere, others to themselves."""
    target = F.regexp_extract(query(href), "(?:^|&)uddg=([^&]*)", 1)
    ad = path(href).contains("/y.js") | query(href).contains("ad_provider")
    return F.when(~host(href).contains(engine), href).when(ad | (target == ""), "").otherwise(F.try_url_decode(target))


def slug_title(url: Column) -> Column:
    """The last part of a path as words."""
    last = F.regexp_extract(path(url), "([^/]*)$", 1)
    return F.lower(F.replace(F.replace(last, F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")))
