"""Column functions on urls: safety, allowlists, the four canonical forms, domains, redirects.

The canonical forms differ on purpose: ranking keeps the port and the order of parameters, curation drops the port
and sorts parameters, expansion drops query and fragment, health checks look at host and path only.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Scheme, authority, path, query and fragment of a url.
_PARTS = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def part(url: Column, name: str) -> Column:
    """scheme (lower case), netloc, path, query or fragment; empty if the url has none."""
    value = F.regexp_extract(url, "(?s)" + _PARTS, ("scheme", "netloc", "path", "query", "fragment").index(name) + 1)
    return F.lower(value) if name == "scheme" else value


def user_info(url: Column) -> Column:
    return F.regexp_extract(part(url, "netloc"), r"\A(.*)@", 1)


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(part(url, "netloc"), r"(?:\A|@)(\[[^\]]*\]|[^:@\[\]]*)(?::[0-9]*)?\z", 1))


def is_safe_https(url: Column) -> Column:
    """https with a host, and no user or password."""
    return F.coalesce((part(url, "scheme") == "https") & (host(url) != "") & ~F.contains(part(url, "netloc"), F.lit("@")), F.lit(False))


def last_segment(url: Column) -> Column:
    """The percent-decoded last part of the path."""
    return F.try_url_decode(F.regexp_extract(F.regexp_replace(part(url, "path"), "/+\\z", ""), "([^/]*)\\z", 1))


def is_allowed(url: Column, allowed_host: str, path_pattern: str, excluded: tuple[str, ...] = (), plain_only: bool = False) -> Column:
    """https, exactly this host, a path that the whole pattern fits, no excluded slug; ``plain_only``: no query or fragment either."""
    ok = (part(url, "scheme") == "https") & (host(url) == allowed_host) & F.try_url_decode(part(url, "path")).rlike(f"\\A(?:{path_pattern})\\z")
    if excluded:
        ok = ok & ~last_segment(url).isin(*excluded)
    if plain_only:
        ok = ok & (part(url, "query") == "") & (part(url, "fragment") == "")
    return F.coalesce(ok, F.lit(False))


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p != "")


def ranking_url(url: Column) -> Column:
    """Ranking form: https or null, lower-case host with port, no closing slash, no utm parameters, no fragment."""
    kept = F.array_join(F.filter(_pairs(part(url, "query")), lambda p: ~F.lower(p).startswith("utm_")), "&")
    path = F.regexp_replace(part(url, "path"), "/+\\z", "")
    whole = F.concat(F.lit("https://"), F.lower(part(url, "netloc")), F.when(path == "", F.lit("/")).otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(is_safe_https(url), whole)


def curation_key(url: Column) -> Column:
    """Curation form: host without port, decoded path without a closing slash, sorted parameters; any scheme."""
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(part(url, "path"), F.lit("+"), F.lit("%2B"))), part(url, "path")), "/+\\z", "")
    pairs = F.array_join(F.array_sort(_pairs(part(url, "query"))), "&")
    return F.concat(host(url), F.when(path == "", F.lit("/")).otherwise(path), F.lit("?"), pairs)


@F.pandas_udf(StringType())
def _requote(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else quote(unquote(p), safe="/-._~@"))


def expansion_url(url: Column, requote: bool = True) -> Column:
    """Expansion form: https, host as written, path decoded and quoted anew, no query, fragment or closing slash.

    Without ``requote`` paths keep their escapes, and everything stays in the JVM.
    """
    path = _requote(part(url, "path")) if requote else part(url, "path")
    return F.concat(F.lit("https://"), part(url, "netloc"), F.regexp_replace(path, "/+\\z", ""))


def redirect_state(url: Column, final: Column) -> Column:
    """redirected-away if the host changed or a page became the root; else shell-reachable."""
    clean = lambda u: F.regexp_replace(part(u, "path"), "/+\\z", "")
    away = (host(url) != host(final)) | ((clean(url) != "") & (clean(final) == ""))
    return F.when(away, F.lit("redirected-away")).otherwise(F.lit("shell-reachable"))


def domain(value: Column) -> Column:
    """The host of a url or bare host, lower case, without a closing dot and ``www.``; ASCII hosts only."""
    raw = F.trim(value)
    found = host(F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("//"), raw)))
    return F.regexp_replace(F.regexp_replace(found, "\\.+\\z", ""), "\\Awww\\.", "")


def domain_suffixes(name: Column) -> Column:
    """A domain and all domains it lies in, so that a subdomain test is an equi join."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def site_url(routes: Column, categories: Column, homepage: Column, category: Column, term: Column) -> Column:
    """The search route with the term in place of {query}, else the category's route, the examples route, the homepage."""
    return F.coalesce(F.replace(routes["search"], F.lit("{query}"), F.url_encode(term)), categories[category], routes["examples"], homepage)


def record_id(site: Column, url: Column, parameter: str | None = None) -> Column:
    """site-slug of the last path segment, or of a query parameter where the url names its item by one."""
    slug = last_segment(url)
    if parameter:
        slug = F.coalesce(F.nullif(F.regexp_extract(part(url, "query"), f"(?:\\A|&){parameter}=([^&]*)", 1), F.lit("")), slug)
    return F.concat(site, F.lit("-"), F.regexp_replace(F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "-"), "\\A-+|-+\\z", ""))


def issue_link(base: Column, title: Column, label: Column, value: Column) -> Column:
    """A prefilled issue form with a title and one field; nothing else of the item goes in."""
    return F.concat(base, F.lit("?title="), F.url_encode(title), F.lit("&"), label, F.lit("="), F.url_encode(value))


def mail_link(recipient: Column, subject: Column, body: Column) -> Column:
    return F.concat(F.lit("mailto:"), recipient, F.lit("?subject="), F.url_encode(subject), F.lit("&body="), F.url_encode(body))
