"""URL expressions. All are plain Column expressions and stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import fixed_values as V
from quarrylight.functions.text import strip

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), r";[^/]*$", "")


def _with_scheme(url: Column) -> Column:
    """Add the missing ``https`` of ``host/path`` and ``//host/path``."""
    full = F.regexp_replace(url, r"(?s)^(?!.*://)(?!//[^/?#])(?=[^?#])(.+)$", "https://$1")
    return F.regexp_replace(full, r"^//", "https://")


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no query, fragment, params or final slash.

    A chain of replacements in which each step uses the one before it once, so
    that the expression stays small however often a plan repeats it.
    """
    u = _with_scheme(strip(url))
    u = F.regexp_replace(u, r"(?s)[?#].*$", "")
    u = F.regexp_replace(u, r"^([^/]*//[^/]*/(?:.*/)?[^/;]*);[^/]*$", "$1")
    u = F.regexp_replace(u, r"^([^/]*//[^/]*)$", "$1/")
    u = F.regexp_replace(u, r"^([^/]*//[^/]*/.*)/$", "$1")
    return F.concat(
        F.lower(F.regexp_extract(u, r"^([^/]*//[^/]*)", 1)), F.regexp_extract(u, r"^[^/]*//[^/]*(/.*)$", 1)
    )


def safe_canonicalize_url(url: Column) -> Column:
    """Canonical URL, or NULL when it is not a usable http(s) URL."""
    c = canonicalize_url(url)
    usable = c.rlike("^https?://[^/ ]+/") & scheme(strip(url)).isin("", "http", "https")
    return F.when(usable, c)


def domain_of_url(url: Column) -> Column:
    return F.coalesce(F.nullif(netloc(url), F.lit("")), F.lit("unknown"))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: the keys a domain may be joined on."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def is_asset_url(url: Column) -> Column:
    """The last path component ends in a known asset suffix."""
    p = F.regexp_replace(F.lower(path(url)), r"/+$", "")
    suffix = F.regexp_extract(p, r"[^/](\.[^./]+)$", 1)
    return suffix.isin(*V.ASSET_SUFFIXES)


def has_blocked_token(url: Column, tokens: Sequence[str] = V.BLOCKED_PATH_TOKENS) -> Column:
    cleaned = [t.strip().lower() for t in tokens if t.strip()]
    if not cleaned:
        return F.lit(False)
    escaped = "|".join("".join(c if c.isalnum() else "\\" + c for c in t) for t in cleaned)
    return F.lower(path(url)).rlike(f"/(?:{escaped})(?:/|$)")


def is_allowed_candidate(url: Column, tokens: Sequence[str] = V.BLOCKED_PATH_TOKENS) -> Column:
    return ~is_asset_url(url) & ~has_blocked_token(url, tokens)


def page_quality_score(url: Column) -> Column:
    low = F.lower(url)
    score = F.lit(0)
    for part in V.LISTING_URL_PARTS:
        score = score - F.contains(low, F.lit(part)).cast("int")
    for part in V.DETAIL_URL_PARTS:
        score = score + F.contains(low, F.lit(part)).cast("int")
    return score


def is_program_focused_url(url: Column) -> Column:
    pattern = "|".join(V.PROGRAM_URL_PARTS)
    return F.coalesce(F.lower(url).rlike(pattern), F.lit(False))
