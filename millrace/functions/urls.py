"""URL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host in lower case, without user, port or www."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def domain(url: Column) -> Column:
    """host(), or `unknown` where there is none."""
    return F.when(F.coalesce(host(url), F.lit("")) == "", F.lit("unknown")).otherwise(host(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """For deduplication: scheme and host in lower case, no fragment, no default port, no slash at the path's end but for a
    path that is a slash alone; the query stays as it is."""
    cut = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(cut, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.lower(F.regexp_extract(cut, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    place = F.when(scheme == "https", F.regexp_replace(place, ":443$", "")).when(scheme == "http", F.regexp_replace(place, ":80$", "")).otherwise(place)
    way = F.regexp_replace(F.regexp_extract(cut, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    asked = F.regexp_extract(cut, r"^[^?]*(\?.*)$", 1)
    return F.when(scheme == "", cut).otherwise(F.concat(scheme, F.lit("://"), place, F.when(way == "", "/").otherwise(way), asked))


def with_scheme(url: Column) -> Column:
    """https:// before what has no scheme but looks like a host."""
    bare = F.trim(url)
    return F.when(bare.contains("://"), bare).when(bare.rlike(r"^[\w-]+(\.[\w-]+)+(:\d+)?(/|$|\?)"), F.concat(F.lit("https://"), bare)).otherwise(bare)


def without_user(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def under_path(value: Column, prefix: str) -> Column:
    """Whether value is prefix or lies below it at a slash; an empty prefix holds for any."""
    p = prefix.rstrip("/")
    return F.lit(True) if not p else F.coalesce((value == p) | value.startswith(p + "/"), F.lit(False))


def excluded(url: Column, prefixes: Sequence[str]) -> Column:
    """Whether the path, with or without its first segment, starts with a prefix that ends at its end, a / or a -."""
    if not prefixes:
        return F.lit(False)
    from re import escape

    either = "|".join(escape(p.rstrip("/")) for p in prefixes)
    return path(url).rlike(f"^(?:/[^/]+)?(?:{either})(?:[/-]|$)")


def junk(url: Column) -> Column:
    """Addresses that a page's markup has spoiled."""
    p = F.lower(path(url))
    spaces = F.size(F.split(url, "%20")) - 1
    return (F.length(url) > 2048) | url.contains("&amp;") | p.rlike("%3c|%3e|%7b|%7d") | (spaces >= 3) | url.contains("'%20") | url.contains("%20'")


def excluded_any_case(url: Column, prefixes: Sequence[str]) -> Column:
    """excluded() without regard to case; a prefix may lack its first slash, and a blank one or a slash alone excludes nothing."""
    own = [p for p in (x.strip().rstrip("/") for x in prefixes) if p]
    if not own:
        return F.lit(False)
    from re import escape

    either = "|".join(escape(p.lower() if p.startswith("/") else "/" + p.lower()) for p in own)
    return F.lower(path(url)).rlike(f"^(?:/[^/]+)?(?:{either})(?:[/-]|$)")


#: Fixed values of the reference's suggestion scores: words anywhere in host and path, words in the path, suffixes.
HIGH_VALUE = ["docs", "reference", "api", "guide", "manual", "changelog", "release", "help", "kb"]
LOW_VALUE = ["privacy", "terms", "careers", "press", "blog", "news", "about"]
BINARY_SUFFIXES = [".zip", ".gz", ".tar", ".exe", ".dmg"]


def suggestion_score(url: Column) -> Column:
    """How much a page is worth reading first, by its address; 0 for what is no address."""
    from re import escape

    p = F.lower(path(url))
    whole = F.concat(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), p)
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    add = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    score = (
        add(whole.rlike("|".join(HIGH_VALUE)), 4)
        + add(depth == 0, 1)
        + add(depth.between(1, 4), 2)
        + add(F.regexp_replace(url, "#.*$", "").contains("?"), -2)
        + add(p.rlike("|".join(LOW_VALUE)), -3)
        + add(p.rlike(f"(?:{'|'.join(map(escape, BINARY_SUFFIXES))})$"), -6)
    )
    return F.when(host(url) == "", 0).otherwise(score)


#: What makes a string an endpoint, hosts of namespaces, endings of static files.
ENDPOINT_PARTS = ["graphql", "/gql", "/api", "/v1/", "/v2/", "/rest", "/gateway"]
NOISE_HOSTS = ["schema.org", "json-schema.org", "w3.org", "example.com", "example.org", "example.net"]
STATIC_SUFFIXES = [".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".webp", ".avif", ".mp4", ".webm", ".mp3", ".pdf", ".map"]


def _any(column: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out |= column.contains(part)
    return out


def is_endpoint(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return low.startswith("ws://") | low.startswith("wss://") | _any(low, ENDPOINT_PARTS)


def endpoint_noise(value: Column) -> Column:
    """What looks like an endpoint but is none: very short, a bare prefix, a namespace, a static file."""
    from re import escape

    low = F.lower(value)
    bare = low.isin("/api", "/api/", "/rest", "/rest/")
    return (F.octet_length(value) < 4) | bare | _any(low, NOISE_HOSTS) | F.split(low, r"\?")[0].rlike(f"(?:{'|'.join(map(escape, STATIC_SUFFIXES))})$")


def valid_host(value: Column) -> Column:
    """Whether an absolute address has a host of two labels or more, none empty, the last of two letters or more; others pass."""
    home = F.regexp_extract(value, r"^(?:https?|wss?)://([^/:?#]*)", 1)
    return F.when(value.rlike(r"^(?:https?|wss?)://"), home.rlike(r"^(?:[^.]+\.)+[A-Za-z]{2,}$")).otherwise(True)
