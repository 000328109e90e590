"""URL expressions: canonical identity, routing, safe links, lists of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING_NAMES = ("fbclid", "gclid", "yclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"


def parts(url: Column) -> dict[str, Column]:
    """Scheme, authority, path and query of a URL; parse_url is not used, it fails on much that crawlers meet."""
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    return {name: F.regexp_extract(url, whole, i) for i, name in enumerate(("scheme", "authority", "path", "query"), 1)}


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(parts(url)["authority"], "^.*@", ""), r":[0-9]*$", ""))


def _query(raw: Column) -> Column:
    """Pairs decoded, tracking names dropped, sorted and encoded again; blank values stay."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    fields = F.filter(F.split(raw, "&"), lambda x: x != "")
    pairs = F.transform(fields, lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), decode(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_NAMES) & ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX)))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """The duplicate identity of a URL: lower scheme and host, no user, default port, fragment, trailing slash or tracking."""
    url = F.trim(url)
    p = parts(url)
    scheme = F.when(p["scheme"] == "", "https").otherwise(F.lower(p["scheme"]))
    port = F.regexp_extract(p["authority"], r":([0-9]+)$", 1).try_cast("int")
    shown = F.when(port.isNull() | (port == 0) | ((scheme == "https") & (port == 443)) | ((scheme == "http") & (port == 80)), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    path = F.when(p["path"].isin("", "/"), "/").otherwise(F.regexp_replace(p["path"], "/+$", ""))
    query = _query(p["query"])
    full = F.concat(scheme, F.lit("://"), host(url), shown, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host(url) == "", url).otherwise(full)


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL from a page's URL and a link: absolute, scheme-relative, rooted, or relative to the folder."""
    b = parts(base)
    root = F.concat(b["scheme"], F.lit("://"), b["authority"])
    folder = F.regexp_replace(F.when(b["path"] == "", "/").otherwise(b["path"]), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(b["scheme"], F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, b["path"], href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, folder, href))
    )


def safe_link(url: Column) -> Column:
    link = F.trim(F.coalesce(url, F.lit("")))
    return F.when(link.rlike("(?i)^https?://[^/?#]"), link).otherwise("#")


def url_list(text: Column) -> Column:
    """URLs in free text, without trailing punctuation, first of each."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s,]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;)\\]}>\"']+$", "")))


def short_url(url: Column, size: int = 60) -> Column:
    text = F.concat(host(url), parts(url)["path"])
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)
