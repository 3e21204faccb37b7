"""Links, locators and identifiers of accounts as column expressions."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from operator import or_
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# Query parameters that only track the visitor.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "igshid", "si", "ref")
# Hosts and paths of shared platforms, and the form of an address.
ACCESS_KINDS = ("web", "whois", "offline", "unknown")
KNOWN_HOSTS = ("facebook.com", "instagram.com", "tiktok.com", "g.page", "goo.gl", "maps.app.goo.gl", "maps.google.com", "google.com", "play.google.com", "apps.apple.com")
# First path segments of the social network that are no account, roots of sites by language, and hosts
# of offices and help pages, which are no identity of an entity.
RESERVED_SEGMENTS = ("profile.php", "pages", "groups", "watch", "events", "marketplace", "video")
LANGUAGE_ROOTS = ("ar", "en", "ar-eg", "en-eg", "eg-ar", "eg-en", "eg")
QUARANTINED_HOSTS = ("cpa.gov.eg", "shakwa.cpa-mobile.com", "support.apple.com")
# What an identifier of each kind says of its owner.
ROLES = {
    "phone": "contact", "whatsapp": "contact", "email": "contact", "website": "owned_site", "facebook": "social_profile", "instagram": "social_profile", "tiktok": "social_profile",
    "marketplace": "marketplace_profile", "google_maps": "location", "address": "location", "commercial_register": "registration",
}
# Sites of social networks, and hosts and paths of places.
SOCIAL = {"facebook.com": "facebook", "instagram.com": "instagram", "tiktok.com": "tiktok"}
PLACES = (("g.page", "/"), ("goo.gl", "/maps"), ("maps.app.goo.gl", "/maps"), ("google.com", "/maps"), ("google.com", "/place"), ("maps.google.com", "/maps"), ("maps.google.com", "/place"))
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*://", re.I)
_DIGITS = {0x660 + i: str(i) for i in range(10)} | {0x6F0 + i: str(i) for i in range(10)}
EMAIL = "^[^\\s@/]+@[^\\s@/]+\\.[^\\s@/]{2,}$"


def host(url: Column) -> Column:
    """Lower-case host without www.; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), "^www\\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., no tracking parameters, sorted query, no trailing slash or fragment."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(raw.rlike("^(?i)[a-z][a-z0-9+.-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme = F.lower(F.regexp_extract(full, "^([^:]+)://", 1))
    query = F.regexp_extract(full, "^[^?#]*\\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    joined = F.array_join(pairs, "&")
    out = F.concat(scheme, F.lit("://"), host(full), F.regexp_replace(path(full), "/+$", ""), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(raw == "", "").otherwise(out)


def lossy_url(url: Column) -> Column:
    """The second, lossy form: lower case, no scheme, no query, no fragment, no trailing slash."""
    low = F.lower(F.regexp_replace(F.trim(url), "/+$", ""))
    return F.substring_index(F.substring_index(F.regexp_replace(low, "^https?://", ""), "?", 1), "#", 1)


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://[^/\\s]+\\S*$"), F.lit(False))


def locator(raw: Column) -> Column:
    """struct(web_url, note, access_kind) of a source locator."""
    cell = F.trim(F.coalesce(raw, F.lit("")))
    noted = "^(?i)(https?://\\S+)\\s+(.+)$"
    none = F.lit(None).cast("string")
    made = lambda u, n, k: F.struct(u.alias("web_url"), n.alias("note"), F.lit(k).alias("access_kind"))
    return (
        F.when(cell == "", made(none, none, "unknown"))
        .when(F.lower(cell).startswith("whois:"), made(none, F.regexp_replace(F.substring(cell, 7, 10000), "^//", ""), "whois"))
        .when(is_http_url(cell), made(cell, none, "web"))
        .when(cell.rlike(noted), made(F.regexp_extract(cell, noted, 1), F.regexp_extract(cell, noted, 2), "web"))
        .otherwise(made(none, cell, "unknown"))
    )


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def is_language_root(url: Column) -> Column:
    s = segments(url)
    return (F.size(s) == 1) & F.coalesce(F.lower(F.try_element_at(s, F.lit(1))).isin(*LANGUAGE_ROOTS), F.lit(False))


def is_redirect_to_home(url: Column, final: Column) -> Column:
    """From a page at least two segments deep to the root of a site or of one of its languages, or one segment."""
    return (depth(url) > 1) & ((depth(final) <= 1) | is_language_root(final))


def is_deeper_url(url: Column, final: Column) -> Column:
    return ~is_language_root(final) & (depth(final) > depth(url))


def is_social_host(url: Column) -> Column:
    return F.coalesce(bare_host(url).rlike("(^|\\.)(facebook|fb)\\.com$"), F.lit(False))


def is_vendor_page(url: Column) -> Column:
    """A page of one account of the social network, which names no single post."""
    low = F.lower(path(url))
    named = reduce(or_, [F.contains(low, F.lit(x)) for x in ("/mentions", "/photos", "/plugins/", "/about")])
    post = reduce(or_, [F.contains(low, F.lit(x)) for x in ("/posts/", "/videos/", "/reel/")])
    referred = F.contains(F.lower(url), F.lit("ref=")) & ~post
    return is_social_host(url) & (named | referred | (depth(url) <= 1) | low.startswith("/p/") | low.startswith("/people/"))


def group_slug(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, "(?i)facebook\\.com/groups/([^/?#]+)", 1), F.lit("")))


def input_kind(text: Column) -> Column:
    """email, url, phone or name."""
    from tallystone.functions.text import fold_digits

    cell = fold_digits(F.trim(text))
    low = F.lower(cell)
    known = F.exists(F.array(*map(F.lit, KNOWN_HOSTS)), lambda h: F.contains(low, h))
    compact = F.regexp_replace(cell, "[\\s\\-().]", "")
    return (
        F.when(cell == "", "name")
        .when(cell.rlike(EMAIL), "email")
        .when(cell.rlike("^(?i)https?://") | cell.rlike("^(?i)www\\.") | known | cell.rlike("^(?i)[a-z0-9-]+(\\.[a-z0-9-]+)+/\\S*"), "url")
        .when(compact.rlike("^\\+?[0-9]+$") & (F.length(F.regexp_replace(compact, "\\D", "")) >= 9), "phone")
        .otherwise("name")
    )


def _site(name: str, *of: str) -> bool:
    return any(name == x or name.endswith("." + x) for x in of)


def _keyed(kind: str, where: str, rest: str, keys: list[str], origin: str | None, external: bool) -> dict[str, object]:
    return {"kind": kind, "normalized": f"https://{where}{rest}", "schemeless": f"{where}{rest}".lower(), "host": where, "path_keys": list(dict.fromkeys(keys)), "origin_key": origin, "external": external}


def link_keys(raw: str | None) -> dict[str, object] | None:
    """Kind, canonical form and keys of a link that somebody searches for or that is stored; None for what is none.

    Accounts of social networks go by their first path segment (the id of the query for numbered profiles, the
    whole path behind a reserved segment), places and apps by their path, other sites by path and by host.
    """
    text = (raw or "").strip().translate(_DIGITS)
    try:
        parts = urlsplit(text if _SCHEME.match(text) else f"https://{text}")
        name = (parts.hostname or "").lower()
    except ValueError:
        return None
    if "." not in name or any(c.isspace() for c in name):
        return None
    name = name.removeprefix("www.")
    trail, way, asked = [s for s in parts.path.split("/") if s], parts.path.rstrip("/"), parse_qsl(parts.query, keep_blank_values=True)
    identity = {k: v for k, v in asked if k.lower() == "id"}
    kept = f"?{urlencode(identity)}" if identity else ""
    external = name in QUARANTINED_HOSTS
    first = trail[0] if trail else ""
    if first and _site(name, *SOCIAL):
        kind = next(k for site, k in SOCIAL.items() if _site(name, site))
        home, number = f"{kind}.com", dict(asked).get("id", "")
        if kind == "facebook" and first == "profile.php" and number:
            account = f"profile.php?id={number}"
            return _keyed(kind, home, f"/{account}", [f"{home}/{account}".lower()], None, external)
        if kind == "facebook" and first.lower() in RESERVED_SEGMENTS:
            return _keyed(kind, home, way, [f"{home}{way}".lower()], None, external)
        account = first.lower() if kind == "instagram" else f"@{first.removeprefix('@')}" if kind == "tiktok" else first
        return _keyed(kind, home, f"/{account}", [f"{home}/{account}".lower(), f"{home}{way}".lower()], None, external)
    if way and any(name == h and way.startswith(p) for h, p in PLACES):
        return _keyed("google_maps", name, way, [f"{name}{way}".lower()], None, external)
    if name == "play.google.com" and way.startswith("/store/apps/"):
        return _keyed("marketplace", name, way + kept, [f"{name}{way}{kept}".lower()], None, external)
    if name == "apps.apple.com" and re.search(r"/id\d+", way):
        return _keyed("marketplace", name, way, [f"{name}{way}".lower()], None, external)
    full = f"{way}{kept}" if trail or parts.query else ""
    return _keyed("website", name, full, [f"{name}{full}".lower(), name], name, external)


_LINK = StructType([StructField(n, ArrayType(StringType()) if n == "path_keys" else BooleanType() if n == "external" else StringType()) for n in ("kind", "normalized", "schemeless", "host", "path_keys", "origin_key", "external")])


@F.pandas_udf(_LINK)
def query_url(urls: pd.Series) -> pd.DataFrame:
    """``link_keys`` of each link; nulls for what is none."""
    return pd.DataFrame([k or dict.fromkeys(_LINK.names) for k in map(link_keys, urls)], columns=_LINK.names)


@F.pandas_udf(BooleanType())
def is_blocked_target(urls: pd.Series) -> pd.Series:
    """Links to loopback, private, link-local, reserved and unnamed hosts, which a fetcher must not follow."""

    def blocked(url: str | None) -> bool:
        try:
            name = urlsplit(url or "").hostname or ""
        except ValueError:
            return True
        if not name or name == "localhost" or name.endswith((".localhost", ".local", ".internal")):
            return True
        try:
            return not ipaddress.ip_address(name).is_global
        except ValueError:
            return "." not in name

    return urls.map(blocked)


def pipeline_phone(text: Column) -> Column:
    """Egyptian number as +20..., by the write side's rules; null if it is none."""
    d = F.regexp_replace(F.coalesce(text, F.lit("")), "\\D+", "")
    double0, code = d.startswith("0020"), d.startswith("20") & (F.length(d) >= 11)
    rest = F.when(double0, F.substring(d, 5, 100)).when(code, F.substring(d, 3, 100)).otherwise(d)
    national = F.when(rest.startswith("0"), F.substring(rest, 2, 100)).when(double0 | code, rest)
    return F.when(national.rlike("^1[0125][0-9]{8}$") | national.rlike("^[2-9][0-9]{8}$"), F.concat(F.lit("+20"), national))


def query_phone(text: Column) -> Column:
    """Egyptian number as +20..., by the read side's rules, which differ in the prefix 00 and in short 20."""
    from tallystone.functions.text import fold_digits

    d = F.regexp_replace(fold_digits(F.coalesce(text, F.lit(""))), "\\D", "")
    full = F.when(d.startswith("00"), F.substring(d, 3, 100)).when(d.startswith("20"), d).when(d.startswith("0"), F.concat(F.lit("20"), F.substring(d, 2, 100)))
    return F.when(full.rlike("^20(1[0125][0-9]{8}|[2-9][0-9]{8})$"), F.concat(F.lit("+"), full))


def bare_host(url: Column) -> Column:
    """Lower-case host without www., user and port; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", 1)), "^www\\.", "")


def identifier_role(kind: Column, value: Column) -> Column:
    """The role of an identifier by its kind; external_reference for a link of an office or a help page."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.when(kind.isin("website", "marketplace") & bare_host(value).isin(*QUARANTINED_HOSTS), "external_reference").otherwise(F.try_element_at(role, kind))


def is_searchable_identifier(kind: Column, value: Column) -> Column:
    """Whether a stored identifier may be found by search (and shown): no quarantined host, a valid shape."""
    phone = value.startswith("+20") & F.regexp_replace(value, "\\D", "").rlike("^20(1[0125][0-9]{8}|[2-9][0-9]{8})$")
    named = F.contains(bare_host(value), F.lit("."))
    pathless = bare_host(value).isin(*KNOWN_HOSTS) & path(value).isin("", "/")
    shape = F.when(kind.isin("phone", "whatsapp"), phone).when(kind == "website", named).when(kind.isin("marketplace", "facebook", "instagram", "tiktok", "google_maps"), named & ~pathless).when(kind == "email", F.contains(value, F.lit("@")) & F.contains(value, F.lit("."))).otherwise(F.lit(True))
    return (F.coalesce(identifier_role(kind, value), F.lit("")) != "external_reference") & shape
