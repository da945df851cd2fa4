"""Addresses and identities as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: names of query parameters that tell a campaign or a referrer, not the content.
TRACKING = (
    "utm_[a-z_]+|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|source|smid|smtyp|partner|mod|cmp|cmpid|ncid|sh|share|"
    "__twitter_impression|guccounter|campaign_id|emc|nl|te|user_email|impression_id|_hsenc|_hsmi|igshid"
)
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of a stripped url; '' where absent."""
    return F.regexp_extract(strip(url), _PARTS, n)


def bare_host(authority: Column) -> Column:
    return F.regexp_replace(F.lower(authority), r"^www\.", "")


def decoded(c: Column) -> Column:
    """A query component decoded; as it is where its escapes are broken."""
    return F.coalesce(F.try_url_decode(c), c)


def encoded(c: Column) -> Column:
    """Form encoding: letters, digits and _.-~ stay, a space is a plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def params(query: Column) -> Column:
    """array<struct<name, value>> in order; a parameter without = has an empty value; empty pieces are dropped."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"),
            decoded(F.regexp_extract(p, r"(?s)=(.*)$", 1)).alias("value"),
        ),
    )


def is_tracking(name: Column) -> Column:
    return name.rlike(f"(?i)^(?:{TRACKING})$")


def normalize_url(url: Column) -> Column:
    """The url without tracking parameters, fragment, www., default ports and trailing slashes; http becomes https.

    Null and '' give ''; what has neither scheme nor host stays as it is, stripped.
    """
    scheme, authority, path, query = (part(url, n) for n in (1, 2, 3, 4))
    host = F.regexp_replace(F.regexp_replace(bare_host(authority), r":80$", ""), r":443$", "")
    kept = F.filter(params(query), lambda p: ~is_tracking(p["name"]))
    text = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["name"]), F.lit("="), encoded(p["value"]))), "&")
    trimmed = F.regexp_replace(path, r"/+$", "")
    trimmed = F.when(trimmed == "", "/").otherwise(trimmed)
    low = F.lower(scheme)
    head = F.when(low.isin("http", "https"), "https:").when(low != "", F.concat(low, F.lit(":"))).otherwise("")
    whole = F.concat(head, F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), trimmed, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return (
        F.when(url.isNull() | (url == ""), "")
        .when((scheme == "") & (authority == ""), strip(url))
        .otherwise(whole)
    )


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def item_key(url: Column, source_type: Column, title: Column) -> Column:
    """16 hex digits: of the normalised url, or of type and title where there is none."""
    base = normalize_url(url)
    return F.left(F.sha1(F.when(base != "", base).otherwise(F.concat(source_type, F.lit(":"), slug(title)))), F.lit(16))


def domain(url: Column) -> Column:
    return F.coalesce(bare_host(part(url, 2)), F.lit(""))


def within_domain(host: Column, allowed: Column) -> Column:
    """Equal to, or a subdomain of, an allowed domain."""
    a = F.lower(allowed)
    return (F.lower(host) == a) | F.endswith(F.lower(host), F.concat(F.lit("."), a))
