"""URL expressions: cleaning, identity, host and domain keys. All native, null in gives the stated result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track (fixed values).
TRACKING = (
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid", "_ga", "authuser", "rclk", "entry", "g_ep", "hl",
)
TRACKING_RX = r"^(?i)(?:utm_[^=]*|" + "|".join(TRACKING) + r")(?:=|$)"


def clean_url(c: Column) -> Column:
    """Without fragment and tracking parameters; other parameters keep their bytes and order. Null stays null."""
    bare = F.split_part(c, F.lit("#"), F.lit(1))
    path, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING_RX)), "&")
    return F.when(c.isNotNull(), F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def tracking_params(c: Column) -> Column:
    """Names of the tracking parameters in a URL, in order."""
    query = F.regexp_extract(F.split_part(c, F.lit("#"), F.lit(1)), r"\?(.*)$", 1)
    return F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike(TRACKING_RX)), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))))


def link_identity(c: Column) -> Column:
    """Scheme and host in lower case and the path without closing slashes; no query, no fragment; blank and null give ''. What
    has no scheme is only trimmed and lowered."""
    t = F.trim(F.coalesce(c, F.lit("")))
    rx = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
    made = F.concat(F.lower(F.regexp_extract(t, rx, 1)), F.lit("://"), F.lower(F.regexp_extract(t, rx, 2)), F.regexp_replace(F.regexp_extract(t, rx, 3), "/+$", ""))
    return F.when(t.rlike(rx), made).otherwise(F.lower(t))


def normalize_url(c: Column) -> Column:
    """Trimmed of blanks and quotes, with https:// where a scheme is missing; blank gives ''."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\"']+|[\s\"']+$", "")
    return F.when((t == "") | t.rlike("^(?i)https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def host_key(c: Column) -> Column:
    """Lower case without a leading www."""
    return F.regexp_replace(F.lower(c), r"^www\.", "")


def _domain(c: Column, ends: str) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^https?://", "")
    return F.regexp_extract(F.regexp_replace(t, r"^www\.", ""), f"^([^{ends}]*)", 1)


def domain_key(c: Column) -> Column:
    """What stands before the first slash, without scheme and www; a port or a query without a slash stays."""
    return _domain(c, "/")


def sheet_domain_key(c: Column) -> Column:
    """As domain_key, but cut at a question mark too, and '' for spreadsheet link formulas."""
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).startswith("=hyperlink"), "").otherwise(_domain(c, "/?"))


def name_from_maps_url(c: Column) -> Column:
    """The place's name in a map link, decoded; '' without one."""
    return F.coalesce(F.trim(F.try_url_decode(F.regexp_extract(F.coalesce(c, F.lit("")), r"/place/([^/@?]+)", 1))), F.lit(""))


def url_variants(c: Column) -> Column:
    """The URL, then with www flipped, then with the other scheme: what a fetcher tries in turn."""
    flipped = F.when(c.rlike(r"^(?i)https?://www\."), F.regexp_replace(c, r"^((?i)https?://)(?i)www\.", "$1")).otherwise(F.regexp_replace(c, r"^((?i)https?://)", "$1www."))
    other = F.when(c.rlike("^(?i)https://"), F.regexp_replace(c, "^(?i)https://", "http://")).otherwise(F.regexp_replace(c, "^(?i)http://", "https://"))
    return F.array_distinct(F.array(c, flipped, other))


def meta_refresh_target(html: Column) -> Column:
    """The target of a meta refresh in raw HTML; '' without one."""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]*content=[\"'][^\"'>]*url=([^\"'>]+)", 1))


def whatsapp_link(digits: Column, message: Column) -> Column:
    """A deep link with the message percent-encoded."""
    return F.concat(F.lit("https://wa.me/"), digits, F.lit("?text="), F.replace(F.url_encode(message), F.lit("+"), F.lit("%20")))
