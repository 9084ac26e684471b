"""Phone and e-mail expressions. The three phone keys differ on purpose: each stage compares by its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calling codes by region (fixed values).
CALLING_CODES = {
    "IN": "91", "US": "1", "CA": "1", "GB": "44", "SG": "65", "AE": "971", "SA": "966", "QA": "974", "KW": "965", "BH": "973", "OM": "968",
    "KR": "82", "JP": "81", "AU": "61", "MY": "60", "LK": "94", "DE": "49", "FR": "33", "ES": "34", "IT": "39",
}
#: Regions by country name (fixed values).
COUNTRY_REGIONS = {
    "india": "IN", "united states": "US", "usa": "US", "united kingdom": "GB", "uk": "GB", "singapore": "SG", "united arab emirates": "AE", "uae": "AE",
    "saudi arabia": "SA", "qatar": "QA", "kuwait": "KW", "bahrain": "BH", "oman": "OM", "south korea": "KR", "japan": "JP", "australia": "AU",
    "canada": "CA", "malaysia": "MY", "sri lanka": "LK", "germany": "DE", "france": "FR", "spain": "ES", "italy": "IT",
}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def phone_last10(c: Column) -> Column:
    """The last ten digits, '' under seven."""
    d = digits(c)
    return F.when(F.length(d) >= 7, F.right(d, F.lit(10))).otherwise("")


def phone_last8(c: Column) -> Column:
    """The last eight digits, '' under seven."""
    d = digits(c)
    return F.when(F.length(d) >= 7, F.right(d, F.lit(8))).otherwise("")


def phone_plain(c: Column) -> Column:
    """Only blanks, dashes and brackets are taken out."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s\-()]", "")


def phone_region(country: Column) -> Column:
    """The region of a country's name, null where unknown."""
    return _map(COUNTRY_REGIONS)[F.lower(F.trim(country))]


def to_e164(raw: Column, region: Column) -> Column:
    """+ and 8 to 15 digits, '' where that fails. With a plus or 00 the digits stand as they are; else the region's calling code is
    put before them, trunk zeros dropped."""
    d = digits(raw)
    code = _map(CALLING_CODES)[F.upper(region)]
    abroad = F.trim(F.coalesce(raw, F.lit(""))).startswith("+")
    full = (
        F.when(d == "", "").when(abroad, d).when(d.startswith("00"), F.substr(d, F.lit(3)))
        .when(code.isNull(), "").when(d.startswith(code) & (F.length(d) > F.length(code) + 7), d)
        .otherwise(F.concat(code, F.regexp_replace(d, "^0+", "")))
    )
    return F.when(F.length(full).between(8, 15), F.concat(F.lit("+"), full)).otherwise("")


def to_e164_india(c: Column) -> Column:
    """+91 and ten digits out of 10, 0+10, 91+10 or 091+10 digits; else null."""
    d = digits(c)
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("0"), F.right(d, F.lit(10))).when((F.length(d) == 12) & d.startswith("91"), F.right(d, F.lit(10))).when((F.length(d) == 13) & d.startswith("091"), F.right(d, F.lit(10)))
    return F.when(ten.isNotNull(), F.concat(F.lit("+91"), ten))


def is_mobile_india(e164: Column) -> Column:
    return e164.startswith("+91") & F.substring(e164, 4, 1).isin("6", "7", "8", "9")


def phones_in_text(c: Column) -> Column:
    """Phone-shaped pieces of a text with 8 to 15 digits, no IPv4 addresses or version numbers, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\+?\d[\d \-().]{6,18}\d)"), 1)
    return F.array_distinct(F.filter(found, lambda p: F.length(digits(p)).between(8, 15) & ~p.rlike(r"^\d{1,3}(?:\.\d{1,3}){2,3}$")))


EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: Addresses of templates, domains of services, local parts and endings that are nobody's (fixed values).
PLACEHOLDERS = (
    "user@domain.com", "your@email.com", "youremail@domain.com", "name@example.com", "email@example.com", "someone@example.com", "info@yourdomain.com",
    "test@test.com", "your@domain.com", "email@domain.com", "you@domain.com", "example@example.com", "your.email@example.com", "firstname.lastname@example.com",
)
DENIED_DOMAINS = (
    "example.com", "sentry.io", "wixpress.com", "godaddy.com", "cloudflare.com", "w3.org", "schema.org", "gstatic.com", "gravatar.com", "fontawesome.com", "google.com",
    "googleapis.com", "wordpress.org", "wp.com", "domain.com", "yourdomain.com", "email.com", "test.com", "yoursite.com", "company.com", "mydomain.com",
)
GENERIC = ("user", "yourname", "youremail", "firstname.lastname", "your.name", "shared")
FAKE_TLDS = ("fb", "local", "test", "invalid", "example", "internal", "corp")
IMAGE = r"\.(?:png|jpg|jpeg|gif|svg|webp)$"


def emails_in_text(c: Column) -> Column:
    """All addresses, lower case, the first of each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({EMAIL})"), 1), F.lower))


def is_junk_email(e: Column) -> Column:
    """Placeholders, image names, denied domains, hashes and generic boxes as local part, version-like, internal, undeliverable or
    malformed domains. The address must be in lower case; one without an @ is junk."""
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.regexp_extract(e, "@(.*)$", 1)
    return (
        e.isin(*PLACEHOLDERS) | e.rlike(IMAGE) | ~e.contains("@") | domain.isin(*DENIED_DOMAINS) | local.rlike("^[a-f0-9]{16,}$") | local.isin(*GENERIC)
        | domain.rlike(r"^\d+\.\d+") | domain.rlike(r"\b(?:staging|localhost|internal|dev)\b") | F.substring_index(domain, ".", -1).isin(*FAKE_TLDS)
        | ~domain.rlike(r"^[a-z0-9.-]+\.[a-z]{2,24}$")
    )


def is_valid_email(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(f"^{EMAIL}$"), F.lit(False))


#: A phone-shaped piece of a text (a fixed pattern).
PHONE = r"(?<![\d.])(\+?\d{1,3}[\s.-]?)?\(?\d{2,5}\)?[\s.-]?\d{3,5}[\s.-]?\d{3,5}(?![\d.])"


def phone_shapes(c: Column) -> Column:
    """The phone-shaped pieces of a text, in order. None is part of a longer chain of digits and dots, as an address of a machine or
    the number of a version are."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), 0)


def found_email(given: Column, home: Column, contact_page: Column) -> Column:
    """The address given, else the first of the home page, else the first of the contact page; '' without one."""
    first = lambda html: F.get(F.filter(emails_in_text(html), lambda e: ~is_junk_email(e)), F.lit(0))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), first(home), first(contact_page), F.lit(""))
