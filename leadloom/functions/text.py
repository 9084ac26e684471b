"""Names, addresses, cells, numbers and ids: native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a cell may say for nothing (fixed values).
EMPTY = ("", "nan", "none", "null", "[]", "{}", "n/a")
#: Words that don't tell brands apart (fixed values).
BRAND_STOP = ("unisex", "gym", "studio", "centre", "center", "club", "and", "the")
SEVERITY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def _rank(c: Column, table: dict[str, int], other: int) -> Column:
    out = None
    for name, n in table.items():
        out = (F.when if out is None else out.when)(c == name, n)
    return out.otherwise(other)


def has_value(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*EMPTY)


def number(c: Column) -> Column:
    """A double, thousands commas allowed; null for anything else and for NaN."""
    d = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(c: Column) -> Column:
    """An integer out of '25' and '25.0'; null for anything else."""
    return F.floor(number(c)).try_cast("int")


def tri_state(c: Column) -> Column:
    """True, false or null for unknown."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def fmt_flag(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c, "True").otherwise("False")


def norm_name(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def normalize_cid(c: Column) -> Column:
    """Trimmed, without a spreadsheet's .0; marks for nothing give ''."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.0$", "")
    return F.when(F.lower(t).isin("nan", "none", "null", "<na>"), "").otherwise(t)


def chain_key(c: Column) -> Column:
    """A name up to a spaced dash or bar or a bracket: letters, digits and single blanks in lower case, blanks for all else."""
    head = F.element_at(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+[-–—|]\s+|\("), 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(head), "[^a-z0-9 ]", " "), r"\s+", " "))


def brand_key(c: Column) -> Column:
    """The first two telling words of a name without brackets and what follows ' - '; '' with fewer."""
    head = F.element_at(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*?\)", " "), " - "), 1)
    words = F.filter(F.regexp_extract_all(F.lower(head), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(*BRAND_STOP))
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise("")


def display_name(c: Column) -> Column:
    """A name of which at least half the words of two letters or more are in capitals gets its words of three or more capitals
    capitalised, single blanks between; other names stay as they are. Words with digits and short ones stay."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    core = lambda w: F.regexp_replace(w, r"[()&,.\-]", "")
    alpha = F.filter(words, lambda w: core(w).rlike("^[A-Za-z]{2,}$"))
    upper = F.filter(alpha, lambda w: core(w).rlike("^[A-Z]+$"))
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    fixed = lambda w: F.when(~core(w).rlike("^[A-Z]{3,}$"), w).when(w.startswith("("), F.concat(F.lit("("), capital(F.substr(w, F.lit(2))))).otherwise(capital(w))
    return F.when((F.size(alpha) > 0) & (F.size(upper) * 2 >= F.size(alpha)), F.array_join(F.transform(words, fixed), " ")).otherwise(c)


def address_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")


def pincode(c: Column) -> Column:
    """The first six-digit group of an address, '' without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)", 1)


def area_before_city(c: Column, city: Column) -> Column:
    """Of a comma address: the last part left when a closing one that ends in a postcode is dropped, and then one that is the
    city; '' without one."""
    parts = address_parts(c)
    size = F.size(parts)
    cut = F.when((size > 0) & F.element_at(parts, F.greatest(size, F.lit(1))).rlike(r"\d{5,6}\s*$"), size - 1).otherwise(size)
    at = lambda n: F.element_at(parts, F.greatest(n, F.lit(1)))
    n = F.when((cut > 0) & (F.lower(at(cut)) == F.lower(F.trim(city))), cut - 1).otherwise(cut)
    return F.when(n > 0, at(n)).otherwise("")


#: States, big cities and words that no neighbourhood's name holds (fixed values).
STATES = (
    "tamil nadu", "kerala", "karnataka", "andhra pradesh", "telangana", "maharashtra", "delhi", "gujarat", "puducherry", "west bengal", "rajasthan",
    "uttar pradesh", "punjab", "haryana", "madhya pradesh", "odisha", "bihar", "goa",
)
BIG_CITIES = (
    "chennai", "mumbai", "delhi", "new delhi", "bengaluru", "bangalore", "hyderabad", "kolkata", "pune", "coimbatore", "madurai", "tiruchirappalli",
    "salem", "tiruppur", "ahmedabad", "jaipur", "kochi",
)
NO_AREA = r"(?i)\b(?:above|near|opp|opposite|behind|next|beside|road|rd|street|st|floor|building|tower|towers|complex|plaza|mall|main|cross|lane|no)\b"


def area_from_address(c: Column) -> Column:
    """The neighbourhood: closing parts with a postcode or a state are dropped, then one big city; of the rest the last part of 3 to
    28 characters without digits and without words of streets, buildings and landmarks. Null without one."""
    parts = F.reverse(address_parts(c))
    tail = lambda p: p.rlike(r"\b\d{6}\b") | F.lower(F.trim(F.regexp_replace(p, r"\s*\d{6}$", ""))).isin(*STATES)
    # How many parts from the end are tails: the place of the first that is none.
    marks = F.transform(parts, tail)
    first = F.array_position(marks, F.lit(False).cast("boolean"))
    left = F.when(first > 0, F.slice(parts, first.cast("int"), F.size(parts))).otherwise(F.array().cast("array<string>"))
    city = (F.size(left) > 0) & F.lower(F.try_element_at(left, F.lit(1))).isin(*BIG_CITIES)
    left = F.when(city, F.slice(left, F.lit(2), F.size(left))).otherwise(left)
    fit = F.filter(left, lambda p: ~p.rlike(r"\d") & F.length(p).between(3, 28) & ~p.rlike(NO_AREA))
    return F.try_element_at(fit, F.lit(1))


def location(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def shorten(c: Column, most: int) -> Column:
    """At most ``most`` characters: cut behind the last sentence if that ends in the second half, else before the last blank and
    closing marks; ' ...' added."""
    head = F.left(c, F.lit(most))
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    word = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.+) ", 1), F.lit("")), head), r"[ ,;:\-]+$", "")
    cut = F.when(F.length(sentence) - 1 >= most * 0.5, sentence).otherwise(word)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit(" ...")))


def safe_text(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def finalize_cell(c: Column) -> Column:
    """Web addresses become link formulas, the rest safe text; null gives ''."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike(r"^(?i)https?://\S+$"), F.concat(F.lit('=HYPERLINK("'), F.replace(t, F.lit('"'), F.lit("%22")), F.lit('","Open")'))).otherwise(safe_text(t))


def truncate_cell(c: Column, most: int = 32000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(" ...[TRUNCATED]"))).otherwise(c)


def printable(c: Column) -> Column:
    """Without control characters that cells can't hold."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def parse_issues(c: Column) -> Column:
    """'SEVERITY: text; ...' as structs of severity (MEDIUM without one) and text, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda p: p != "")
    rx = r"^([A-Za-z]+)\s*:\s*([^\n]+)$"
    known = lambda p: F.upper(F.regexp_extract(p, rx, 1)).isin(*SEVERITY)
    return F.transform(parts, lambda p: F.struct(F.when(known(p), F.upper(F.regexp_extract(p, rx, 1))).otherwise("MEDIUM").alias("severity"), F.when(known(p), F.regexp_extract(p, rx, 2)).otherwise(p).alias("text")))


def top_issues(issues: Column, n: int = 5) -> Column:
    """The n gravest, ties in order, as 'SEVERITY: text; ...'."""
    ranked = F.array_sort(F.transform(issues, lambda x, i: F.struct(_rank(x["severity"], SEVERITY, 9).alias("rank"), i.alias("i"), F.concat_ws(": ", x["severity"], x["text"]).alias("said"))))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda x: x["said"]), "; ")


#: Kinds of fetch errors, in the order tried, and what tells them (fixed values).
ERRORS = (
    ("Domain not found (DNS)", ("nameresolution", "name or service not known", "getaddrinfo", "nodename nor servname", "failed to resolve")),
    ("Timeout", ("timed out", "timeout")), ("SSL error", ("certificate", "ssl")), ("Connection failed", ("connection refused", "max retries", "connectionerror")),
    ("Server error (5xx)", ("500", "502", "503", "504")), ("Blocked (403)", ("403", "forbidden")),
)


def error_label(c: Column) -> Column:
    """The kind of a fetch error; the first that fits, else 'Other error'."""
    t = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for label, signs in ERRORS:
        out = (F.when if out is None else out.when)(t.rlike("|".join(signs)), label)
    return out.otherwise("Other error")


def lead_id(maps_url: Column, website: Column, phone: Column, name: Column) -> Column:
    """16 hex digits of the md5 of the map link in lower case, else of the website's domain and the phone's last ten digits, else of
    the name in lower case, else of 'unknown'."""
    from leadloom.functions.contact import phone_last10
    from leadloom.functions.url import domain_key

    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    both = F.concat(F.coalesce(domain_key(website), F.lit("")), F.lit("|"), F.coalesce(phone_last10(phone), F.lit("")))
    base = F.coalesce(F.nullif(plain(maps_url), F.lit("")), F.nullif(both, F.lit("|")), F.nullif(plain(name), F.lit("")), F.lit("unknown"))
    return F.left(F.md5(base), F.lit(16))


def variant(id_hex: Column, n: int = 3) -> Column:
    """The hash modulo 3 or 15's divisors, by the sum of its digits (16 is 1 modulo these)."""
    return F.aggregate(F.filter(F.split(id_hex, ""), lambda d: d != ""), F.lit(0), lambda t, d: t + F.conv(d, 16, 10).cast("int")) % n


def quality_label(rating: Column, reviews: Column) -> Column:
    return F.when(rating.isNull() | (F.coalesce(reviews, F.lit(0)) <= 0), "none").when(rating >= 4.5, "good").when(rating >= 3.5, "average").otherwise("poor")


def category_tokens(c: Column) -> Column:
    """The whole text, its pieces between commas and semicolons, and those between slashes; lower case, each once, sorted."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    pieces = F.concat(F.array(t), F.split(t, "[,;]"), F.split(t, "[,;/]"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda p: p != "")))


def has_word(c: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text as whole words."""
    import re

    return F.lower(F.coalesce(c, F.lit(""))).rlike(r"(?:^|[^a-z0-9_])(?:" + "|".join(re.escape(t.lower()) for t in terms) + r")(?:[^a-z0-9_]|$)")


def short_number(c: Column) -> Column:
    """A double as text without a closing .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


#: Gaps that can be sold: flag and label (fixed values).
SCOPE_GAPS = (
    ("has_chatbot", "AI chatbot / instant replies"), ("has_lead_form", "lead-capture form"), ("has_phone_cta", "tap-to-call button"), ("has_appointment_booking", "online appointment booking"),
)


def gap_labels() -> Column:
    """The labels of the flags that are false; unknown ones are no gaps."""
    return F.array_compact(F.array(*[F.when(~F.col(f), F.lit(label)) for f, label in SCOPE_GAPS]))


def priority_rank(c: Column) -> Column:
    """HOT, WARM, COLD, and all else last."""
    return _rank(F.upper(F.trim(c)), {"HOT": 0, "WARM": 1, "COLD": 2}, 3)
