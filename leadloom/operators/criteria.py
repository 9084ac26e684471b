"""Search criteria applied to listings: contact rules, category lists, quality labels, terms, and the whole chain in its order.

The rules take columns, so a criteria row may be joined to the listings or given as text. Rules that name what isn't applied
(``search_radius_km``, the toggles, ``outdated``) change nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as T
from leadloom.functions import url as U
from leadloom.operators.identity import first_by_keys, without

#: Rows delivered where the criteria name no positive whole number; labels that can be excluded; friendly names of columns and the
#: columns they may be (fixed values).
DEFAULT_ROWS = 25
LABELS = ("good", "average", "poor", "none")
SPECIAL_TERMS = ("duplicates", "already contacted")
OUTPUTS = {
    "business name": ("title", "name", "business_name"), "category": ("category", "categories"), "address": ("address", "complete_address", "full_address"), "phone": ("phone", "phone_number"),
    "website": ("website", "site"), "email": ("emails", "email"), "google maps url": ("link", "google_maps_link", "url"), "rating": ("review_rating", "rating"), "review count": ("review_count", "reviews"),
    "social media urls": ("social_media", "social_links", "socials"), "negative reviews": ("negative_reviews",), "negative review count": ("negative_review_count",),
}


def column_of(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of the names that the table has, in any case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def listed(c: Column) -> Column:
    """The values of a semicolon list: lower case, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def contact_rule(flag: Column, value: Column) -> Column:
    """'yes': the value must be there; 'no': it must not; anything else: no rule."""
    said = F.lower(F.trim(F.coalesce(flag, F.lit(""))))
    return F.when(said == "yes", T.has_value(value)).when(said == "no", ~T.has_value(value)).otherwise(True)


def category_allowed(category: Column, allowed: Column) -> Column:
    """Whether the whole category or one of its parts is in the list; an empty list allows all."""
    return (F.trim(F.coalesce(allowed, F.lit(""))) == "") | F.arrays_overlap(T.category_tokens(category), listed(allowed))


def quality_kept(label: Column, excluded: Column) -> Column:
    """Whether the label isn't among the excluded ones; other words ('any', 'outdated', unknown ones) exclude nothing."""
    return ~F.array_contains(listed(excluded), label)


def says_term(name: Column, category: Column, terms: Column) -> Column:
    """Whether name or category hold one of the terms as whole words, letters of any script; the special terms aren't such."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(category, F.lit(""))))
    plain = F.filter(listed(terms), lambda t: ~t.isin(*SPECIAL_TERMS))
    return F.exists(plain, lambda t: F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))))


def lead_score(negatives: Column, reviews: Column, rating: Column) -> Column:
    """20 for each of up to three negative reviews, up to 25 for few reviews, up to 15 for a rating short of perfect."""
    neg, n, r = (F.coalesce(c, F.lit(0)) for c in (negatives, reviews, rating))
    few = F.when(n.between(1, 50), 25).when(n.between(51, 100), 15).when(n.between(101, 200), 5).otherwise(0)
    short = F.when((r > 0) & (r < 4.5), 15).when((r > 0) & (r < 4.8), 10).otherwise(0)
    return (F.least(neg, F.lit(3)) * 20 + few + short).cast("int")


def filter_leads(df: DataFrame, row: Mapping[str, str | None], order: str, history: DataFrame | None = None, contacted: DataFrame | None = None) -> DataFrame:
    """The listings that a criteria row wants, best first, in the fixed order of the rules.

    Links cleaned, numbers read (missing ones count as 0), thresholds, contact rules, first of each cid or link, category list,
    quality labels, terms, those of ``history`` (cid, link) for the term 'duplicates' and of ``contacted`` (cid, name) for
    'already contacted', score, order by score, few reviews first, then ``order``, and the row's number of leads. A 'yes' for a
    column that isn't there keeps nothing. Rows without cid and link are all kept. The cap is the feature: a top-k.
    """
    value = lambda k: (row.get(k) or "").strip()
    number = lambda k: F.coalesce(T.number(F.lit(value(k))), F.lit(0.0))
    for c in ("website", "site", "link", "google_maps_link", "url"):
        if c in df.columns:
            df = df.withColumn(c, U.clean_url(F.col(c)))
    name, category, rating = column_of(df, OUTPUTS["business name"]), column_of(df, OUTPUTS["category"]), column_of(df, OUTPUTS["rating"])
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    negatives = F.col("negative_review_count") if "negative_review_count" in df.columns else F.lit(0)
    df = df.withColumns({"review_rating": T.number(text(rating)), "review_count": T.number(text(column_of(df, ("review_count",)))), "negative_review_count": negatives})
    keep = (F.coalesce("review_rating", F.lit(0)) >= number("min_rating")) & (F.coalesce("review_count", F.lit(0)) >= number("min_reviews"))
    for flag, names in (("website_required", "website"), ("phone_required", "phone"), ("email_required", "email")):
        c = column_of(df, OUTPUTS[names])
        if c:
            keep &= contact_rule(F.lit(value(flag)), F.col(c))
        elif value(flag).lower() == "yes":
            keep &= F.lit(False)
    df = df.filter(keep)
    df = df.withColumns({"_cid": T.normalize_cid(text(column_of(df, ("cid",)))), "_link": U.link_identity(text(column_of(df, ("link",)))), "_name": T.norm_name(text(name))})
    df = first_by_keys(df, ["_cid", "_link"], order)
    label = T.quality_label(F.col("review_rating"), F.col("review_count"))
    df = df.filter(category_allowed(text(category), F.lit(value("allowed_categories"))) if category else F.lit(True))
    df = df.filter(quality_kept(label, F.lit(value("review_quality_filter"))))
    df = df.filter(~says_term(text(name), text(category), F.lit(value("exclude_terms"))))
    terms = {t.strip().lower() for t in value("exclude_terms").split(";")}
    if "duplicates" in terms and history is not None:
        df = without(df, history.select(T.normalize_cid(F.col("cid")).alias("_cid"), U.link_identity(F.col("link")).alias("_link")), ["_cid", "_link"])
    if "already contacted" in terms and contacted is not None:
        df = without(df, contacted.select(T.normalize_cid(F.col("cid")).alias("_cid"), T.norm_name(F.col("business_name")).alias("_name")), ["_cid", "_name"])
    try:
        most = int(float(value("max_leads")))
    except (ValueError, OverflowError):
        most = 0
    df = df.withColumn("lead_score", lead_score(F.col("negative_review_count"), F.col("review_count"), F.col("review_rating"))).drop("_cid", "_link", "_name")
    return df.orderBy(F.desc("lead_score"), F.asc_nulls_last("review_count"), order).limit(most if most > 0 else DEFAULT_ROWS)


def output_columns(df: DataFrame, wanted: str | None) -> DataFrame:
    """The columns of a semicolon list of friendly names, in its order; '' for those the table lacks. An empty list keeps all."""
    labels = [x.strip() for x in (wanted or "").split(";") if x.strip()]
    if not labels:
        return df
    found = [(x, column_of(df, OUTPUTS.get(x.lower(), ()))) for x in labels]
    return df.select(*[(F.col(c) if c else F.lit("")).alias(x) for x, c in found])
