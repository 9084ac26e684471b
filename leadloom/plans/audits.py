"""Queries of page detectors, issues, scores, review blobs and the criteria's filters.

The test tables hold few pages with markup, so a page is written for each audited lead from its flags and number; the same numbers
give the expected results in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import audit as A
from leadloom.functions import contact as C
from leadloom.functions import page as P
from leadloom.functions import reviews as R
from leadloom.functions import text as T
from leadloom.functions import url as U
from leadloom.operators import criteria as K
from leadloom.shared import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _says(c: str | Column, text: str) -> Column:
    return F.when(F.col(c) if isinstance(c, str) else c, F.lit(text)).otherwise("")


def lead_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lead_id, html, facts) of a page for each audited lead."""
    n = F.col("lead_id")
    parts = [
        F.lit("<html><head><title>Page "), F.repeat(F.lit("t"), (n % 80).cast("int")), F.lit("</title>"),
        F.when(n % 4 > 0, F.concat(F.lit('<meta name="description" content="'), F.repeat(F.lit("d"), (n % 200).cast("int")), F.lit('">'))).otherwise(""),
        _says(n % 3 > 0, '<meta name="viewport" content="width=device-width">'), _says(n % 2 > 0, '<link rel="canonical" href="/">'), _says(n % 7 == 0, '<meta name="robots" content="NOINDEX, follow">'),
        _says(n % 5 == 0, '<meta property="og:title" content="x">'), _says("has_chatbot", '<script src="https://embed.tawk.to/a"></script>'), _says((n % 6 == 0) & F.col("has_chatbot"), '<script src="https://client.crisp.chat/l.js"></script>'),
        F.lit("</head><body>"), F.repeat(F.lit("<h1>head</h1>"), (n % 3).cast("int")), F.repeat(F.lit('<img src="a">'), (n % 4).cast("int")), F.repeat(F.lit('<img src="a" alt="b">'), (n % 5).cast("int")),
        _says("has_whatsapp", '<a href="https://wa.me/1">chat</a>'), _says("has_appointment_booking", "<p>Book an appointment today</p>"), _says("has_trust_signals", "<p>What our clients say</p>"),
        _says("has_phone_cta", '<a href="tel:+15550100">call</a>'), F.lit('<form role="search"><input name="q"></form>'),
        F.when(F.col("has_lead_form"), F.concat(F.lit("<form>"), F.repeat(F.lit('<input type="text" name="n">'), (n % 10 + 1).cast("int")), F.lit("</form>"))).otherwise(""), F.lit("</body></html>"),
    ]
    pages = table(spark, sf_dir, "audited_leads").select("lead_id", F.concat(*parts).alias("html"))
    return pages.withColumn("facts", P.page_facts("html"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("html")
    form = F.get(P.lead_forms(F.col("facts.forms")), F.lit(0))
    return lead_pages(spark, sf_dir).select(
        "lead_id", "facts", A.chatbots(F.col("html")).alias("chatbots"), A.has_sign(low, A.WHATSAPP_SIGNS).alias("whatsapp"), A.has_sign(low, A.BOOKING_SIGNS).alias("booking"),
        form.isNotNull().alias("form"), F.coalesce(form["n_fields"], F.lit(0)).alias("fields"), F.exists("facts.hrefs", lambda h: h.rlike("(?i)^tel:")).alias("phone"), F.lower("facts.text").rlike(A.TRUST).alias("trust"),
    )


_FLAG = "coalesce({}, false)"


@query(f"""
    SELECT lead_id, CASE WHEN {_FLAG.format("has_chatbot")} THEN CASE WHEN lead_id % 6 = 0 THEN 'Crisp, Tawk.to' ELSE 'Tawk.to' END ELSE '' END AS chatbots, {_FLAG.format("has_whatsapp")} AS whatsapp,
           {_FLAG.format("has_appointment_booking")} AS booking, {_FLAG.format("has_lead_form")} AS form, CAST(CASE WHEN {_FLAG.format("has_lead_form")} THEN lead_id % 10 + 1 ELSE 0 END AS INTEGER) AS fields,
           {_FLAG.format("has_phone_cta")} AS phone, {_FLAG.format("has_trust_signals")} AS trust, lead_id % 5 = 0 AS open_graph FROM audited_leads
""")
def page_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("lead_id", F.array_join("chatbots", ", ").alias("chatbots"), "whatsapp", "booking", "form", "fields", "phone", "trust", F.coalesce(F.col("facts.og_title") != "", F.lit(False)).alias("open_graph"))


_SEO = (
    ("5 + lead_id % 80 < 10 OR 5 + lead_id % 80 > 60", "LOW: Title tag length is outside the recommended range."), ("lead_id % 4 = 0 OR lead_id % 200 = 0", "MEDIUM: Page is missing a meta description."),
    ("lead_id % 4 > 0 AND lead_id % 200 > 0 AND (lead_id % 200 < 50 OR lead_id % 200 > 160)", "LOW: Meta description length is outside the recommended range."), ("lead_id % 3 = 0", "CRITICAL: No mobile viewport meta tag."),
    ("lead_id % 3 <> 1", "LOW: Page does not have exactly one H1."), ("lead_id % 4 + lead_id % 5 > 0 AND lead_id % 4 >= 0.2 * (lead_id % 4 + lead_id % 5)", "MEDIUM: Many images are missing alt text."),
    ("lead_id % 7 = 0", "CRITICAL: Page is set to noindex."), ("lead_id % 2 = 0", "LOW: No canonical tag found."),
)
_CONVERSION = (
    ("NOT coalesce(has_chatbot, false)", "HIGH: No AI chatbot or live-chat widget detected."), ("NOT coalesce(has_whatsapp, false)", "MEDIUM: No WhatsApp click-to-chat link detected."),
    ("NOT coalesce(has_appointment_booking, false)", "MEDIUM: No appointment/booking system detected."), ("NOT coalesce(has_lead_form, false)", "HIGH: No lead-capture form detected."),
    ("coalesce(has_lead_form, false) AND lead_id % 10 + 1 > 7", "LOW: Lead-capture form is long."), ("NOT coalesce(has_phone_cta, false)", "MEDIUM: No clickable phone (tel:) link detected."),
    ("NOT coalesce(has_trust_signals, false)", "MEDIUM: No visible trust signals (testimonials/reviews) detected."),
)
_ISSUES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in (*_CONVERSION, *_SEO)) + "], lambda x: x IS NOT NULL)"


@query(f"""
    WITH i AS (SELECT lead_id, {_ISSUES} AS i FROM audited_leads), s AS (SELECT lead_id, list_concat(list_concat(list_filter(i, lambda x: x LIKE 'CRIT%'), list_filter(i, lambda x: x LIKE 'HIGH%')),
        list_concat(list_filter(i, lambda x: x LIKE 'MED%'), list_filter(i, lambda x: x LIKE 'LOW%'))) AS i FROM i)
    SELECT lead_id, array_to_string(i[1:5], '; ') AS top_issues, CAST(len(list_filter(i, lambda x: x LIKE 'CRIT%')) AS INTEGER) AS critical, CAST(len(list_filter(i, lambda x: x LIKE 'HIGH%')) AS INTEGER) AS high, CAST(len(i) AS INTEGER) AS n FROM s
""")
def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of conversion and technical search visibility in the order they are found, the gravest five, and counts by priority."""
    c = F.col
    all_issues = A.issues(*A.conversion_issues(F.size("chatbots") > 0, c("whatsapp"), c("booking"), c("form"), c("fields"), c("phone"), c("trust")), *A.seo_issues(c("facts")))
    rows = _found(spark, sf_dir).withColumn("issues", all_issues)
    of = lambda p: F.size(F.filter("issues", lambda x: x["priority"] == p))
    said = F.transform("issues", lambda x: F.struct(x["priority"].alias("severity"), x["problem"].alias("text")))
    return rows.select("lead_id", T.top_issues(said).alias("top_issues"), of("CRITICAL").alias("critical"), of("HIGH").alias("high"), F.size("issues").alias("n"))


_R = "round_even({}, 1)"


@query(f"""
    WITH b AS (SELECT lead_id, lead_id % 101 * 1.0::DOUBLE AS m, CASE WHEN lead_id % 3 > 0 THEN (lead_id % 97) * 1.0::DOUBLE END AS d, CASE WHEN lead_id % 5 > 0 THEN (lead_id % 89) * 1.0::DOUBLE END AS s, coalesce(ssl_valid, false) AS ssl, lead_id % 7 AS h,
                      CASE WHEN lead_id % 2 > 0 THEN lead_id % 3 END AS ref, CASE WHEN lead_id % 4 > 0 THEN lead_id % 8 > 3 END AS redir, lead_id % 11 AS checked, lead_id % 3 AS broken,
               (CASE WHEN lead_id % 80 + 5 BETWEEN 10 AND 60 THEN 1 ELSE 0 END + CASE WHEN lead_id % 4 > 0 AND lead_id % 200 BETWEEN 50 AND 160 THEN 1 ELSE 0 END + lead_id % 2 + CASE WHEN lead_id % 3 = 1 THEN 1 ELSE 0 END
                + CASE WHEN lead_id % 4 + lead_id % 5 = 0 OR lead_id % 4 < 0.2 * (lead_id % 4 + lead_id % 5) THEN 1 ELSE 0 END + CASE WHEN lead_id % 7 = 0 THEN 0 ELSE 1 END) AS seo FROM audited_leads)
    SELECT lead_id, {_R.format("(CASE WHEN d IS NULL THEN m * 0.6::DOUBLE / 0.6::DOUBLE ELSE m * 0.6::DOUBLE + d * 0.4::DOUBLE END) / 100 * 20")} AS performance, {_R.format("coalesce(s, 0.0::DOUBLE) / 100 * 15")} AS accessibility,
           {_R.format("(CASE WHEN s IS NULL THEN seo / 6 * 100 ELSE s * 0.5::DOUBLE + seo / 6 * 100 * 0.5::DOUBLE END) / 100 * 20")} AS seo_technical,
           {_R.format("((CASE WHEN lead_id % 3 > 0 THEN 1 ELSE 0 END) + (CASE WHEN lead_id % 3 >= 1 THEN 1 ELSE 0 END)) / 2 * 100 / 100 * 15")} AS ux_technical,
           {_R.format("(CAST(ssl AS INTEGER) + h + CASE WHEN ref = 0 THEN 1 ELSE 0 END + CASE WHEN redir THEN 1 ELSE 0 END) / (7 + CASE WHEN ref IS NULL THEN 0 ELSE 1 END + CASE WHEN redir IS NULL THEN 0 ELSE 1 END) * 10")} AS security,
           {_R.format("(CAST(lead_id % 2 = 0 AS INTEGER) + CAST(lead_id % 3 = 0 AS INTEGER) + CAST(lead_id % 5 = 0 AS INTEGER) + CASE WHEN checked > 0 THEN greatest(0.0::DOUBLE, 1 - broken / checked) ELSE 1.0::DOUBLE END) / 4 * 10")} AS technical_health FROM b
""")
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the health score: half-even rounded, missing measurements as the rules say."""
    n, d = F.col("lead_id"), lambda c: c.cast("double")
    s = F.when(n % 5 > 0, d(n % 89))
    pages = lead_pages(spark, sf_dir).join(table(spark, sf_dir, "audited_leads").select("lead_id", "ssl_valid"), "lead_id")
    return pages.select(
        "lead_id", A.score_performance(d(n % 101), F.when(n % 3 > 0, d(n % 97))).alias("performance"), A.score_accessibility(s).alias("accessibility"), A.score_seo(F.col("facts"), s).alias("seo_technical"), A.score_ux(F.col("facts")).alias("ux_technical"),
        A.score_security(F.col("ssl_valid"), n % 7, F.when(n % 2 > 0, n % 3), F.when(n % 4 > 0, n % 8 > 3)).alias("security"), A.score_technical(n % 2 == 0, n % 3 == 0, n % 5 == 0, n % 3, n % 11).alias("technical_health"),
    )


@query("""
    SELECT lead_id, CAST(CASE WHEN has_chatbot THEN 25 ELSE 0 END + CASE WHEN has_lead_form THEN 15 ELSE 0 END + CASE WHEN has_whatsapp THEN 15 ELSE 0 END + CASE WHEN has_phone_cta THEN 10 ELSE 0 END
        + CASE WHEN has_appointment_booking THEN 15 ELSE 0 END + CASE WHEN has_trust_signals THEN 10 ELSE 0 END AS DOUBLE) + round_even((lead_id % 5) / 4 * 10, 1) AS opportunity FROM audited_leads
""")
def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", A.score_opportunity(F.col("lead_id") % 5).alias("opportunity"))


@query("""
    SELECT lead_id, array_to_string(list_filter(['Strict-Transport-Security', 'Content-Security-Policy', 'X-Frame-Options', 'X-Content-Type-Options', 'Referrer-Policy', 'Permissions-Policy'],
        lambda h: NOT (h = 'Strict-Transport-Security' AND lead_id % 2 = 0 OR h = 'Content-Security-Policy' AND lead_id % 3 = 0 OR h = 'Referrer-Policy')), ', ') AS missing,
        CASE WHEN lead_id % 6 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS priority,
        array_to_string(list_filter([CASE WHEN NOT ssl_valid THEN 'CRITICAL' END, CASE WHEN ssl_valid AND lead_id % 60 < 21 THEN 'HIGH' END, CASE WHEN lead_id % 2 > 0 THEN 'HIGH' END, CASE WHEN lead_id % 3 > 0 THEN 'LOW' END, CASE WHEN lead_id % 5 > 0 THEN 'MEDIUM' END, CASE WHEN lead_id % 7 > 0 THEN 'LOW' END], lambda x: x IS NOT NULL), ' ') AS site
    FROM audited_leads
""")
def site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security headers (by name in any case), certificate, redirect, robots, sitemap and favicon."""
    n = F.col("lead_id")
    names = F.array_compact(F.array(F.when(n % 2 == 0, F.lit("strict-transport-security")), F.when(n % 3 == 0, F.lit("CONTENT-SECURITY-POLICY")), F.lit("Referrer-Policy"), F.lit("Server")))
    missing = A.missing_headers(names)
    found = A.issues(*A.ssl_issues(F.col("ssl_valid"), n % 60), *A.site_issues(n % 3 == 0, n % 5 == 0, n % 7 == 0, n % 2 == 0))
    return table(spark, sf_dir, "audited_leads").select("lead_id", F.array_join(missing, ", ").alias("missing"), A.header_issue(missing)["priority"].alias("priority"), F.array_join(F.transform(found, lambda i: i["priority"]), " ").alias("site"))


@query("""
    SELECT lead_id, array_to_string(list_filter([CASE WHEN lead_id % 101 < 50 THEN 'CRITICAL: Mobile page-load performance is poor.' WHEN lead_id % 101 < 90 THEN 'MEDIUM: Mobile page-load performance has room to improve.' END,
        CASE WHEN lead_id % 3 > 0 THEN 'MEDIUM: Images' END, CASE WHEN lead_id % 3 > 0 THEN 'MEDIUM: Caching' END, CASE WHEN lead_id % 12 < 8 THEN 'LOW: Few internal links found.' END,
        CASE WHEN lead_id % 5 > 2 THEN 'HIGH: Broken internal links found.' WHEN lead_id % 5 > 0 THEN 'MEDIUM: Broken internal links found.' END], lambda x: x IS NOT NULL), '; ') AS issues FROM audited_leads
""")
def speed_and_link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("lead_id")
    found = F.concat(A.lighthouse_issues(n % 101, F.when(n % 3 > 0, F.array(F.lit("Images: 3 s"), F.lit("Caching: 1 s: all")))), A.issues(*A.link_issues(n % 12, F.lit(4000), n % 5, F.lit(0))))
    return table(spark, sf_dir, "audited_leads").select("lead_id", F.array_join(F.transform(found, lambda i: F.concat_ws(": ", i["priority"], i["problem"])), "; ").alias("issues"))


_KEY = "(list_filter(json_keys(j), lambda k: lower(k) = '{k}'))[1]"
_VALUE = "nullif(json_extract_string(j, '$.\"' || " + _KEY + " || '\"'), '')"
_FIRST = lambda keys: "coalesce(" + ", ".join(_VALUE.format(k=k) for k in keys) + ")"
_SHORT = r"""CASE WHEN length(t) <= 400 THEN t WHEN length(regexp_extract(left(t, 400), '(?s)^(.*[.!?])', 1)) - 1 >= 200 THEN regexp_extract(left(t, 400), '(?s)^(.*[.!?])', 1) || ' ...'
    ELSE regexp_replace(coalesce(nullif(regexp_extract(left(t, 400), '(?s)^(.+) ', 1), ''), left(t, 400)), '[ ,;:\-]+$', '') || ' ...' END"""


@query(rf"""
    WITH d AS (SELECT doc_id, trim(text) AS t FROM documents), g AS (SELECT doc_id, CASE WHEN json_valid(t) AND (t LIKE '[%' OR t LIKE '{{%') THEN CASE WHEN t LIKE '[%' THEN t ELSE '[' || t || ']' END END AS t FROM d),
         e AS (SELECT doc_id, unnest(json_extract(t, '$[*]')) AS j, generate_subscripts(json_extract(t, '$[*]'), 1) AS i FROM g WHERE t IS NOT NULL),
         r AS (SELECT doc_id, i, try_cast({_FIRST(R.RATING_KEYS)} AS DOUBLE) AS stars, trim(regexp_replace({_FIRST(R.TEXT_KEYS)}, '\s+', ' ', 'g')) AS t FROM e WHERE json_type(j) = 'OBJECT'),
         n AS (SELECT doc_id, i, '(' || regexp_replace(CAST(stars AS VARCHAR), '\.0$', '') || '★) ' || {_SHORT} AS s FROM r WHERE stars < 3 AND coalesce(t, '') <> ''),
         l AS (SELECT doc_id, list(s ORDER BY i) AS s FROM n GROUP BY doc_id), c AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS reviews FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(reviews, 0) AS reviews, CAST(coalesce(len(s), 0) AS INTEGER) AS negative_review_count,
           CASE WHEN s IS NULL THEN '' ELSE array_to_string(s[1:5], ' | ') || CASE WHEN len(s) > 5 THEN ' | ...(+' || (len(s) - 5) || ' more)' ELSE '' END END AS negative_reviews
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
""")
def negative_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that are review blobs the complaints: reviews under three stars, the first five, shortened."""
    rows = table(spark, sf_dir, "documents").select("doc_id", R.reviews(F.col("text"), literals=False).alias("r")).withColumn("c", R.complaints(F.col("r")))
    return rows.select("doc_id", F.size("r").alias("reviews"), F.size("c").alias("negative_review_count"), R.negative_reviews(F.col("c")).alias("negative_reviews"))


@query("""
    SELECT lead_id, CASE lead_id % 4 WHEN 0 THEN 'LocalBusiness' WHEN 1 THEN 'Dentist, GeneralStore' WHEN 2 THEN '' ELSE 'Organization' END AS types, CASE WHEN lead_id % 4 = 3 THEN 'Second' ELSE 'First' END AS name,
           CASE WHEN lead_id % 4 = 2 THEN NULL ELSE '+1 555 ' || lead_id END AS telephone, CASE lead_id % 4 WHEN 0 THEN '1 High Street, Brackwater' WHEN 1 THEN 'Plain address' END AS address,
           lead_id % 4 = 1 AS rating, lead_id % 4 = 0 AS hours FROM audited_leads
""")
def jsonld_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD in its four shapes: one object, a graph, a list, and damaged text beside an object."""
    n = F.col("lead_id")
    tel = F.concat(F.lit('"telephone": "+1 555 '), n.cast("string"), F.lit('"'))
    shapes = F.when(n % 4 == 0, F.array(F.concat(F.lit('{"@type": "LocalBusiness", "name": "First", "address": {"streetAddress": "1 High Street", "addressLocality": "Brackwater", "postalCode": ""}, "openingHours": ["Mo"], '), tel, F.lit("}"))))
    shapes = shapes.when(n % 4 == 1, F.array(F.concat(F.lit('{"@context": "x", "@graph": [{"@type": ["Dentist", "GeneralStore", "Thing"], "name": "First", "aggregateRating": {"ratingValue": 5}}, 7, {"address": "Plain address", '), tel, F.lit("}]}"))))
    shapes = shapes.when(n % 4 == 2, F.array(F.lit('[{"@type": "WebPage", "name": "First"}, "x"]'))).otherwise(F.array(F.lit('{"@type": "Organization", "name": '), F.concat(F.lit('{"@type": "Organization", "name": "Second", '), tel, F.lit("}"))))
    nodes = F.flatten(F.transform("data", A.jsonld_nodes))
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", shapes.alias("data")).select("lead_id", A.local_schema(nodes).alias("s"))
    return rows.select("lead_id", F.array_join("s.types", ", ").alias("types"), "s.name", "s.telephone", "s.address", "s.rating", "s.hours")


_YES = "lower(trim(coalesce({c}, ''))) NOT IN ('', 'nan', 'none', 'null', '[]', '{{}}', 'n/a')"
_RULE = "CASE lower(trim(coalesce({f}, ''))) WHEN 'yes' THEN " + _YES + " WHEN 'no' THEN NOT (" + _YES + ") ELSE true END"


@query(rf"""
    WITH k AS (SELECT *, row_number() OVER (ORDER BY criteria_id) - 1 AS n FROM handyman), l AS (SELECT *, row_number() OVER (ORDER BY lead_id) - 1 AS n FROM audited_leads),
         p AS (SELECT l.*, k.website_required, k.phone_required, k.email_required, k.allowed_categories AS allowed, k.review_quality_filter AS quality, k.exclude_terms AS terms,
                      try_cast(replace(trim(l.rating), ',', '') AS DOUBLE) AS r, floor(try_cast(replace(trim(l.review_count), ',', '') AS DOUBLE)) AS c FROM l JOIN k ON l.n % (SELECT count(*) FROM handyman) = k.n),
         q AS (SELECT lead_id, {_RULE.format(f="website_required", c="website")} AND {_RULE.format(f="phone_required", c="phone")} AND {_RULE.format(f="email_required", c="email")} AS contact,
               trim(coalesce(allowed, '')) = '' OR list_has_any(list_transform(list_concat(list_concat([lower(trim(coalesce(category, '')))], regexp_split_to_array(lower(trim(coalesce(category, ''))), '[,;]')), regexp_split_to_array(lower(trim(coalesce(category, ''))), '[,;/]')), lambda x: trim(x)),
                   list_filter(list_transform(string_split(allowed, ';'), lambda x: lower(trim(x))), lambda x: x <> '')) AS category,
               NOT list_contains(list_transform(string_split(coalesce(quality, ''), ';'), lambda x: lower(trim(x))), CASE WHEN r IS NULL OR isnan(r) OR coalesce(c, 0) <= 0 THEN 'none' WHEN r >= 4.5 THEN 'good' WHEN r >= 3.5 THEN 'average' ELSE 'poor' END) AS quality,
               len(list_filter(list_filter(list_transform(string_split(coalesce(terms, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> '' AND x NOT IN ('duplicates', 'already contacted')),
                   lambda t: regexp_matches(lower(coalesce(p.business_name, '') || ' ' || coalesce(p.category, '')), '(^|[^\w])' || regexp_escape(t) || '([^\w]|$)'))) = 0 AS terms FROM p)
    SELECT lead_id, contact, category, quality, terms FROM q
""")
def criteria_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lead by the criteria row of its number: contact rules, category list, quality labels and terms, all taken from the row."""
    from leadloom.operators.identity import numbered

    criteria = table(spark, sf_dir, "handyman").select("criteria_id", "website_required", "phone_required", "email_required", F.col("allowed_categories").alias("allowed"), F.col("review_quality_filter").alias("labels"), F.col("exclude_terms").alias("terms"))
    rows = criteria.count()
    leads = table(spark, sf_dir, "audited_leads").select("lead_id", "business_name", "category", "website", "phone", "email", "rating", "review_count")
    both = numbered(leads, "lead_id", "_n").withColumn("_k", F.pmod(F.col("_n") - 1, F.lit(max(rows, 1)))).join(numbered(criteria, "criteria_id", "_c").withColumn("_k", F.col("_c") - 1), "_k")
    rule = lambda c: K.contact_rule(F.col(f"{c}_required"), F.col(c))
    label = T.quality_label(T.number(F.col("rating")), T.whole(F.col("review_count")))
    return both.select("lead_id", (rule("website") & rule("phone") & rule("email")).alias("contact"), K.category_allowed(F.col("category"), F.col("allowed")).alias("category"), K.quality_kept(label, F.col("labels")).alias("quality"), (~K.says_term(F.col("business_name"), F.col("category"), F.col("terms"))).alias("terms"))


CRITERIA = {"min_rating": "3.5", "min_reviews": "5", "website_required": "Either", "phone_required": "Yes", "email_required": "", "allowed_categories": "", "review_quality_filter": "Any; none", "exclude_terms": "gym; duplicates; already contacted", "max_leads": "n/a"}


_NAME = r"lower(trim(regexp_replace(coalesce(business_name, ''), '\s+', ' ', 'g')))"


@query(rf"""
    WITH l AS (SELECT lead_id, business_name, category, phone, trim(coalesce(input_id, '')) AS cid, coalesce(try_cast(replace(trim(rating), ',', '') AS DOUBLE), 0) AS r, try_cast(replace(trim(review_count), ',', '') AS DOUBLE) AS n FROM audited_leads),
         f AS (SELECT * FROM l WHERE r >= 3.5 AND coalesce(n, 0) >= 5 AND {_YES.format(c="phone")}),
         w AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY lead_id) AS a FROM f),
         x AS (SELECT * FROM w WHERE (cid = '' OR a = 1) AND n > 0 AND NOT isnan(r) AND NOT regexp_matches(lower(coalesce(business_name, '') || ' ' || coalesce(category, '')), '(^|[^\w])gym([^\w]|$)')
               AND ({_NAME} = '' OR {_NAME} NOT IN (SELECT {_NAME} FROM outreach_status))),
         s AS (SELECT lead_id, CAST(CASE WHEN n BETWEEN 1 AND 50 THEN 25 WHEN n BETWEEN 51 AND 100 THEN 15 WHEN n BETWEEN 101 AND 200 THEN 5 ELSE 0 END + CASE WHEN r > 0 AND r < 4.5 THEN 15 WHEN r > 0 AND r < 4.8 THEN 10 ELSE 0 END AS INTEGER) AS lead_score, n FROM x)
    SELECT lead_id, lead_score FROM s ORDER BY lead_score DESC, n ASC NULLS LAST, lead_id LIMIT 25
""")
def lead_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on one criteria row; its limit is the feature, a capped list of the best."""
    leads = table(spark, sf_dir, "audited_leads").select("lead_id", "business_name", "category", "phone", F.col("input_id").alias("cid"), "rating", "review_count")
    contacted = table(spark, sf_dir, "outreach_status").select(F.lit("").alias("cid"), "business_name")
    return K.filter_leads(leads, CRITERIA, "lead_id", contacted=contacted).select("lead_id", "lead_score")


@query("""
    SELECT business_name AS "Business Name", category AS "Category", phone AS "Phone", website AS "Website", '' AS "Fax", email AS "Email" FROM audited_leads
""")
def friendly_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.output_columns(table(spark, sf_dir, "audited_leads"), "Business Name; Category; Phone; Website; Fax;; Email")


@query("""
    SELECT lead_id, CASE WHEN trim(coalesce(business_name, '')) <> '' THEN trim(business_name) ELSE coalesce(trim(url_decode(replace(regexp_extract(coalesce(google_maps_url, ''), '/place/([^/@?]+)', 1), '+', ' '))), '') END AS business_name,
           CASE WHEN trim(coalesce(website, '')) <> '' AND audit_status IS DISTINCT FROM 'SKIPPED_NO_WEBSITE' THEN trim(website) END AS website, nullif(email, '') AS email,
           CASE WHEN isnan(try_cast(trim(rating) AS DOUBLE)) THEN NULL ELSE try_cast(trim(rating) AS DOUBLE) END AS review_rating, CASE WHEN isnan(try_cast(trim(review_count) AS DOUBLE)) THEN NULL ELSE try_cast(trim(review_count) AS DOUBLE) END AS review_count,
           nullif(audit_status, '') AS audit_status, nullif(error_text, '') AS audit_error, health_score, max_health_score, opportunity_score, max_opportunity_score, nullif(chatbot_providers, '') AS chatbot_providers,
           coalesce(critical_issue_count, 0) AS critical_issue_count, coalesce(high_issue_count, 0) AS high_issue_count, coalesce(top_issues, '') AS top_issues_raw, nullif(fetch_warning, '') AS fetch_warning, has_chatbot, has_phone_cta FROM audited_leads
""")
def normalised_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited rows under the names and types that later steps expect; flags stay true, false or unknown."""
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    num = lambda c: F.when(~F.isnan(F.trim(c).try_cast("double")), F.trim(c).try_cast("double"))
    site = F.trim(F.coalesce("website", F.lit("")))
    flag = lambda c: T.tri_state(F.col(c).cast("string")).alias(c)
    return table(spark, sf_dir, "audited_leads").select(
        "lead_id", F.coalesce(F.nullif(F.trim("business_name"), F.lit("")), U.name_from_maps_url(F.col("google_maps_url"))).alias("business_name"),
        F.when((site != "") & ~F.col("audit_status").eqNullSafe("SKIPPED_NO_WEBSITE"), site).alias("website"), none("email").alias("email"), num("rating").alias("review_rating"), num("review_count").alias("review_count"),
        none("audit_status").alias("audit_status"), none("error_text").alias("audit_error"), "health_score", "max_health_score", "opportunity_score", "max_opportunity_score", none("chatbot_providers").alias("chatbot_providers"),
        F.coalesce("critical_issue_count", F.lit(0)).alias("critical_issue_count"), F.coalesce("high_issue_count", F.lit(0)).alias("high_issue_count"), F.coalesce("top_issues", F.lit("")).alias("top_issues_raw"), none("fetch_warning").alias("fetch_warning"), flag("has_chatbot"), flag("has_phone_cta"),
    )


@query("""
    WITH e AS (SELECT lead_id, unnest(regexp_extract_all(coalesce(emails_found, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS e, generate_subscripts(regexp_extract_all(coalesce(emails_found, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), 1) AS i FROM audited_leads),
         f AS (SELECT lead_id, lower(e) AS e, min(i) AS i FROM e WHERE NOT regexp_matches(lower(e), 'example\\.|sentry|wixpress|@2x|\\.png|\\.jpg|\\.webp|yourdomain|domain\\.com') GROUP BY 1, 2),
         n AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY i) AS k FROM f)
    SELECT lead_id, array_to_string(list(e ORDER BY i), ',') AS emails FROM n WHERE k <= 5 GROUP BY 1
""")
def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in a text as a page's detector takes them: no junk, each once, at most five."""
    found = A.page_emails(F.array().cast("array<string>"), F.col("emails_found"))
    return table(spark, sf_dir, "audited_leads").select("lead_id", F.array_join(found, ",").alias("emails")).filter("emails <> ''")


@query("""
    WITH t AS (SELECT lead_id, CASE WHEN regexp_matches(trim(coalesce(website, '')), '^https?://[^/?#]+') THEN trim(website) END AS u FROM audited_leads)
    SELECT lead_id, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host,
           CASE WHEN regexp_matches(u, '^https?://www\\.') THEN regexp_replace(u, '^(https?://)www\\.', '\\1') ELSE regexp_replace(u, '^(https?://)', '\\1www.') END AS flipped,
           CASE WHEN u LIKE 'https://%' THEN 'http://' || substr(u, 9) ELSE 'https://' || substr(u, 8) END AS other FROM t WHERE u IS NOT NULL
""")
def fetch_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetcher tries in turn, and the key of the host."""
    u = F.when(F.trim("website").rlike("^https?://[^/?#]+"), F.trim("website"))
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", u.alias("u")).filter("u is not null").withColumn("v", U.url_variants(F.col("u")))
    return rows.select("lead_id", U.host_key(F.regexp_extract("u", "^https?://([^/?#]*)", 1)).alias("host"), F.get("v", F.lit(1)).alias("flipped"), F.get("v", F.lit(2)).alias("other"))


@query("""
    SELECT sheet_id, 'https://wa.me/' || regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') || '?text=' || replace(replace(url_encode('Hello ' || business_name), '+', '%20'), '%7E', '~') AS link FROM call_sheet WHERE business_name IS NOT NULL
""")
def whatsapp_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "call_sheet").filter("business_name is not null").select("sheet_id", U.whatsapp_link(C.digits(F.col("phone")), F.concat(F.lit("Hello "), "business_name")).alias("link"))


@query("""
    WITH d AS (SELECT lead_id, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS d FROM audited_leads),
         t AS (SELECT lead_id, CASE WHEN length(d) = 10 THEN d WHEN length(d) = 11 AND d LIKE '0%' OR length(d) = 12 AND d LIKE '91%' OR length(d) = 13 AND d LIKE '091%' THEN right(d, 10) END AS t FROM d)
    SELECT lead_id, left(t, 1) IN ('6', '7', '8', '9') AS mobile FROM t WHERE t IS NOT NULL
""")
def mobile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", C.to_e164_india(F.col("phone")).alias("e")).filter("e is not null").select("lead_id", C.is_mobile_india(F.col("e")).alias("mobile"))


@query("""
    SELECT lead_id, CASE lead_id % 3 WHEN 0 THEN 'https://a.example/next' WHEN 1 THEN '/home?x=1' ELSE '' END AS target, lead_id % 4 = 0 AS render FROM audited_leads
""")
def redirect_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta refresh targets and script redirects of written pages."""
    n = F.col("lead_id")
    html = F.concat(F.lit("<html>"), _says(n % 3 == 0, "<META http-equiv='refresh' content='0; URL=https://a.example/next'>"), _says(n % 3 == 1, '<meta name="a"><meta http-equiv="refresh" content="3;url=/home?x=1">'), _says(n % 4 == 0, "<script>window.location.href = 'x'</script>"))
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", html.alias("html"))
    return rows.select("lead_id", U.meta_refresh_target(F.col("html")).alias("target"), A.needs_render(F.col("html"), F.lit(False)).alias("render"))


@query("""
    SELECT lead_id, CASE lead_id % 2 WHEN 0 THEN '/a,/b?x=1' ELSE '/a,https://me.example/c' END AS internal, CASE lead_id % 3 WHEN 0 THEN 'https://facebook.com/p,https://www.instagram.com/q' ELSE 'https://facebook.com/p' END AS social FROM audited_leads
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the own host and of social networks on written pages."""
    n = F.col("lead_id")
    own = F.array(F.lit("/a"), F.lit("mailto:x@y.example"), F.lit("#top"), F.when(n % 2 == 0, "/b?x=1").otherwise("https://me.example/c#d"), F.lit("/a"), F.lit("https://other.example/"))
    net = F.array(F.lit("https://facebook.com/p?ref=1"), F.lit("https://facebook.com/sharer?u=1"), F.when(n % 3 == 0, "https://www.instagram.com/q").otherwise("https://notfacebook.com/z"))
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", own.alias("own"), net.alias("net"))
    return rows.select("lead_id", F.array_join(P.internal_links(F.col("own"), F.lit("www.me.example")), ",").alias("internal"), F.array_join(P.social_links(F.col("net"), A.SOCIAL_HOSTS), ",").alias("social"))


@query(r"""
    SELECT lead_id, regexp_extract(' ' || coalesce(phone, '') || ' ', '[^\d.]((\+?\d{1,3}[\s.-]?)?\(?\d{2,5}\)?[\s.-]?\d{3,5}[\s.-]?\d{3,5})[^\d.]', 1) AS phone FROM audited_leads
""")
def phone_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phone-shaped piece of a cell."""
    return table(spark, sf_dir, "audited_leads").select("lead_id", F.coalesce(F.get(C.phone_shapes(F.col("phone")), F.lit(0)), F.lit("")).alias("phone"))


@query("""
    SELECT lead_id, CASE lead_id % 3 WHEN 0 THEN 'own@firm.test' WHEN 1 THEN 'home@firm.co' ELSE 'desk@firm.co' END AS email FROM audited_leads
""")
def enriched_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of a row, its home page, or its contact page, in this order; junk passed over."""
    n = F.col("lead_id")
    home = F.when(n % 3 == 1, "write to noreply@example.com or HOME@firm.co").otherwise("<p>none</p>")
    return table(spark, sf_dir, "audited_leads").select("lead_id", C.found_email(F.when(n % 3 == 0, "own@firm.test"), home, F.lit("logo@2x.png desk@firm.co")).alias("email"))
