"""Queries of the scalar library: URLs, phones, e-mails, names, addresses, cells, numbers, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contact as C
from leadloom.functions import text as T
from leadloom.functions import url as U
from leadloom.shared import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


TRACK = r"^(utm_[^=]*|fbclid|gclid|gclsrc|dclid|msclkid|igshid|mc_cid|mc_eid|_ga|authuser|rclk|entry|g_ep|hl)(=|$)"


@query(f"""
    WITH q AS (SELECT lead_id, split_part(website, '#', 1) AS bare FROM audited_leads WHERE website IS NOT NULL),
         k AS (SELECT lead_id, split_part(bare, '?', 1) AS path,
                      array_to_string(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i){TRACK}')), '&') AS kept FROM q)
    SELECT lead_id, path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS clean FROM k
""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").filter("website is not null").select("lead_id", U.clean_url(F.col("website")).alias("clean"))


@query(f"""
    SELECT lower(split_part(p, '=', 1)) AS param, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT unnest(string_split(regexp_extract(split_part(website, '#', 1), '\\?(.*)$', 1), '&')) AS p FROM audited_leads)
    WHERE regexp_matches(p, '(?i){TRACK}') GROUP BY 1
""")
def tracking_param_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select(F.explode(U.tracking_params(F.col("website"))).alias("param")).groupBy("param").agg(F.count("*").alias("n"))


@query(r"""
    WITH t AS (SELECT lead_id, trim(coalesce(website, '')) AS u FROM audited_leads)
    SELECT lead_id, CASE WHEN regexp_matches(u, '^([A-Za-z][A-Za-z0-9+.-]*)://') THEN
        lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) || '://' || lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2))
        || regexp_replace(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '/+$', '') ELSE lower(u) END AS identity FROM t
""")
def link_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", U.link_identity(F.col("website")).alias("identity"))


@query(r"""
    WITH t AS (SELECT sheet_id, regexp_replace(regexp_replace(lower(trim(coalesce(website, ''))), '^https?://', ''), '^www\.', '') AS u, lower(trim(coalesce(website, ''))) LIKE '=hyperlink%' AS f,
                      regexp_replace(coalesce(website, ''), '^[\s"'']+|[\s"'']+$', '', 'g') AS bare FROM call_sheet)
    SELECT sheet_id, regexp_extract(u, '^([^/]*)', 1) AS domain, CASE WHEN f THEN '' ELSE regexp_extract(u, '^([^/?]*)', 1) END AS sheet_domain,
           CASE WHEN bare = '' OR regexp_matches(bare, '(?i)^https?://') THEN bare ELSE 'https://' || bare END AS url FROM t
""")
def domain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("website")
    return table(spark, sf_dir, "call_sheet").select("sheet_id", U.domain_key(w).alias("domain"), U.sheet_domain_key(w).alias("sheet_domain"), U.normalize_url(w).alias("url"))


@query(r"""
    SELECT lead_id, trim(url_decode(replace(regexp_extract(coalesce(google_maps_url, ''), '/place/([^/@?]+)', 1), '+', ' '))) AS place FROM audited_leads
""")
def maps_place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", U.name_from_maps_url(F.col("google_maps_url")).alias("place"))


@query(r"""
    WITH d AS (SELECT lead_id, phone, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS d FROM audited_leads)
    SELECT lead_id, CASE WHEN length(d) >= 7 THEN right(d, 10) ELSE '' END AS last10, CASE WHEN length(d) >= 7 THEN right(d, 8) ELSE '' END AS last8,
           regexp_replace(trim(coalesce(phone, '')), '[\s\-()]', '', 'g') AS plain FROM d
""")
def phone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("phone")
    return table(spark, sf_dir, "audited_leads").select("lead_id", C.phone_last10(p).alias("last10"), C.phone_last8(p).alias("last8"), C.phone_plain(p).alias("plain"))


_CODE = "CASE upper(phone_region) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CALLING_CODES.items()) + " END"


@query(rf"""
    WITH d AS (SELECT lead_id, phone, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS d, {_CODE} AS code FROM audited_leads),
         f AS (SELECT lead_id, d, CASE WHEN d = '' THEN '' WHEN trim(coalesce(phone, '')) LIKE '+%' THEN d WHEN d LIKE '00%' THEN substr(d, 3) WHEN code IS NULL THEN ''
                    WHEN starts_with(d, code) AND length(d) > length(code) + 7 THEN d ELSE code || regexp_replace(d, '^0+', '') END AS f FROM d)
    SELECT lead_id, CASE WHEN length(f) BETWEEN 8 AND 15 THEN '+' || f ELSE '' END AS e164,
           CASE WHEN length(d) = 10 THEN '+91' || d WHEN length(d) = 11 AND d LIKE '0%' THEN '+91' || right(d, 10) WHEN length(d) = 12 AND d LIKE '91%' THEN '+91' || right(d, 10)
                WHEN length(d) = 13 AND d LIKE '091%' THEN '+91' || right(d, 10) END AS e164_in FROM f
""")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", C.to_e164(F.col("phone"), F.col("phone_region")).alias("e164"), C.to_e164_india(F.col("phone")).alias("e164_in"))


@query("SELECT criteria_id, CASE lower(trim(country)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.COUNTRY_REGIONS.items()) + " END AS region FROM handyman")
def phone_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "handyman").select("criteria_id", C.phone_region(F.col("country")).alias("region"))


@query(rf"""
    WITH e AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{C.EMAIL}'), lambda x: lower(x))) AS e FROM documents), d AS (SELECT *, split_part(e, '@', 1) AS l, split_part(e, '@', 2) AS d FROM e)
    SELECT doc_id, e AS email, e IN {C.PLACEHOLDERS} OR regexp_matches(e, '{C.IMAGE}') OR d IN {C.DENIED_DOMAINS} OR regexp_matches(l, '^[a-f0-9]{{16,}}$') OR l IN {C.GENERIC} OR regexp_matches(d, '^\d+\.\d+')
        OR regexp_matches(d, '\b(?:staging|localhost|internal|dev)\b') OR regexp_extract(d, '([^.]*)$', 1) IN {C.FAKE_TLDS} OR NOT regexp_matches(d, '^[a-z0-9.-]+\.[a-z]{{2,24}}$') AS junk FROM d
""")
def emails_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(C.emails_in_text(F.col("text"))).alias("email"))
    return found.withColumn("junk", C.is_junk_email(F.col("email")))


@query(rf"SELECT status_id, coalesce(regexp_full_match(trim(email), '{C.EMAIL}'), false) AS valid FROM outreach_status")
def valid_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "outreach_status").select("status_id", C.is_valid_email(F.col("email")).alias("valid"))


@query(rf"""
    WITH p AS (SELECT lead_id, address, list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS a FROM audited_leads),
         e AS (SELECT *, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM p),
         t AS (SELECT lead_id, max(i) FILTER (WHERE NOT (regexp_matches(x, '\b\d{{6}}\b') OR lower(trim(regexp_replace(x, '\s*\d{{6}}$', ''))) IN {T.STATES})) AS z FROM e GROUP BY 1),
         c AS (SELECT lead_id, max(CASE WHEN i = z AND lower(x) IN {T.BIG_CITIES} THEN z - 1 WHEN i = z THEN z END) AS z FROM e JOIN t USING (lead_id) GROUP BY 1),
         f AS (SELECT lead_id, arg_max(x, i) AS n FROM e JOIN c USING (lead_id) WHERE i <= z AND NOT regexp_matches(x, '\d') AND length(x) BETWEEN 3 AND 28 AND NOT regexp_matches(x, '{T.NO_AREA}') GROUP BY 1),
         k AS (SELECT *, CASE WHEN len(a) > 0 AND regexp_matches(a[len(a)], '\d{{5,6}}\s*$') THEN len(a) - 1 ELSE len(a) END AS n0 FROM p),
         m AS (SELECT *, CASE WHEN n0 > 0 AND lower(a[n0]) = 'singapore' THEN n0 - 1 ELSE n0 END AS n1 FROM k)
    SELECT m.lead_id, regexp_extract(coalesce(address, ''), '(?:^|[^0-9])([0-9]{{6}})(?:[^0-9]|$)', 1) AS pincode, CASE WHEN n1 > 0 THEN a[n1] ELSE '' END AS area, f.n AS neighbourhood FROM m LEFT JOIN f USING (lead_id)
""")
def area_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    return table(spark, sf_dir, "audited_leads").select("lead_id", T.pincode(a).alias("pincode"), T.area_before_city(a, F.lit("Singapore")).alias("area"), T.area_from_address(a).alias("neighbourhood"))


@query(r"""
    SELECT lead_id, trim(regexp_replace(regexp_replace(lower(regexp_split_to_array(trim(coalesce(business_name, '')), '\s+[-–—|]\s+|\(')[1]), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS chain_key,
           lower(trim(regexp_replace(coalesce(business_name, ''), '\s+', ' ', 'g'))) AS name_key FROM audited_leads
""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("business_name")
    return table(spark, sf_dir, "audited_leads").select("lead_id", T.chain_key(n).alias("chain_key"), T.norm_name(n).alias("name_key"))


@query(rf"""
    WITH w AS (SELECT sheet_id, business_name AS name, list_filter(regexp_split_to_array(business_name, '\s+'), lambda x: x <> '') AS words,
                      list_filter(regexp_extract_all(lower(string_split(regexp_replace(coalesce(business_name, ''), '\(.*?\)', ' ', 'g'), ' - ')[1]), '[a-z0-9]+'), lambda x: x NOT IN {T.BRAND_STOP}) AS b FROM call_sheet),
         k AS (SELECT *, list_filter(words, lambda x: regexp_full_match(regexp_replace(x, '[()&,.\-]', '', 'g'), '[A-Za-z]{{2,}}')) AS alpha FROM w)
    SELECT sheet_id, CASE WHEN len(b) >= 2 THEN b[1] || ' ' || b[2] ELSE '' END AS brand,
           CASE WHEN len(alpha) > 0 AND 2 * len(list_filter(alpha, lambda x: regexp_full_match(regexp_replace(x, '[()&,.\-]', '', 'g'), '[A-Z]+'))) >= len(alpha)
                THEN array_to_string(list_transform(words, lambda x: CASE WHEN NOT regexp_full_match(regexp_replace(x, '[()&,.\-]', '', 'g'), '[A-Z]{{3,}}') THEN x WHEN x LIKE '(%' THEN '(' || upper(substr(x, 2, 1)) || lower(substr(x, 3))
                     ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), ' ') ELSE name END AS display FROM k
""")
def brand_and_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("business_name")
    return table(spark, sf_dir, "call_sheet").select("sheet_id", T.brand_key(n).alias("brand"), T.display_name(n).alias("display"))


@query(r"""
    SELECT criteria_id, concat_ws(', ', nullif(trim(city_area), ''), nullif(trim(area_extra), ''), nullif(trim(state_province), ''), nullif(trim(country), '')) AS location,
           CASE lower(trim(coalesce(priority, ''))) WHEN 'high' THEN 7 WHEN 'medium' THEN 5 WHEN 'low' THEN 3 ELSE 5 END AS depth FROM handyman
""")
def search_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lower(F.trim(F.coalesce("priority", F.lit(""))))
    depth = F.when(p == "high", 7).when(p == "medium", 5).when(p == "low", 3).otherwise(5)
    return table(spark, sf_dir, "handyman").select("criteria_id", T.location(*map(F.col, ("city_area", "area_extra", "state_province", "country"))).alias("location"), depth.alias("depth"))


@query(r"""
    WITH t AS (SELECT criteria_id, concat_ws(', ', nullif(trim(city_area), ''), nullif(trim(area_extra), ''), nullif(trim(state_province), ''), nullif(trim(country), '')) AS location,
                      list_concat([coalesce(business_category, '')], string_split(coalesce(keywords, ''), ';')) AS terms FROM handyman),
         e AS (SELECT criteria_id, location, generate_subscripts(terms, 1) AS spot, trim(unnest(terms)) AS term FROM t),
         f AS (SELECT criteria_id, location, lower(term) AS low, min(spot) AS spot, arg_min(term, spot) AS term FROM e WHERE term <> '' AND location <> '' GROUP BY 1, 2, 3)
    SELECT criteria_id, term || ' in ' || location AS query, CAST(row_number() OVER (PARTITION BY criteria_id ORDER BY spot) AS INTEGER) AS pos FROM f
""")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and keywords, each once whatever its case, joined to the place, in order: within the row, nothing is shuffled."""
    rows = table(spark, sf_dir, "handyman").withColumn("location", T.location(*map(F.col, ("city_area", "area_extra", "state_province", "country"))))
    terms = F.filter(F.transform(F.concat(F.array(F.coalesce("business_category", F.lit(""))), F.split(F.coalesce("keywords", F.lit("")), ";")), lambda x: F.trim(x)), lambda t: t != "")
    low = F.transform("terms", F.lower)
    once = F.filter(F.col("terms"), lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return rows.withColumn("terms", terms).filter("location <> ''").select("criteria_id", "location", F.posexplode(once).alias("at", "term")).select("criteria_id", F.concat("term", F.lit(" in "), "location").alias("query"), (F.col("at") + 1).alias("pos"))


@query(r"""
    WITH t AS (SELECT sheet_id, coalesce(website, '') AS w, coalesce(phone, '') AS p FROM call_sheet)
    SELECT sheet_id, CASE WHEN regexp_matches(w, '(?i)^https?://\S+$') THEN '=HYPERLINK("' || replace(w, '"', '%22') || '","Open")' WHEN regexp_matches(w, '^[=+\-@]') THEN '''' || w ELSE w END AS website_cell,
           CASE WHEN regexp_matches(p, '^[=+\-@]') THEN '''' || p ELSE p END AS phone_cell FROM t
""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "call_sheet").select("sheet_id", T.finalize_cell(F.col("website")).alias("website_cell"), T.safe_text(F.coalesce("phone", F.lit(""))).alias("phone_cell"))


_ISSUES = r"""
    p AS (SELECT lead_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT lead_id, list_filter(list_transform(string_split(coalesce(top_issues, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS a FROM audited_leads)),
    s AS (SELECT lead_id, i, CASE WHEN upper(regexp_extract(x, '^([A-Za-z]+)\s*:\s*([^\n]+)$', 1)) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(regexp_extract(x, '^([A-Za-z]+)\s*:\s*([^\n]+)$', 1)) ELSE 'MEDIUM' END AS severity,
                 CASE WHEN upper(regexp_extract(x, '^([A-Za-z]+)\s*:\s*([^\n]+)$', 1)) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN regexp_extract(x, '^([A-Za-z]+)\s*:\s*([^\n]+)$', 2) ELSE x END AS text FROM p)
"""


@query(f"""
    WITH {_ISSUES}
    SELECT severity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT lead_id) AS BIGINT) AS leads FROM s GROUP BY 1
""")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _issues(spark, sf_dir)
    return rows.select("lead_id", F.explode("issues.severity").alias("severity")).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("lead_id").alias("leads"))


@query(f"""
    WITH {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, i) AS r FROM s)
    SELECT lead_id, string_agg(severity || ': ' || text, '; ' ORDER BY r) AS gravest FROM r WHERE r <= 5 GROUP BY 1
""")
def gravest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted within each row's array: no window, no shuffle."""
    return _issues(spark, sf_dir).filter("size(issues) > 0").select("lead_id", T.top_issues(F.col("issues")).alias("gravest"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", T.parse_issues(F.col("top_issues")).alias("issues"))


@query(
    "WITH t AS (SELECT lower(coalesce(error_text, '')) AS t FROM audited_leads) SELECT CASE "
    + " ".join(f"WHEN regexp_matches(t, '{'|'.join(signs)}') THEN '{label}'" for label, signs in T.ERRORS)
    + " ELSE 'Other error' END AS label, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1"
)
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").groupBy(T.error_label(F.col("error_text")).alias("label")).agg(F.count("*").alias("n"))


@query(r"""
    SELECT lead_id, try_cast(replace(trim(rating), ',', '') AS DOUBLE) AS rating, CAST(floor(try_cast(replace(trim(review_count), ',', '') AS DOUBLE)) AS INTEGER) AS reviews FROM audited_leads
    WHERE coalesce(NOT isnan(try_cast(replace(trim(rating), ',', '') AS DOUBLE)), true)
""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", T.number(F.col("rating")).alias("rating"), T.whole(F.col("review_count")).alias("reviews"))


@query(r"""
    WITH r AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(lower(trim(coalesce(website, ''))), '^https?://', ''), '^www\.', ''), '^([^/]*)', 1) AS d,
                      CASE WHEN length(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) >= 7 THEN right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 10) ELSE '' END AS p FROM audited_leads),
         t AS (SELECT lead_id, coalesce(nullif(lower(trim(google_maps_url)), ''), nullif(d || '|' || p, '|'), nullif(lower(trim(business_name)), ''), 'unknown') AS k FROM r)
    SELECT lead_id, left(md5(k), 16) AS stable_id FROM t
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", T.lead_id(*map(F.col, ("google_maps_url", "website", "phone", "business_name"))).alias("stable_id"))


@query(r"""
    WITH h AS (SELECT lead_id, md5(CAST(lead_id AS VARCHAR)) AS h FROM audited_leads)
    SELECT lead_id, CAST(list_sum(list_transform(string_split(h, ''), lambda d: strpos('0123456789abcdef', d) - 1)) % 3 AS INTEGER) AS variant FROM h
""")
def variant_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").select("lead_id", T.variant(F.md5(F.col("lead_id").cast("string"))).alias("variant"))


@query(r"""
    SELECT doc_id, CASE WHEN length(text) > 32000 THEN left(text, 32000) || ' ...[TRUNCATED]' ELSE text END AS cell,
           CAST(length(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS INTEGER) AS printable_chars FROM documents
""")
def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_cell(F.col("text")).alias("cell"), F.length(T.printable(F.coalesce("text", F.lit("")))).alias("printable_chars"))


@query()
def phones_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.phones_in_text(F.col("text"))).alias("phone"))


@query(r"""
    SELECT doc_id, CASE WHEN text IS NULL OR length(text) <= 400 THEN text WHEN length(regexp_extract(left(text, 400), '(?s)^(.*[.!?])', 1)) - 1 >= 200 THEN regexp_extract(left(text, 400), '(?s)^(.*[.!?])', 1) || ' ...'
           ELSE regexp_replace(coalesce(nullif(regexp_extract(left(text, 400), '(?s)^(.+) ', 1), ''), left(text, 400)), '[ ,;:\-]+$', '') || ' ...' END AS short FROM documents
""")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text"), 400).alias("short"))


@query("SELECT lead_id, " + ", ".join(f"CASE WHEN {f} IS NULL THEN 'unknown' WHEN {f} THEN 'True' ELSE 'False' END AS {f}" for f in ("has_chatbot", "has_whatsapp", "ssl_valid"))
       + ", array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {f} THEN '{t}' END" for f, t in T.SCOPE_GAPS) + "], lambda x: x IS NOT NULL), ', ') AS gaps FROM audited_leads")
def flag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as text, and the labels of those that are false."""
    return table(spark, sf_dir, "audited_leads").select("lead_id", *[T.fmt_flag(F.col(f)).alias(f) for f in ("has_chatbot", "has_whatsapp", "ssl_valid")], F.array_join(T.gap_labels(), ", ").alias("gaps"))


@query(f"""
    WITH {_ISSUES}, f AS (SELECT lead_id, severity, min(i) AS i FROM s GROUP BY 1, 2) SELECT lead_id, string_agg(severity, '; ' ORDER BY i) AS reasons FROM f GROUP BY 1
""")
def distinct_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reason once, in the order of its first mention."""
    found = T.parse_issues(F.col("top_issues"))["severity"]
    return table(spark, sf_dir, "audited_leads").select("lead_id", F.array_join(F.array_distinct(found), "; ").alias("reasons")).filter("reasons <> ''")
