"""Queries of joins, de-duplication, upserts and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contact as C
from leadloom.functions import text as T
from leadloom.functions import url as U
from leadloom.operators import identity as I
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


_DD = """
    WITH r AS (SELECT lead_id, trim(coalesce(google_maps_url, '')) AS k1, trim(coalesce(website, '')) AS k2 FROM audited_leads),
         w AS (SELECT lead_id, k1, k2, row_number() OVER (PARTITION BY k1 ORDER BY lead_id {o}) AS r1, row_number() OVER (PARTITION BY k2 ORDER BY lead_id {o}) AS r2 FROM r)
    SELECT lead_id FROM w WHERE (k1 = '' OR r1 = 1) AND (k2 = '' OR r2 = 1)
"""


def _identified(spark, sf_dir):
    return table(spark, sf_dir, "audited_leads").select("lead_id", F.trim(F.coalesce("google_maps_url", F.lit(""))).alias("k1"), F.trim(F.coalesce("website", F.lit(""))).alias("k2"))


@query(_DD.format(o=""))
def identity_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_by_keys(_identified(spark, sf_dir), ["k1", "k2"], "lead_id").select("lead_id")


@query(_DD.format(o="DESC"))
def identity_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_by_keys(_identified(spark, sf_dir), ["k1", "k2"], "lead_id", keep="last").select("lead_id")


@query(r"""
    WITH r AS (SELECT lead_id, regexp_extract(regexp_replace(regexp_replace(lower(trim(coalesce(website, ''))), '^https?://', ''), '^www\.', ''), '^([^/]*)', 1) AS d,
                      CASE WHEN length(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) >= 7 THEN right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 10) ELSE '' END AS p FROM audited_leads),
         w AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY lead_id) AS r1, row_number() OVER (PARTITION BY p ORDER BY lead_id) AS r2 FROM r)
    SELECT lead_id FROM w WHERE (d = '' OR r1 = 1) AND (p = '' OR r2 = 1)
""")
def domain_phone_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", U.domain_key(F.col("website")).alias("d"), C.phone_last10(F.col("phone")).alias("p"))
    return I.first_by_keys(rows, ["d", "p"], "lead_id").select("lead_id")


@query(r"""
    WITH k AS (SELECT lead_id, trim(regexp_replace(regexp_replace(lower(regexp_split_to_array(trim(coalesce(business_name, '')), '\s+[-–—|]\s+|\(')[1]), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM audited_leads)
    SELECT lead_id, CAST(CASE WHEN k = '' THEN 0 ELSE count(*) OVER (PARTITION BY k) END AS BIGINT) AS branches FROM k
""")
def chain_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per chain key, by a partial count and a join back instead of a window over a hot key."""
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", T.chain_key(F.col("business_name")).alias("k"))
    n = rows.filter("k <> ''").groupBy("k").agg(F.count("*").alias("n"))
    return rows.join(n, "k", "left").select("lead_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("branches"))


@query(rf"""
    WITH w AS (SELECT lead_id, business_name, coalesce(try_cast(replace(trim(review_count), ',', '') AS DOUBLE), 0) AS n, coalesce(try_cast(replace(trim(rating), ',', '') AS DOUBLE), 0) AS r,
                      list_filter(regexp_extract_all(lower(string_split(regexp_replace(coalesce(business_name, ''), '\(.*?\)', ' ', 'g'), ' - ')[1]), '[a-z0-9]+'), lambda x: x NOT IN {T.BRAND_STOP}) AS b FROM audited_leads),
         k AS (SELECT lead_id, business_name, b[1] || ' ' || b[2] AS brand, row_number() OVER (PARTITION BY b[1] || ' ' || b[2] ORDER BY n DESC, r DESC, lead_id) AS place,
                      first_value(business_name) OVER (PARTITION BY b[1] || ' ' || b[2] ORDER BY n DESC, r DESC, lead_id) AS main, count(*) OVER (PARTITION BY b[1] || ' ' || b[2]) AS members FROM w WHERE len(b) >= 2)
    SELECT lead_id, brand, place > 1 AS brand_skip, CASE WHEN place = 1 THEN 'keep: main branch of same brand (also: ' || (members - 1) || ' others)' ELSE 'skip: same brand as ' || main || ' (more reviews)' END AS brand_duplicate
    FROM k WHERE members >= 2
""")
def brand_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of a brand met twice or more: that of most reviews, then the best rating, then the first stays, the others are marked.

    The main branch is found by a partial aggregation and joined back, as a brand may be any share of the rows; so the note of the
    main branch says how many others there are instead of naming all of them.
    """
    number = lambda c: F.coalesce(T.number(F.col(c)), F.lit(0.0))
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", "business_name", T.brand_key(F.col("business_name")).alias("brand"), F.struct(number("review_count").alias("n"), number("rating").alias("r"), (-F.col("lead_id")).alias("o")).alias("rank")).filter("brand <> ''")
    main = rows.groupBy("brand").agg(F.max_by("lead_id", "rank").alias("main_id"), F.max_by("business_name", "rank").alias("main"), F.count("*").alias("members")).filter("members >= 2")
    first = F.col("lead_id") == F.col("main_id")
    note = F.when(first, F.concat(F.lit("keep: main branch of same brand (also: "), (F.col("members") - 1).cast("string"), F.lit(" others)"))).otherwise(F.concat(F.lit("skip: same brand as "), "main", F.lit(" (more reviews)")))
    return rows.join(main, "brand").select("lead_id", "brand", (~first).alias("brand_skip"), note.alias("brand_duplicate"))


_PLAIN = r"regexp_replace(trim(coalesce({c}, '')), '[\s\-()]', '', 'g')"


@query(f"""
    SELECT sheet_id FROM call_sheet WHERE {_PLAIN.format(c="phone")} = '' OR {_PLAIN.format(c="phone")} NOT IN (SELECT {_PLAIN.format(c="phone")} FROM permanent_leads)
""")
def ledger_phone_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "permanent_leads").select(C.phone_plain(F.col("phone")).alias("p"))
    return I.without(table(spark, sf_dir, "call_sheet").select("sheet_id", C.phone_plain(F.col("phone")).alias("p")), known, ["p"]).select("sheet_id")


@query("""
    SELECT i_d FROM permanent_leads WHERE lower(trim(coalesce(business_name, ''))) = '' OR lower(trim(coalesce(business_name, ''))) NOT IN (SELECT lower(trim(coalesce(business_name, ''))) FROM outreach_status)
""")
def status_name_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.trim(F.coalesce("business_name", F.lit("")))).alias("n")
    return I.without(table(spark, sf_dir, "permanent_leads").select("i_d", name), table(spark, sf_dir, "outreach_status").select(name), ["n"]).select("i_d")


_LEAD_KEY = "coalesce(nullif(trim(google_maps_url), ''), lower(trim(coalesce(business_name, ''))) || '|' || lower(trim(coalesce(website, ''))))"


@query(f"""
    SELECT lead_id FROM audited_leads WHERE {_LEAD_KEY} NOT IN (SELECT {_LEAD_KEY} FROM audited_leads WHERE audit_status IS DISTINCT FROM 'FAILED')
""")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads whose key has no audit that succeeded: what a resumed run still has to do."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    key = F.coalesce(F.nullif(F.trim("google_maps_url"), F.lit("")), F.concat(plain("business_name"), F.lit("|"), plain("website")))
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", "audit_status", key.alias("k"))
    return I.without(rows, rows.filter(~F.col("audit_status").eqNullSafe("FAILED")).select("k"), ["k"]).select("lead_id")


@query(f"""
    SELECT i_d FROM permanent_leads
    WHERE ({_PLAIN.format(c="phone")} = '' OR {_PLAIN.format(c="phone")} NOT IN (SELECT {_PLAIN.format(c="phone")} FROM audited_leads))
      AND (lower(trim(coalesce(website, ''))) = '' OR lower(trim(coalesce(website, ''))) NOT IN (SELECT lower(trim(coalesce(website, ''))) FROM audited_leads))
""")
def master_history_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share neither of two identities with the history; empty ones are none."""
    keys = lambda name, *more: table(spark, sf_dir, name).select(*more, C.phone_plain(F.col("phone")).alias("p"), F.lower(F.trim(F.coalesce("website", F.lit("")))).alias("w"))
    return I.without(keys("permanent_leads", "i_d"), keys("audited_leads"), ["p", "w"]).select("i_d")


_NAME = r"lower(trim(regexp_replace(coalesce(business_name, ''), '\s+', ' ', 'g')))"


@query(f"""
    SELECT lead_id FROM audited_leads
    WHERE ({_NAME} = '' OR {_NAME} NOT IN (SELECT {_NAME} FROM outreach_status)) AND (lower(trim(coalesce(email, ''))) = '' OR lower(trim(coalesce(email, ''))) NOT IN (SELECT lower(trim(coalesce(email, ''))) FROM outreach_status))
""")
def contacted_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that were contacted under neither of their identity and their name."""
    keys = lambda name, *more: table(spark, sf_dir, name).select(*more, T.norm_name(F.col("business_name")).alias("n"), F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("e"))
    return I.without(keys("audited_leads", "lead_id"), keys("outreach_status"), ["n", "e"]).select("lead_id")


@query("""
    SELECT lead_id FROM audited_leads WHERE input_id IS NULL OR input_id = '' OR input_id NOT IN (SELECT input_id FROM audited_leads WHERE audit_status = 'OK' AND input_id IS NOT NULL)
""")
def resume_ids_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads whose id has not been processed yet."""
    rows = table(spark, sf_dir, "audited_leads").select("lead_id", "input_id", "audit_status")
    return I.without(rows, rows.filter("audit_status = 'OK'").select("input_id"), ["input_id"]).select("lead_id")


@query("""
    SELECT sheet_id, business_name, phone, email, priority, NULL::INTEGER AS i_d, NULL::INTEGER AS batch_no FROM call_sheet
    UNION ALL SELECT NULL, business_name, phone, email, priority, i_d, batch_no FROM permanent_leads
""")
def outer_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables under all columns of either."""
    a = table(spark, sf_dir, "call_sheet").select("sheet_id", "business_name", "phone", "email", "priority")
    return a.unionByName(table(spark, sf_dir, "permanent_leads").select("i_d", "batch_no", "business_name", "phone", "email", "priority"), allowMissingColumns=True)


@query("""
    SELECT CAST(coalesce(max(sheet_id), 0) + 1 AS BIGINT) AS first_empty FROM call_sheet
    WHERE trim(coalesce(business_name, '')) <> '' OR trim(coalesce(website, '')) <> '' OR trim(coalesce(phone, '')) <> '' OR trim(coalesce(email, '')) <> ''
""")
def first_empty_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row behind the last that is a lead: one with something in any of four columns."""
    some = F.concat(*[F.trim(F.coalesce(c, F.lit(""))) for c in ("business_name", "website", "phone", "email")]) != ""
    return table(spark, sf_dir, "call_sheet").filter(some).agg((F.coalesce(F.max("sheet_id"), F.lit(0)) + 1).cast("bigint").alias("first_empty"))


@query("SELECT sheet_id, CASE upper(trim(priority)) WHEN 'HOT' THEN 0 WHEN 'WARM' THEN 1 WHEN 'COLD' THEN 2 ELSE 3 END AS place FROM call_sheet ORDER BY place, sheet_id")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet from hot to cold, all else last; ties stay in order."""
    return table(spark, sf_dir, "call_sheet").select("sheet_id", T.priority_rank(F.col("priority")).alias("place")).orderBy("place", "sheet_id")


@query("SELECT lead_id, business_name FROM audited_leads ORDER BY lead_id LIMIT 50")
def first_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first rows in order."""
    return table(spark, sf_dir, "audited_leads").select("lead_id", "business_name").orderBy("lead_id").limit(50)


@query(f"""
    WITH r AS (SELECT i_d, {_PLAIN.format(c="phone")} AS p FROM permanent_leads), w AS (SELECT i_d, p, row_number() OVER (PARTITION BY p ORDER BY i_d) AS n FROM r)
    SELECT i_d FROM w WHERE p = '' OR n = 1
""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each phone; rows without one all stay."""
    return I.first_by_keys(table(spark, sf_dir, "permanent_leads").select("i_d", C.phone_plain(F.col("phone")).alias("p")), ["p"], "i_d").select("i_d")


@query("""
    SELECT sheet_id, CAST((SELECT coalesce(max(i_d), 0) FROM permanent_leads) + row_number() OVER (ORDER BY sheet_id) AS INTEGER) AS i_d FROM call_sheet
""")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.next_ids(table(spark, sf_dir, "call_sheet").select("sheet_id"), table(spark, sf_dir, "permanent_leads").select("i_d"), "i_d", "sheet_id")


@query("""
    WITH old AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS cid, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS added FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
         new AS (SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS cid, CAST(o_orderdate AS DATE) AS seen FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
         last AS (SELECT cid, arg_max(status, row_id) AS status, arg_max(added, row_id) AS added FROM old GROUP BY 1),
         allrows AS (SELECT 0 AS n, row_id, cid, status, added FROM old UNION ALL SELECT 1, row_id, new.cid, last.status, coalesce(last.added, DATE '2000-01-01') FROM new LEFT JOIN last USING (cid)),
         w AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, row_id DESC) AS r FROM allrows)
    SELECT row_id, cid, status, CAST(added AS VARCHAR) AS added_at FROM w WHERE r = 1
""")
def master_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer rows take over the manual status and the first date of the last older row with their key, which they replace."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("cid"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("added_at"))
    old, new = orders.filter("added_at < '1996-01-01'"), orders.filter("added_at >= '1996-01-01'").select("row_id", "cid")
    return I.upsert(old, new, ["cid"], "row_id", ["status"], "added_at", F.lit("2000-01-01")).select("row_id", "cid", "status", "added_at")


@query()
def sheet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy de-duplication of the sheet by website, phone and e-mail tokens, else the name. Only kept rows count, which SQL can't say;
    tests hold it against the plain loop."""
    rows = table(spark, sf_dir, "call_sheet")
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c))
    own = F.filter(F.array(tagged("w:", U.sheet_domain_key(F.col("website"))), tagged("p:", C.phone_last8(F.col("phone"))), tagged("e:", F.lower(F.trim(F.coalesce("email", F.lit("")))))), lambda t: t.isNotNull())
    tokens = F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(tagged("n:", T.norm_name(F.col("business_name")))), lambda t: t.isNotNull()))
    return I.greedy_distinct(rows.select("sheet_id", tokens.alias("tokens")), "tokens", "sheet_id").select("sheet_id")


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events),
         r AS (SELECT user_id, event_type, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2
""")
def run_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_id", "event_type", "user_id")
    return found.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""
    SELECT l.lead_id, l.website, p.i_d IS NOT NULL AS in_ledger FROM (SELECT lead_id, website, lower(trim(email)) AS e FROM audited_leads) l
    LEFT JOIN (SELECT lower(trim(email)) AS e, min(i_d) AS i_d FROM permanent_leads WHERE trim(email) <> '' GROUP BY 1) p ON l.e = p.e
""")
def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "permanent_leads").filter("trim(email) <> ''").groupBy(F.lower(F.trim("email")).alias("e")).agg(F.min("i_d").alias("i_d"))
    leads = table(spark, sf_dir, "audited_leads").select("lead_id", "website", F.lower(F.trim("email")).alias("e"))
    return leads.join(first, "e", "left").select("lead_id", "website", F.col("i_d").isNotNull().alias("in_ledger"))
