"""Queries of predicates, scores and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import audit as A
from leadloom.functions import text as T
from leadloom.operators.criteria import lead_score
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


_SCORE = """CAST(least({neg}, 3) * 20 + CASE WHEN {n} BETWEEN 1 AND 50 THEN 25 WHEN {n} BETWEEN 51 AND 100 THEN 15 WHEN {n} BETWEEN 101 AND 200 THEN 5 ELSE 0 END
    + CASE WHEN {r} > 0 AND {r} < 4.5 THEN 15 WHEN {r} > 0 AND {r} < 4.8 THEN 10 ELSE 0 END AS INTEGER)"""


@query(f"""
    WITH l AS (SELECT c_custkey, CAST(count(*) AS BIGINT) AS review_count, CAST(1 + c_custkey % 41 AS DOUBLE) / 10 + 1 AS review_rating, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS neg
               FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
         s AS (SELECT c_custkey, review_count, review_rating, {_SCORE.format(neg="neg", n="review_count", r="review_rating")} AS lead_score FROM l WHERE review_rating >= 3.0 AND review_count >= 5)
    SELECT * FROM s ORDER BY lead_score DESC, review_count ASC NULLS LAST, c_custkey LIMIT 25
""")
def lead_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the capped list of the warmest leads (a TakeOrderedAndProject)."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("review_count"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("neg"))
    leads = orders.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").withColumn("review_rating", (F.col("c_custkey") % 41 + 1).cast("double") / 10 + 1)
    scored = leads.filter("review_rating >= 3.0 and review_count >= 5").withColumn("lead_score", lead_score(F.col("neg"), F.col("review_count"), F.col("review_rating")))
    return scored.select("c_custkey", "review_count", "review_rating", "lead_score").orderBy(F.desc("lead_score"), F.asc_nulls_last("review_count"), "c_custkey").limit(25)


_NUM = "coalesce(try_cast(replace(trim({c}), ',', '') AS DOUBLE), 0)"


@query(f"""
    SELECT lead_id FROM audited_leads WHERE {_NUM.format(c="rating")} >= 3.5 AND {_NUM.format(c="review_count")} >= 20
""")
def rating_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.coalesce(T.number(F.col("rating")), F.lit(0)) >= 3.5) & (F.coalesce(T.number(F.col("review_count")), F.lit(0)) >= 20)
    return table(spark, sf_dir, "audited_leads").filter(ok).select("lead_id")


@query(f"""
    SELECT lead_id FROM audited_leads WHERE lower(trim(coalesce(phone, ''))) NOT IN {T.EMPTY} AND lower(trim(coalesce(email, ''))) IN {T.EMPTY}
""")
def contact_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'yes' for the phone: it must be there; 'no' for the e-mail: it must not."""
    return table(spark, sf_dir, "audited_leads").filter(T.has_value(F.col("phone")) & ~T.has_value(F.col("email"))).select("lead_id")


ALLOWED = ("plumber", "electrician", "roof builder", "heating engineer")


@query(f"""
    WITH t AS (SELECT lead_id, lower(trim(coalesce(category, ''))) AS c FROM audited_leads),
         p AS (SELECT lead_id, unnest(list_concat(list_concat([c], regexp_split_to_array(c, '[,;]')), regexp_split_to_array(c, '[,;/]'))) AS x FROM t)
    SELECT DISTINCT lead_id FROM p WHERE trim(x) IN {ALLOWED}
""")
def category_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").filter(F.arrays_overlap(T.category_tokens(F.col("category")), F.array(*map(F.lit, ALLOWED)))).select("lead_id")


@query(rf"""
    SELECT lead_id FROM audited_leads
    WHERE NOT regexp_matches(lower(coalesce(business_name, '') || ' ' || coalesce(category, '')), '(^|[^a-z0-9_])(gym|salon|pilates|fight hall)([^a-z0-9_]|$)')
""")
def exclude_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws(" ", F.coalesce("business_name", F.lit("")), F.coalesce("category", F.lit("")))
    return table(spark, sf_dir, "audited_leads").filter(~T.has_word(said, ["gym", "salon", "pilates", "fight hall"])).select("lead_id")


@query("""
    WITH n AS (SELECT try_cast(replace(trim(rating), ',', '') AS DOUBLE) AS r, coalesce(CAST(floor(try_cast(replace(trim(review_count), ',', '') AS DOUBLE)) AS INTEGER), 0) AS n FROM audited_leads)
    SELECT CASE WHEN r IS NULL OR isnan(r) OR n <= 0 THEN 'none' WHEN r >= 4.5 THEN 'good' WHEN r >= 3.5 THEN 'average' ELSE 'poor' END AS label, CAST(count(*) AS BIGINT) AS leads FROM n GROUP BY 1
""")
def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = T.quality_label(T.number(F.col("rating")), T.whole(F.col("review_count")))
    return table(spark, sf_dir, "audited_leads").groupBy(label.alias("label")).agg(F.count("*").alias("leads"))


def _first_sign(text: str, signs) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{s}') THEN '{s}'" for s in signs) + " END"


def _any_sign(text: str, signs) -> str:
    return "(" + " OR ".join(f"contains({text}, '{s}')" for s in signs) + ")"


@query(f"SELECT doc_id, {_first_sign("lower(' ' || left(coalesce(text, ''), 2000))", A.BLOCK_SIGNS)} AS sign FROM documents")
def block_page_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs count within the first 2000 characters: that prefix is the detector's rule, not a cap."""
    return table(spark, sf_dir, "documents").select("doc_id", A.block_sign(F.lit(None).cast("string"), F.col("text")).alias("sign"))


@query(f"SELECT doc_id, {_first_sign("lower(left(coalesce(text, ''), 20000))", A.CHALLENGE_SIGNS)} AS sign FROM documents")
def challenge_page_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs count within the first 20000 characters: that prefix is the detector's rule, not a cap."""
    return table(spark, sf_dir, "documents").select("doc_id", A.challenge_sign(F.col("text")).alias("sign"))


@query(f"""
    WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
    SELECT doc_id, {_any_sign("t", A.WHATSAPP_SIGNS)} AS whatsapp, {_any_sign("t", A.BOOKING_SIGNS)} AS booking, regexp_matches(t, '(^|[^a-z])({"|".join(A.TRUST_SIGNS)})([^a-z]|$)') AS trust FROM t
""")
def page_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", A.has_sign(t, A.WHATSAPP_SIGNS).alias("whatsapp"), A.has_sign(t, A.BOOKING_SIGNS).alias("booking"), t.rlike(A.TRUST).alias("trust"))


FLAGS = ("has_chatbot", "has_whatsapp", "has_lead_form", "has_phone_cta", "has_appointment_booking", "has_trust_signals", "has_local_schema")


@query("SELECT flag, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS yes, CAST(count(*) FILTER (WHERE NOT v) AS BIGINT) AS no, CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS unknown FROM ("
       + " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS v FROM audited_leads" for f in FLAGS) + ") GROUP BY 1")
def feature_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by value: a gap is a false one, an unknown isn't. One pass, the flags unpivoted after a partial count."""
    counts = [F.struct(F.lit(f).alias("flag"), F.count_if(F.col(f)).alias("yes"), F.count_if(~F.col(f)).alias("no"), F.count_if(F.col(f).isNull()).alias("unknown")) for f in FLAGS]
    return table(spark, sf_dir, "audited_leads").agg(F.array(*counts).alias("all")).select(F.inline("all"))


@query("""
    WITH r AS (SELECT l_orderkey AS page, l_returnflag AS form, l_linenumber AS run, l_discount * 1000 AS perf FROM lineitem),
         m AS (SELECT page, form, median(perf) AS med FROM r GROUP BY 1, 2),
         d AS (SELECT page, form, run, round(perf, 4) AS perf, round(med, 4) AS med, row_number() OVER (PARTITION BY page, form ORDER BY round(abs(perf - med), 6), run) AS rn FROM r JOIN m USING (page, form))
    SELECT page, form, med AS median_score, run AS representative_run FROM d WHERE rn = 1
""")
def lighthouse_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over runs, and the run nearest to it, the first on a tie."""
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("form"), F.col("l_linenumber").alias("run"), (F.col("l_discount") * 1000).alias("perf"))
    grouped = runs.groupBy("page", "form").agg(F.median("perf").alias("med"), F.collect_list(F.struct("run", "perf")).alias("all"))  # a page has a handful of runs
    nearest = F.array_min(F.transform("all", lambda x: F.struct(F.round(F.abs(x["perf"] - F.col("med")), 6).alias("d"), x["run"].alias("run"))))["run"]
    return grouped.select("page", "form", F.round("med", 4).alias("median_score"), nearest.alias("representative_run"))


@query("""
    SELECT user_id, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE status >= 400 AND status NOT IN (403, 429)) AS BIGINT) AS broken,
           CAST(count(*) FILTER (WHERE status = 403) AS BIGINT) AS forbidden, CAST(count(*) FILTER (WHERE status = 429) AS BIGINT) AS limited
    FROM (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 429 ELSE 200 END AS status FROM events) GROUP BY 1
""")
def link_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, 404).when(k == 1, 403).when(k == 2, 429).otherwise(200)
    links = table(spark, sf_dir, "events").select("user_id", status.alias("s"))
    broken = (F.col("s") >= 400) & ~F.col("s").isin(403, 429)
    return links.groupBy("user_id").agg(F.count("*").alias("checked"), F.count_if(broken).alias("broken"), F.count_if(F.col("s") == 403).alias("forbidden"), F.count_if(F.col("s") == 429).alias("limited"))


@query("""
    SELECT audit_status, review_type, CAST(count(*) AS BIGINT) AS leads, CAST(count(*) FILTER (WHERE critical_issue_count > 0) AS BIGINT) AS critical,
           round(avg(health_score), 6) AS mean_health, CAST(max(lead_priority) AS INTEGER) AS top_priority FROM audited_leads GROUP BY 1, 2
""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audited_leads").groupBy("audit_status", "review_type").agg(
        F.count("*").alias("leads"), F.count_if(F.col("critical_issue_count") > 0).alias("critical"), F.round(F.avg("health_score"), 6).alias("mean_health"), F.max("lead_priority").alias("top_priority")
    )


@query()
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every document read as a page; a tolerant HTML parse has no SQL, tests check it on written pages."""
    from leadloom.functions import page as P

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("html")).withColumn("f", P.page_facts("html"))
    return docs.select("doc_id", F.length("f.text").alias("text_chars"), "f.h1_count", "f.structural_tags", F.size("f.hrefs").alias("links"), F.size(P.lead_forms(F.col("f.forms"))).alias("forms"), P.mixed_content(F.coalesce("html", F.lit(""))).alias("mixed"), P.js_shell(F.coalesce("html", F.lit("")), F.col("f")).alias("shell"))
