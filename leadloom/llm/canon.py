"""Free-entered values to the entry of a reference list they mean: prefix-filter set-similarity join.

Values become multisets of letters and padded letter pairs of their words, so that typing errors and the order of words cost
little. All tokens of both sides are ordered by how rare they are over all values; two sets of a Jaccard similarity of at least
``LEAST`` must share a token within their rarest few, so only those prefixes are joined. Length and positional filters drop most
candidates, the rest are verified exactly, the most similar entry is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.text import folded, let
from leadloom.shared import cut_lineage

#: The least similarity of a match.
LEAST = 0.5

#: Abbreviations written out (word -> word).
SHORT = {
    "contr": "contractor", "svc": "service", "svcs": "services", "serv": "service", "co": "company", "elec": "electrical", "maint": "maintenance",
    "inst": "installer", "eng": "engineer", "rep": "repair", "repr": "repair", "install": "installation", "bath": "bathroom", "clean": "cleaning",
}
BEFORE = "the|local|best|top|cheap|trusted|emergency|residential|commercial|24h|24 7|24"
AFTER = "near me|nearby|only|metro|remote|nationwide|all|local"
KINDS = "company|companies|firm|firms|service|services|contractor|contractors|specialist|specialists|shop|shops|business"


def _light(c: Column) -> Column:
    """The value without case, marks, remarks, places and praise, abbreviations written out."""
    c = F.regexp_replace(folded(c), "&(?:amp;)?", "and")
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    c = F.regexp_replace(c, r"(?<=\b[a-z])\.+(?=[a-z]\b)", "")
    c = F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", " "))
    c = F.regexp_replace(c, r"(?<=\S) in [\p{L} ]+$", "")
    words = F.transform(F.split(c, " "), lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv]), w), w))
    c = F.array_join(words, " ")
    c = F.regexp_replace(c, rf"^(?:(?:{BEFORE}) )+(?=.)", "")
    return F.regexp_replace(c, rf"(?<=\S)(?: (?:{AFTER}))+$", "")


def _bare(c: Column) -> Column:
    """The light form without words for any kind of firm."""
    c = F.regexp_replace(c, rf"(?<=\S)(?: (?:{KINDS}))+$", "")
    return F.regexp_replace(c, rf"^(?:(?:{KINDS}) )+(?=.)", "")


def _tokens(c: Column) -> Column:
    """Letters and padded pairs of all words, each with its count so far, so that sets of them behave as multisets."""
    padded = F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    parts = F.flatten(F.transform(padded, lambda w: F.concat(
        F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))),
        F.transform(F.sequence(F.lit(2), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(1))),
    )))
    return let(F.sort_array(parts), lambda ordered: F.transform(ordered, lambda t, i: F.concat(t, F.lit("#"), (i - F.array_position(ordered, t) + 2).cast("string"))))


def _forms(df: DataFrame, value: str) -> DataFrame:
    """A row for the light and one for the bare form of each value, if they differ: form number and tokens."""
    light = _light(F.col(value))
    df = df.withColumn("light", light).withColumn("form", F.explode(F.array_distinct(F.array("light", _bare(F.col("light"))))))
    return df.drop("light").withColumn("tokens", _tokens(F.col("form"))).withColumn("n", F.size("tokens")).filter("n > 0")


def _prefixes(forms: DataFrame, counts: DataFrame, key: list[str], least: float) -> DataFrame:
    """(key, n, position, token): the rarest tokens of each form, of which a similar form must share one."""
    ordered = (
        forms.select(*key, "form", "n", F.explode("tokens").alias("token")).join(counts, ["kind", "token"])
        .groupBy(*key, "form", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    )
    length = F.col("n") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1
    return ordered.select(*key, "form", "n", F.posexplode(F.slice("tokens", F.lit(1), length)).alias("at", "t")).select(*key, "form", "n", "at", F.col("t.token").alias("token"))


def match_values(typed: DataFrame, canon: DataFrame, least: float = LEAST) -> DataFrame:
    """(kind, value, canon_id, similarity): for each distinct value of each kind the entry it means, where there is one.

    typed: kind, value. canon: kind, canon_id, name, one row per name of an entry. Ties go to the smaller canon_id. Null values
    and values without letters or digits match nothing, and so does every value of a kind the list lacks. Repeated values are
    matched once. Empty tables give an empty result.
    """
    values = typed.filter("kind is not null and value is not null").select("kind", "value").distinct()
    left = cut_lineage(_forms(values, "value"))  # read three times; distinct values only
    right = cut_lineage(_forms(canon.filter("name is not null").select("kind", "canon_id", "name").distinct(), "name").select("kind", "canon_id", "form", "tokens", "n").dropDuplicates(["kind", "canon_id", "form"]))
    counts = (
        left.select("kind", F.explode("tokens").alias("token")).unionByName(right.select("kind", F.explode("tokens").alias("token")))
        .groupBy("kind", "token").agg(F.count("*").alias("df"))
    )
    a = _prefixes(left, counts, ["kind", "value"], least).alias("a")
    b = _prefixes(right, counts, ["kind", "canon_id"], least).alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    needed = F.ceil(F.lit(least / (1 + least)) * (n + m))
    pairs = (
        a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.token") == F.col("b.token"))
               & (n >= F.lit(least) * m) & (m >= F.lit(least) * n)
               & (1 + F.least(n - 1 - F.col("a.at"), m - 1 - F.col("b.at")) >= needed))
        .select(F.col("a.kind").alias("kind"), "value", F.col("a.form").alias("form"), "canon_id", F.col("b.form").alias("name_form"), n.alias("n"), m.alias("m")).distinct()
    )
    common = F.size(F.array_intersect("x", "y"))
    checked = (
        pairs.join(left.select("kind", "value", "form", F.col("tokens").alias("x")), ["kind", "value", "form"])
        .join(right.select("kind", "canon_id", F.col("form").alias("name_form"), F.col("tokens").alias("y")), ["kind", "canon_id", "name_form"])
        .select("kind", "value", "canon_id", "n", "m", common.alias("common"))
    )
    checked = checked.select("kind", "value", "canon_id", (F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("similarity")).filter(F.col("similarity") >= least)
    best = F.max(F.struct(F.col("similarity"), (-F.col("canon_id")).alias("minus"))).alias("best")
    return checked.groupBy("kind", "value").agg(best).select("kind", "value", (-F.col("best.minus")).alias("canon_id"), F.col("best.similarity").alias("similarity"))


def map_values(typed: DataFrame, canon: DataFrame, least: float = LEAST) -> DataFrame:
    """typed's rows (with all its columns) and canon_id, 0 where the list has no entry, and similarity, null there.

    Null and blank values have no rows; repeated rows stay. Values that many rows share are matched once; joining the result
    back may meet a value that a third of the rows hold, which adaptive execution splits.
    """
    typed = typed.filter(F.trim("value") != "")
    # A value is matched trimmed: differences in outer blanks cost nothing.
    typed = typed.withColumn("value", F.trim("value"))
    found = match_values(typed, canon, least)
    return typed.join(found, ["kind", "value"], "left").withColumn("canon_id", F.coalesce("canon_id", F.lit(0)))


def canon_names(canon_list: DataFrame) -> DataFrame:
    """(kind, canon_id, name): names, other names and country codes, one per row."""
    names = F.concat(F.array("canon_name"), F.coalesce("alt_names", F.array().cast("array<string>")), F.array("iso2", "iso3"))
    return canon_list.select("kind", "canon_id", F.explode(names).alias("name")).filter("name is not null and trim(name) <> ''")
