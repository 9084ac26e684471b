"""What is compared to tell whether two records are one business: name, phone, website, e-mail in keyed form.

A chain's branches are businesses of their own with lines of their own; a line or a platform's page may be shared; one detail
may change. So hosts are told apart, over all records, into those of one business, of a chain (several lines under one name)
and of a platform (many names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.text import folded, in_array, pinned

#: Calling codes that are cut from international numbers (fixed values).
CODES = "971|966|974|965|973|968|44|61|65|91|82|81|60|94|49|33|34|39|1"
#: Legal forms, articles and joining words, no part of a name.
IDLE = (
    "the", "and", "of", "a", "ltd", "limited", "llc", "llp", "lllp", "inc", "incorporated", "corp", "co", "company", "pty", "pvt", "private", "pte", "plc", "gmbh", "fze", "fzc", "fzco", "fz", "wll", "ood", "sarl",
)
#: Praise that directories let owners put behind names and a bar.
PRAISE = r"\b(?:official(?: site)?|open now|open 24 ?7|best in town|free quotes?|no call ?-?out fee|24[ /]?7|est \d{4}|since \d{4}|top rated|now hiring|near me)\b"
#: Local parts of shared mailboxes.
SHARED_BOX = r"^(?:info|hello|office|team|support|contact|enquiries|enquiry|admin|service|services|bookings?|sales|billing|jobs|mail|hi|reception|accounts)\d*@"
#: Shares that tell kinds of words and hosts, whatever the number of rows. A value counts as a spelling of a host's commonest if it
#: has under SPELLING of that one's rows.
SPELLING = 1 / 16
#: A host is a chain's from so many lines on; a platform from so many names on, besides its commonest, if these hold at least
#: PLATFORM_REST of its rows and are at least PLATFORM_SHARE of its lines.
CHAIN_LINES, PLATFORM_NAMES, PLATFORM_REST, PLATFORM_SHARE = 3, 9, 0.15, 0.5
#: A word is common, no mark of a single business, if it has WORD_ROWS rows or more and, besides its most frequent host, at least
#: WORD_REST of its rows, of as many hosts as WORD_HOSTS equally frequent ones would be.
WORD_ROWS, WORD_REST, WORD_HOSTS = 6, 0.05, 5
#: Up to so many common words are looked up in each row; more are joined.
LISTED_WORDS = 20_000


#: Keys are made in steps, each a projection of its own that uses the one before several times: in one expression every use would
#: be evaluated again.
PHONE_STEPS = (
    lambda c: F.lower(F.trim(c)),
    lambda c: F.when(c.contains("x") | c.contains("(0)"), F.regexp_replace(c, r"\s*(?:\bext(?:ension|n)?\.?|\bx)\s*\d+\s*$|\(0\)", "")).otherwise(c),
    # a number that went through a spreadsheet is an international one
    lambda c: F.when(c.endswith(".0") & c.rlike(r"^'?\+?\d+\.0$"), F.concat(F.lit("+"), F.left(c, F.length(c) - 2))).otherwise(c),
    lambda c: F.concat(F.when(c.contains("+"), "+").otherwise(""), F.regexp_replace(c, r"\D+", "")),
    lambda c: F.when(c.startswith("+") | c.startswith("00"), F.regexp_replace(F.ltrim(c, F.lit("+0")), f"^(?:{CODES})(?=\\d{{7}})", "")).otherwise(c),
    lambda c: F.ltrim(c, F.lit("0")),
    lambda c: F.when(F.length(c).between(7, 13), c),
)


def emails_of(c: Column) -> Column:
    """All addresses in a cell, lower case, without plus tags."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9._%+'-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"), 1)
    return F.array_distinct(F.transform(found, lambda e: F.when(e.contains("+"), F.regexp_replace(e, r"\+[^@]*@", "@")).otherwise(e)))


def host_of(c: Column) -> Column:
    """The host of an address without www and m, null if there is none."""
    host = F.regexp_extract(F.lower(c), r"((?:[a-z0-9-]+\.)+[a-z]{2,})(?=[/:?#\"\s]|$)", 1)
    return F.nullif(F.regexp_replace(host, r"^(?:www\.|m\.)+", ""), F.lit(""))


NAME_STEPS = (
    lambda c: F.lower(F.coalesce(c, F.lit(""))),
    lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), folded(c)).otherwise(c),
    lambda c: F.when(c.contains("&"), F.replace(F.replace(c, F.lit("&amp;"), F.lit(" and ")), F.lit("&"), F.lit(" and "))).otherwise(c),
    lambda c: F.when(c.contains("."), F.regexp_replace(c, r"(?<=\b[a-z])\.(?=[a-z]\b)", "")).otherwise(c),
    lambda c: F.when(c.contains("|"), F.regexp_replace(F.regexp_replace(c, "[-.]", " "), PRAISE, " ")).otherwise(c),
    lambda c: F.split(F.translate(c, "'’`", ""), r"[^a-z0-9\P{ASCII}]+|[^\p{L}\p{N}]+"),
    lambda c: F.sort_array(F.array_except(c, F.array(*[F.lit(w) for w in ("", *IDLE)]))),
)


def in_steps(df: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """The columns, each put through its steps one after the other."""
    for k in range(max(map(len, columns.values()))):
        df = df.withColumns({c: steps[k](F.col(c)) for c, steps in columns.items() if k < len(steps)})
    return df


def phone_key(df: DataFrame, *columns: str) -> DataFrame:
    """National digits: no extension, trunk zero or calling code; null if there aren't 7 to 13 digits."""
    return in_steps(df, dict.fromkeys(columns, PHONE_STEPS))


def name_words(df: DataFrame, column: str) -> DataFrame:
    """Words of a name without marks, legal forms and praise, as a sorted set."""
    return in_steps(df, {column: NAME_STEPS})


def prepare(df: DataFrame, key: str, name: str, phones: list[str], website: str, email: str) -> DataFrame:
    """(id, words, phones, web, mails, mail_host) of each row."""
    lines = [f"p{k}" for k in range(len(phones))]
    raw = df.select(F.col(key).alias("id"), F.col(name).alias("n"), F.col(website).alias("u"), F.col(email).alias("e"), *[F.col(p).alias(c) for p, c in zip(phones, lines, strict=True)])
    out = in_steps(raw, {"n": NAME_STEPS, "u": (host_of,), "e": (emails_of,), **dict.fromkeys(lines, PHONE_STEPS)})
    # A generator between, or filters on the keys would be pushed below and evaluate them again.
    out = pinned(out, {"words": F.col("n"), "web": F.col("u"), "mails": F.col("e"), **{c: F.col(c) for c in lines}})
    found = F.array_compact(F.array(*lines))
    found = F.sort_array(F.array_distinct(found)) if len(lines) > 1 else found
    return out.select("id", "words", found.alias("phones"), "web", "mails", F.substring_index(F.try_element_at("mails", F.lit(1)), "@", -1).alias("mail_host"))


def word_counts(records: DataFrame, *kept: str) -> DataFrame:
    """(w, host, n, and the columns kept): rows by word and host, additive over batches; records without a host aren't counted. Hosts that begin alike, as
    mistyped ones mostly do, are one."""
    host = F.xxhash64(F.left(_label(F.coalesce("web", "mail_host")), F.lit(4)))
    return records.filter("web is not null or mail_host is not null").select(F.explode("words").alias("w"), host.alias("host"), *kept).groupBy("w", "host", *kept).agg(F.count("*").alias("n")).select("w", "host", "n", *kept)


def common_words(counts: DataFrame) -> DataFrame:
    """(w): the common words by word_counts (rows of one word and host may be several). A brand has its own host and a few of
    platforms, however often it is repeated; a word of many businesses has many hosts besides that of one much repeated."""
    per = counts.groupBy("w", "host").agg(F.sum("n").cast("double").alias("n"))
    per = per.groupBy("w").agg(F.sum("n").alias("rows"), F.max("n").alias("top"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    rest, squares = F.col("rows") - F.col("top"), F.col("squares") - F.col("top") * F.col("top")
    return per.filter((F.col("rows") >= WORD_ROWS) & (rest >= WORD_REST * F.col("rows")) & (rest * rest >= WORD_HOSTS * squares)).select("w")


def _running(df: DataFrame, keys: list[str], columns: dict) -> DataFrame:
    """The columns over all rows of the same keys up to each row's batch."""
    upto = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[c.over(upto).alias(n) for n, c in columns.items()])


def _spans(df: DataFrame, key: str) -> DataFrame:
    """Adds since and until: what a row says of its key holds for the batches from its own to before the key's next row."""
    return df.withColumns({"since": F.col("batch"), "until": F.coalesce(F.lead("batch").over(Window.partitionBy(key).orderBy("batch")) - 1, F.lit(2**31 - 1).cast("int"))}).drop("batch")


def common_words_by_batch(counts: DataFrame) -> DataFrame:
    """(w, since, until): common_words of all batches up to each, from counts with batch. Only where counts change they are looked at."""
    per = counts.groupBy("w", "host", "batch").agg(F.sum("n").cast("double").alias("n"))
    per = _running(per, ["w", "host"], {"all": F.sum("n")})
    step = per.groupBy("w", "batch").agg(F.sum("n").alias("n"), F.max("all").alias("most"), F.sum(F.col("all") * F.col("all") - (F.col("all") - F.col("n")) * (F.col("all") - F.col("n"))).alias("more"))
    seen = _spans(_running(step, ["w"], {"rows": F.sum("n"), "top": F.max("most"), "squares": F.sum("more")}), "w")
    rest, squares = F.col("rows") - F.col("top"), F.col("squares") - F.col("top") * F.col("top")
    return seen.filter((F.col("rows") >= WORD_ROWS) & (rest >= WORD_REST * F.col("rows")) & (rest * rest >= WORD_HOSTS * squares)).select("w", "since", "until")


def classify_by_batch(records: DataFrame, common: DataFrame, listed: int = LISTED_WORDS) -> DataFrame:
    """classify, each record by the words common at its batch (common_words_by_batch)."""
    few = common.limit(listed + 1).collect()  # a vocabulary, not rows; beyond ``listed`` words it is joined
    if len(few) <= listed:
        forever = max((r.until for r in few), default=0)
        first = min((r.since for r in few), default=0)
        always = sorted(r.w for r in few if r.since == first and r.until == forever)
        others = [r for r in few if not (r.since == first and r.until == forever)]
        without = lambda c, some: F.filter(c, lambda w: ~w.isin(*some))
        own = F.when(F.col("batch") >= first, without("words", always)).otherwise(F.col("words")) if always else F.col("words")
        turns = sorted({r.since for r in others} | {r.until + 1 for r in others})  # from each on the same words are common up to the next
        stem = None
        for lo, hi in zip(turns, turns[1:], strict=False):
            if now := sorted(r.w for r in others if r.since <= lo and r.until >= hi - 1):
                stem = (F.when if stem is None else stem.when)(F.col("batch").between(lo, hi - 1), without("stem", now))
        records = records.withColumn("stem", own)
        return records if stem is None else records.withColumn("stem", stem.otherwise(F.col("stem")))
    # A word has several spans, of which at most one holds.
    own = records.select("id", "batch", F.explode("words").alias("w")).join(common.withColumnRenamed("w", "_w"), (F.col("w") == F.col("_w")) & F.col("batch").between(F.col("since"), F.col("until")), "left_anti")
    own = own.groupBy("id", "batch").agg(F.array_sort(F.collect_list("w")).alias("stem"))
    return records.join(own, ["id", "batch"], "left").withColumn("stem", F.coalesce("stem", F.array().cast("array<string>")))


def classify(records: DataFrame, common: DataFrame, listed: int = LISTED_WORDS) -> DataFrame:
    """Adds stem (words of its own, not common ones) to records with unique ids."""
    few = [r.w for r in common.limit(listed + 1).collect()]  # a vocabulary, not rows; beyond ``listed`` words it is joined
    if len(few) <= listed:
        return records.withColumn("stem", F.filter("words", lambda w: ~w.isin(*sorted(few))) if few else F.col("words"))
    keys = [c for c in ("side", "id") if c in records.columns]
    own = records.select(*keys, F.explode("words").alias("w")).join(common, "w", "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("w")).alias("stem"))
    return records.join(own, keys, "left").withColumn("stem", F.coalesce("stem", F.array().cast("array<string>")))


def host_counts(records: DataFrame, *kept: str) -> DataFrame:
    """(host, what, value, n, and the columns kept): rows by host and name (what 0) or line (what 1), as hashes, additive over batches."""
    mail = F.when(~F.col("mail_host").eqNullSafe(F.col("web")), F.col("mail_host"))
    line = F.xxhash64(F.try_element_at("phones", F.lit(1)))
    pairs = [F.struct(h.alias("host"), F.lit(w).alias("what"), v.alias("value")) for h in (F.col("web"), mail) for w, v in ((0, F.xxhash64("stem")), (1, F.when(F.size("phones") > 0, line)))]
    return records.select(F.explode(F.array(*pairs)).alias("x"), *kept).select("x.*", *kept).filter("host is not null and value is not null").groupBy("host", "what", "value", *kept).agg(F.count("*").alias("n")).select("host", "what", "value", "n", *kept)


def host_kinds(counts: DataFrame) -> DataFrame:
    """(host, kind) of the platforms and chains by host_counts. Only counts of counts are gathered by host, so no host, however
    hot, makes a large group."""
    per = counts.groupBy("host", "what", "value").agg(F.sum("n").alias("n"))
    power = F.floor(F.log2("n")).cast("int")
    per = per.groupBy("host", "what", power.alias("power")).agg(F.count("*").alias("values"), F.max("n").cast("double").alias("top"), F.sum("n").cast("double").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    per = per.groupBy("host", "what").agg(F.max("top").alias("top"), F.sum("rows").alias("rows"), F.sum("squares").alias("squares"), F.collect_list(F.struct("power", "values")).alias("by"))  # at most 63 each
    per = per.withColumn("real", F.aggregate("by", F.lit(0).cast("bigint"), lambda t, x: t + F.when(F.pow(F.lit(2.0), x["power"] + 1) > SPELLING * F.col("top"), x["values"]).otherwise(0)))
    rest, squares = F.col("rows") - F.col("top"), F.col("squares") - F.col("top") * F.col("top")
    per = per.withColumn("others", F.when(rest >= PLATFORM_REST * F.col("rows"), rest * rest / F.greatest(squares, F.lit(1.0))).otherwise(0.0))
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    seen = per.groupBy("host").agg(of(0, "others").alias("names"), F.coalesce(of(1, "real"), F.lit(0)).alias("lines"), F.coalesce(of(1, "rows") * of(1, "rows") / of(1, "squares"), F.lit(0.0)).alias("spread"))
    platform = (F.col("names") >= PLATFORM_NAMES) & (F.col("names") >= PLATFORM_SHARE * F.col("spread"))
    kind = F.when(platform, "platform").when(F.col("lines") >= CHAIN_LINES, "chain")
    return seen.select("host", kind.alias("kind")).filter("kind is not null")


def host_kinds_by_batch(counts: DataFrame) -> DataFrame:
    """(host, kind, since, until): host_kinds of all batches up to each, from counts with batch. A host's counts of counts are one array
    by batch, bounded by batches and powers; they are summed up to each batch in which any changes."""
    per = counts.groupBy("host", "what", "value", "batch").agg(F.sum("n").alias("n"))
    per = _running(per, ["host", "what", "value"], {"all": F.sum("n")})
    power = lambda c: F.floor(F.log2(c)).cast("int")
    was = F.col("all") - F.col("n")
    moved = per.select("host", "what", "batch", "n", "all", was.alias("was"), F.explode(F.array(F.struct(power("all").alias("power"), F.lit(1).alias("values")), F.struct(power(F.nullif(was, F.lit(0))).alias("power"), F.lit(-1).alias("values")))).alias("x")).filter("x.power is not null")
    there = F.col("x.values") == 1
    square = F.col("all").cast("double") * F.col("all") - F.col("was").cast("double") * F.col("was")
    step = moved.groupBy("host", "what", "batch", F.col("x.power").alias("power")).agg(
        F.sum("x.values").cast("bigint").alias("values"), F.coalesce(F.max(F.when(there, F.col("all"))), F.lit(0)).cast("double").alias("top"),
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).cast("double").alias("rows"), F.coalesce(F.sum(F.when(there, square)), F.lit(0.0)).alias("squares"),
    )
    steps = step.groupBy("host").agg(F.collect_list(F.struct("what", "batch", "power", "values", "top", "rows", "squares")).alias("steps"))
    now = steps.select("host", "steps", F.explode(F.array_distinct(F.col("steps.batch"))).alias("batch"))
    cols: dict[str, Column] = {}
    total = lambda some, c: F.aggregate(some, F.lit(0).cast("double"), lambda t, x: t + x[c])
    for what in (0, 1):
        now = now.withColumn(f"s{what}", F.expr(f"filter(steps, x -> x.what = {what} and x.batch <= batch)"))
        some = F.col(f"s{what}")
        cols |= {f"top{what}": F.coalesce(F.array_max(F.transform(some, lambda x: x["top"])), F.lit(0.0)), f"rows{what}": total(some, "rows"), f"squares{what}": total(some, "squares")}
    now = now.withColumns(cols)
    rest, squares = F.col("rows0") - F.col("top0"), F.col("squares0") - F.col("top0") * F.col("top0")
    names = F.when(rest >= PLATFORM_REST * F.col("rows0"), rest * rest / F.greatest(squares, F.lit(1.0))).otherwise(0.0)
    lines = F.aggregate("s1", F.lit(0).cast("bigint"), lambda t, x: t + F.when(F.pow(F.lit(2.0), x["power"] + 1) > SPELLING * F.col("top1"), x["values"]).otherwise(0))
    spread = F.coalesce(F.col("rows1") * F.col("rows1") / F.nullif("squares1", F.lit(0.0)), F.lit(0.0))
    seen = now.select("host", "batch", F.when(F.size("s0") > 0, names).alias("names"), lines.alias("lines"), spread.alias("spread"))
    platform = (F.col("names") >= PLATFORM_NAMES) & (F.col("names") >= PLATFORM_SHARE * F.col("spread"))
    kind = F.when(platform, "platform").when(F.col("lines") >= CHAIN_LINES, "chain")
    return _spans(seen.select("host", "batch", kind.alias("kind")), "host").filter("kind is not null")


def with_hosts(records: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds hosts (those that mark a business or chain), chain, own_mails (addresses that mark one business or branch). Kinds with since
    and until are those of each record's batch."""
    # Records without a host are spread over a thousand keys that no host has, not sent to one task.
    spread = lambda c: F.coalesce(F.col(c), F.concat(F.lit("?"), F.pmod(F.xxhash64("id"), F.lit(1000))))
    span = ["since", "until"] if "since" in kinds.columns else []
    holds = F.col("batch").between(F.col("since"), F.col("until")) if span else F.lit(True)
    a = kinds.select(F.col("host").alias("_web"), F.col("kind").alias("web_kind"), *span)
    b = kinds.select(F.col("host").alias("_mail"), F.col("kind").alias("mail_kind"), *span)
    df = records.join(a, (spread("web") == F.col("_web")) & holds, "left").drop("_web", *span)
    df = df.join(b, (spread("mail_host") == F.col("_mail")) & holds, "left").drop("_mail", *span)
    web = F.when(~F.col("web_kind").eqNullSafe("platform"), F.col("web"))
    mail = F.when(~F.col("mail_kind").eqNullSafe("platform"), F.col("mail_host"))
    free = F.col("mail_kind").eqNullSafe("platform")
    chain = F.col("web_kind").eqNullSafe("chain") | F.col("mail_kind").eqNullSafe("chain")
    return df.withColumns({
        "hosts": F.sort_array(F.array_distinct(F.array_compact(F.array(web, mail)))),
        "chain": chain,
        # in a chain a shared box is no branch's own; elsewhere any address marks the business
        "own_mails": F.sort_array(F.when(free | ~chain, F.col("mails")).otherwise(F.filter("mails", lambda m: ~m.rlike(SHARED_BOX)))),
    }).drop("web_kind", "mail_kind")


def _close(x: Column, y: Column, most: int = 2) -> Column:
    """One typing error apart, or two in long words; neighbours swapped count as one."""
    d = F.levenshtein(x, y, 2)  # -1 beyond
    swapped = (d == 2) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, "")))
    return (F.abs(F.length(x) - F.length(y)) <= most) & (((d >= 0) & (d <= F.when(F.least(F.length(x), F.length(y)) >= 6, most).otherwise(1))) | swapped)


def _lacking(a: Column, b: Column) -> Column:
    """Of a's words that b lacks, those that aren't near one of b's words that a lacks: mistyped, cut off or shortened."""

    def less(x: Column, y: Column) -> Column:
        cut = F.startswith(y, x) & (F.length(x) <= 4)
        short = (F.length(x).between(3, 5)) & (F.length(y) > F.length(x) + 1) & (F.left(x, F.lit(1)) == F.left(y, F.lit(1))) & F.rlike(y, F.array_join(F.split(x, ""), ".*"))
        return cut | short

    near = lambda x, y: ((F.length(x) >= 4) & (F.length(y) >= 4) & _close(x, y)) | less(x, y) | less(y, x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), a).otherwise(F.filter(a, lambda x: ~F.exists(b, lambda y: near(x, y))))


def _label(host: Column) -> Column:
    """The first label of a host without hyphens."""
    return F.replace(F.substring_index(host, ".", 1), F.lit("-"), F.lit(""))


def _met(a: Column, b: Column, close) -> Column:
    """1 where a value of a and one of b are equal or close, 0 where a side has none, else -1."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    near = F.exists(a, lambda x: F.exists(b, lambda y: close(x, y)))
    one = (F.size(a) == 1) & (F.size(b) == 1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(x == y, 1).when(one, F.when(close(x, y), 1).otherwise(-1)).when(F.arrays_overlap(a, b) | near, 1).otherwise(-1)


def evidence(pairs: DataFrame) -> DataFrame:
    """The votes of the matching functions on pairs of records (columns with the prefixes a_ and b_).

    1 speaks for one business, -1 against it, 0 abstains. phone, host, email: equal but for typing errors, differing, or missing
    on a side. name: the words of their own match, or, where neither has any, all words do; differ; or can't be told. branch: the
    words match both ways; each side has some that the other lacks; or one side has more. line: another line in a chain.
    """
    digits = lambda x, y: (F.length(x) == F.length(y)) & _close(x, y, 1)
    hosts = lambda x, y: (F.length(_label(x)) >= 6) & _close(_label(x), _label(y), 1)
    boxes = lambda x, y: _close(F.substring_index(x, "@", 1), F.substring_index(y, "@", 1), 1) & ((F.substring_index(x, "@", -1) == F.substring_index(y, "@", -1)) | hosts(F.substring_index(x, "@", -1), F.substring_index(y, "@", -1)))
    pairs = pinned(pairs, {"only_a": F.array_except("a_words", "b_words"), "only_b": F.array_except("b_words", "a_words")})
    pairs = pinned(pairs, {
        "phone": _met(F.col("a_phones"), F.col("b_phones"), digits), "host": _met(F.col("a_hosts"), F.col("b_hosts"), hosts),
        "email": _met(F.col("a_own_mails"), F.col("b_own_mails"), boxes),
        "lack_a": _lacking(F.col("only_a"), F.col("only_b")), "lack_b": _lacking(F.col("only_b"), F.col("only_a")),
        "own_a": F.size("a_stem"), "own_b": F.size("b_stem"),
    })
    pairs = pairs.withColumns({
        "miss_a": F.size("lack_a"), "miss_b": F.size("lack_b"),
        "stem_a": F.size(F.array_intersect("lack_a", "a_stem")), "stem_b": F.size(F.array_intersect("lack_b", "b_stem")),
    })
    stems = (F.col("own_a") > 0) & (F.col("own_b") > 0)
    kept = (F.col("own_a") > F.col("stem_a")) & (F.col("own_b") > F.col("stem_b"))
    full = (F.col("miss_a") == 0) & (F.col("miss_b") == 0)
    either = (F.col("miss_a") == 0) | (F.col("miss_b") == 0)
    empty = (F.size("a_words") == 0) | (F.size("b_words") == 0)
    name = F.when(empty, 0).when(stems, F.when(kept, 1).otherwise(-1)).when(full, 1).when(either, 0).otherwise(-1)
    branch = F.when(empty, 0).when(full, 1).when(either, 0).otherwise(-1)
    chain = F.col("a_chain") | F.col("b_chain")
    return pairs.withColumns({
        "name": name, "branch": branch,
        "line": F.when(chain & (F.col("phone") == -1), -1).when(chain & (F.col("phone") == 0) & ~(full | (F.col("email") == 1)), -1).otherwise(0),
        "generic": ~stems,
    })


def same_business() -> Column:
    """The decision on a pair from its votes, where no model is fitted: at most one detail may differ."""
    phone, host, email, name, branch, line = (F.col(c) for c in ("phone", "host", "email", "name", "branch", "line"))
    contact = (host == 1) | (email == 1)
    fits = (name == 1) | ((name == 0) & (branch >= 0))
    own = ~F.col("generic")
    same_line = (phone == 1) & (contact | ((name == 1) & ((host > -1) | own)) | ((name == 0) & (branch >= 0)))
    # Without lines to compare
    named = (host == 0) & (email == 0) & (name == 1) & (branch == 1) & own
    no_line = (phone == 0) & (line == 0) & ((contact & fits) | ((host == 1) & (email == 1)) | ((email == 1) & (host == 0)) | named)
    # Another line: the line has changed, unless it is another branch's
    moved = (line == 0) & contact & fits & (branch >= 0) & (host > -1)
    branch_moved = (line == -1) & contact & (name == 1) & ((branch == 1) | ((email == 1) & (branch == 0)))
    return same_line | no_line | ((phone == -1) & (moved | branch_moved))


FEATURES = ("words", "stem", "phones", "hosts", "own_mails", "chain")


def sides(pairs: DataFrame, a: DataFrame, b: DataFrame, left: str = "a", right: str = "b", key: str = "id", also: tuple[str, ...] = ()) -> DataFrame:
    """Joins the features of both records to pairs of their keys. ``also``: further columns of the pairs and of either key."""
    fa = a.select(F.col(key).alias(left), *also, *[F.col(c).alias(f"a_{c}") for c in FEATURES])
    fb = b.select(F.col(key).alias(right), *also, *[F.col(c).alias(f"b_{c}") for c in FEATURES])
    return pairs.join(fa, [left, *also]).join(fb, [right, *also])


#: The lanes of a fingerprint, 16 bits each: beginnings and endings of the words, and both ends of phone, host and mailbox.
LANES = ("prefixes", "phone_a", "phone_z", "host_a", "host_z", "mail_a", "mail_z", "endings")
BITS, LANE = 16, 0xFFFF
#: The rotated tables: the two lanes that each puts in front. The last is of whole names with words of their own.
TABLES = ((1, 2), (3, 4), (5, 6), (0, 3), (0, 4), (0, 1), (0, 2), (1, 3), (2, 3), (0, 7))
WHOLE_NAMES = len(TABLES) - 1
#: The table of whole hosts doesn't hold in chains.
WHOLE_HOSTS = 1


def pieces(records: DataFrame) -> DataFrame:
    """The pieces of the lanes as columns, null where a detail is missing: a row for each phone and host."""
    ends = lambda c, n: (F.left(c, F.lit(n)), F.right(c, F.lit(n)))
    there = lambda c: F.nullif(c, F.lit(""))
    records = records.select("*", F.explode_outer("phones").alias("_p")).select("*", F.explode_outer("hosts").alias("_host"))
    box = F.substring_index(F.try_element_at(F.filter("own_mails", lambda m: ~m.rlike(SHARED_BOX)), F.lit(1)), "@", 1)
    prefixes = F.array_join(F.array_distinct(F.transform("words", lambda w: F.left(w, F.lit(2)))), "")  # of sorted words: sorted
    endings = F.array_join(F.sort_array(F.array_distinct(F.transform("words", lambda w: F.right(w, F.lit(2))))), "")
    records = pinned(records, {"_h": _label(F.col("_host")), "_b": box, "prefixes": there(prefixes), "endings": there(endings)})
    half = (F.length("_p") / 2).cast("int")
    cut = {"phone_a": F.left("_p", half), "phone_z": F.right("_p", F.length("_p") - half)}
    cut |= dict(zip(("host_a", "host_z", "mail_a", "mail_z"), (*ends(F.col("_h"), 6), *ends(F.col("_b"), 5)), strict=True))
    return pinned(records, {k: there(c) for k, c in cut.items()})


def bit_lane(name: str) -> Column:
    """A bit for each pair of letters of a piece (of prefixes and endings, for each of the pairs they are made of), so that a typing
    error changes at most four; 0 where there is no piece."""
    apart = name in ("prefixes", "endings")
    places = range(1, 24, 2) if apart else range(1, 7)
    bit = "CASE WHEN length({n}) >= {least} THEN shiftleft(1L, pmod(hash(substring({n}, {i}, 2)), {bits})) ELSE 0L END"
    return F.expr(" | ".join(bit.format(n=name, i=i, least=i if i == 1 or apart else i + 1, bits=BITS) for i in places))


def hashed_lane(name: str) -> Column:
    """A lane that only tells equal pieces from others: for pairs that are judged by their equal lanes."""
    return F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.hash(name).bitwiseAND(LANE).bitwiseOR(1)).cast("bigint")


def entries(records: DataFrame, lane=bit_lane, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, block, lo, hi, host): the rotated block tables of records with words, phones, hosts, own_mails, chain, stem. host is the
    one that the block is of, null for blocks without.

    lo and hi are the fingerprint, four lanes each. A block is a hash of the two pieces whose lanes its table puts in front, with
    the table's number as its last four bits.
    """
    made = pinned(pieces(records), {"lanes": F.array(*[F.coalesce(lane(n), F.lit(0).cast("bigint")) for n in LANES])})
    word = lambda ks: reduce(Column.bitwiseOR, (F.shiftleft(F.col("lanes")[k], BITS * (k % 4)) for k in ks))
    keys = []
    for n, (x, y) in enumerate(TABLES):
        parts = (F.array_join("words", " "),) if n == WHOLE_NAMES else (F.col(LANES[x]), F.col(LANES[y]))
        there = F.size("stem") > 0 if n == WHOLE_NAMES else parts[0].isNotNull() & parts[1].isNotNull()
        if n == WHOLE_HOSTS:
            there &= ~F.col("chain")
        keys.append(F.when(there, F.xxhash64(F.lit(n), *parts).bitwiseAND(-16).bitwiseOR(n)))
    rows = made.select("id", F.array_compact(F.array(*keys)).alias("blocks"), word((0, 1, 2, 3)).alias("lo"), word((4, 5, 6, 7)).alias("hi"), "_host", *kept)
    return rows.select("id", F.explode("blocks").alias("block"), "lo", "hi", "_host", *kept).select("id", "block", "lo", "hi", F.when(of_hosts(F.col("block")), F.col("_host")).alias("host"), *kept)


#: By table, the lanes (as bits) that all entries of a block have in common.
OWN = [1 << x | 1 << y for x, y in TABLES]
PHONE, MAILBOX = 1 << 1 | 1 << 2, 1 << 5 | 1 << 6


def table_of(block: Column) -> Column:
    return block.bitwiseAND(15).cast("int")


def of_hosts(block: Column) -> Column:
    """Whether a block's table is of hosts."""
    return table_of(block).isin(*[n for n, t in enumerate(TABLES) if {3, 4} & set(t)])


def own_lanes(block: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in OWN]), block.bitwiseAND(15).cast("int"))


def lane_sql(k: int, side: str = "") -> str:
    """Lane k of a fingerprint in the columns lo and hi."""
    return f"(shiftrightunsigned({side}{'lo' if k < 4 else 'hi'}, {BITS * (k % 4)}) & {LANE})"


def lanes_there(side: str = "") -> Column:
    """The lanes, as bits, that are there."""
    return F.expr(" + ".join(f"IF({lane_sql(k, side)} <> 0, {1 << k}, 0)" for k in range(8)))


def equal_lanes(a: str = "a_", b: str = "b_") -> Column:
    """The lanes, as bits, that two fingerprints both have and that are equal in all their bits."""
    return F.expr(" + ".join(f"IF({lane_sql(k, a)} <> 0 AND {lane_sql(k, a)} = {lane_sql(k, b)}, {1 << k}, 0)" for k in range(8)))


def close_fingerprints(a: str = "a_", b: str = "b_") -> Column:
    """Of the lanes both have at least three are equal in all their bits, or both of the phone or of the mailbox are, or at most two
    lanes differ in any bit."""
    equal = equal_lanes(a, b)
    both = F.bit_count(lanes_there(a).bitwiseAND(lanes_there(b)))
    n = F.bit_count(equal)
    return (n >= 3) | (both - n <= 2) | (equal.bitwiseAND(PHONE) == PHONE) | (equal.bitwiseAND(MAILBOX) == MAILBOX)


#: Of the bits that are set in a lane both records have, at most so many in a hundred may differ. One detail changed in full and
#: a typing error in another stay below.
FAR = 70


def within_distance(a: str = "a_", b: str = "b_") -> Column:
    """Hamming distance of two fingerprints over the lanes both have, against what these lanes hold; a whole phone or mailbox is
    near enough by itself."""
    x, y = [lane_sql(k, a) for k in range(8)], [lane_sql(k, b) for k in range(8)]
    both = [f"{p} <> 0 AND {q} <> 0" for p, q in zip(x, y, strict=True)]
    apart = " + ".join(f"IF({on}, bit_count({p} ^ {q}), 0)" for on, p, q in zip(both, x, y, strict=True))
    held = " + ".join(f"IF({on}, bit_count({p}) + bit_count({q}), 0)" for on, p, q in zip(both, x, y, strict=True))
    whole = [f"({both[i]} AND {both[j]} AND {x[i]} = {y[i]} AND {x[j]} = {y[j]})" for i, j in ((1, 2), (5, 6))]
    return F.expr(f"({apart}) * 100 <= ({held}) * {FAR} OR {' OR '.join(whole)}")
