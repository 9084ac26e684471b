"""Which addresses denote the same place: numbers first.

Addresses are reduced, in SQL, to digit tokens (the house number; postcodes, units and floors are taken out), street (direction,
name, kind) and remaining words. Places are blocked on the digits and one rare word: the street, or the beginning or end of a
mistyped one together with the rarest of the remaining words. Of these the shared ones are weighed by their rarity against the
poorer side's, words that are not shared by edit distance. Words of areas and regions, which stand beside many others, weigh
nothing; a town's words are one token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.text import folded, in_array, pinned
from leadloom.shared import cut_lineage

#: Kinds of street and how they are written (fixed values).
KINDS = {
    "street": "street|str|st", "road": "road|rd", "avenue": "avenue|ave|av", "lane": "lane|ln|la", "drive": "drive|drv|dr", "court": "court|crt|ct",
    "place": "place|plc|pl", "crescent": "crescent|cres|cr", "terrace": "terrace|ter|tce|terr", "square": "square|sq", "boulevard": "boulevard|blvd|bvd|bd|boul",
    "parade": "parade|pde|prde|prd", "close": "close|cl", "way": "way|wy", "highway": "highway|hwy", "grove": "grove|grv", "row": "row",
}
WAYS = {"north": "north|n|nth", "south": "south|s|sth", "east": "east|e", "west": "west|w"}
SHORT = {"st": "saint", "ste": "saint", "pt": "port", "mt": "mount", "ft": "fort", "upr": "upper", "lwr": "lower", "gt": "great", "lk": "lake", "nw": "new", "lac": "lac"}
COUNTRIES = "india|bharat|usa|u s a|united states(?: of america)?|uk|u k|united kingdom|great britain|canada|australia|uae|u a e|united arab emirates"
KIND = "|".join(KINDS.values())
WAY = "|".join(WAYS.values())
NUMBER = r"\d{1,4}[a-z]?"
#: Different addresses from which a word group between commas is taken for a name; a name this many times rarer than one a typing
#: error away is that one misspelled.
NAME_ROWS, MISSPELLED = 8, 10
#: A name so many times rarer than another that it stands beside tells nothing about that.
TOO_RARE = 50
#: An area's name stands beside at least so many others, none in more than this share; a town's beside one region in this share.
AREA_BESIDE, AREA_TOP, TOWN_TOP = 4, 0.35, 0.95
#: The share of the poorer side's weight that two addresses without a known town must share.
OVERLAP = 0.6


def _strip(c: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(c, pattern, by)


def cleaned(c: Column) -> Column:
    """Lower case, parts between commas, without units, floors, landmarks, buildings and countries."""
    c = folded(F.coalesce(c, F.lit("")))
    c = _strip(c, r"[\r\n;|/]+| - |[–—]", ", ")
    c = _strip(c, r"s\((\d{3}) ?(\d{3})\)", r" $1$2 ")
    c = _strip(c, r"[.'’`\"]", " ")
    c = _strip(c, r"[^\p{L}\p{N},#]+", " ")
    c = _strip(c, r"\b(?:unit|flat|apt|apartment|suite|ste|shop|fl|floor|level|lvl|office|room|rm)\b ?(?:no )?#? ?\d+[a-z]?\b")
    c = _strip(c, r"\b(?:ground|first|second|third|\d+(?:st|nd|rd|th)) floor\b")
    c = _strip(c, r"\b(?:opp|opposite|near|next to|behind|above|beside|close to)\b [a-z ]+?(?= *(?:,|\d|#|$|\bno\b|\bplot\b|\bdoor\b))")
    c = _strip(c, r"\b(?:[a-z]+ ){1,2}(?:building|bldg|chambers|arcade|plaza|tower|towers|mall|complex|house)\b")
    c = _strip(c, r"(?:\b(?:door|house|plot|h|d)\b )?\bno\b ?#? ?(?=\d)|\b(?:plot|door|house)\b ?#? ?(?=\d)|#", " ")
    c = _strip(c, rf"(?:^|[, ]+)(?:{COUNTRIES})(?=[, ]*$)|^(?:{COUNTRIES})(?=[, ])")
    return F.trim(_strip(_strip(_strip(c, r" +", " "), r"(?: ?, ?)+", ", "), r"^[, ]+|[, ]+$", ""))


def _canon(c: Column, table: dict[str, str]) -> Column:
    out = None
    for name, forms in table.items():
        out = (F.when if out is None else out.when)(c.isin(*forms.split("|")), name)
    return out


def parsed(df: DataFrame, key: str, address: str) -> DataFrame:
    """(id, number, way, street, kind, post, left): left is what remains, mostly area, town and region."""
    post = r"(?<![a-z0-9])(?:[a-z]{1,2}\d{1,2}[a-z]? ?\d[a-z]{2}|[a-z]\d[a-z] ?\d[a-z]\d|\d{3} \d{3}|\d{3} \d{2}|\d{3} \d|\d{5,6}|\d{4}(?! ?,? ?(?:WAY )?[a-z]{3,} (?:KIND)\b))(?![a-z0-9])".replace("WAY", f"(?:{WAY})").replace("KIND", KIND)
    df = pinned(df.select(F.col(key).alias("id"), F.col(address).alias("s")), {"s": cleaned(F.col("s"))})
    df = pinned(df, {"post": F.replace(F.regexp_extract("s", f"({post})(?!.*(?<![a-z0-9])(?:{post}))", 1), F.lit(" "), F.lit("")), "s": F.trim(_strip(_strip(F.col("s"), post), r" +", " "))})
    way = rf"(?:({WAY}) )?"
    a = rf"(?:^|[ ,])({NUMBER})[ ,]+{way}([a-z]{{3,}}) ({KIND})\b(?: ({WAY})\b)?"
    b = rf"(?:^|[ ,]){way}([a-z]{{3,}}) ({KIND})\b(?: ({WAY})\b)?[ ,]+({NUMBER})(?=[ ,]|$)"
    c = rf"(?:^|[ ,])({NUMBER})[ ,]+{way}([a-z]{{3,}})(?: ({WAY})\b)?"
    d = rf"^{way}([a-z]{{3,}})[ ,]+({NUMBER})(?=,|$)"
    g = lambda p, k: F.regexp_extract("s", p, k)
    is_a, is_b, is_d = g(a, 1) != "", g(b, 5) != "", g(d, 3) != ""
    pick = lambda x, y, z, w: F.when(is_a, g(a, x)).when(is_b, g(b, y)).when(is_d, g(d, w) if w else F.lit("")).otherwise(g(c, z) if z else F.lit(""))
    cut = F.when(is_a, F.lit("a")).when(is_b, F.lit("b")).when(is_d, F.lit("d")).otherwise(F.lit("c"))
    df = pinned(df, {
        "number": pick(1, 5, 1, 3), "way": F.coalesce(F.nullif(pick(2, 1, 2, 1), F.lit("")), F.nullif(pick(5, 4, 4, 0), F.lit(""))), "street": pick(3, 2, 3, 2), "kind": pick(4, 3, 0, 0),
        "left": F.when(cut == "a", F.regexp_replace("s", a, ", ")).when(cut == "b", F.regexp_replace("s", b, ", ")).when(cut == "d", F.regexp_replace("s", d, ", ")).otherwise(F.regexp_replace("s", c, ", ")),
    })
    df = df.withColumns({"way": _canon(F.col("way"), WAYS), "kind": _canon(F.col("kind"), KINDS), "post": F.nullif("post", F.lit(""))})
    left = F.col("left")
    for short, long in SHORT.items():
        left = F.regexp_replace(left, rf"\b{short}\b(?= [a-z]{{3,}})", long)
    return pinned(df, {"left": _strip(_strip(_strip(left, r" +", " "), r"(?:[ ,]*,[ ,]*)+", ", "), r"^[, ]+|[, ]+$", "")}).filter("number <> '' and street <> ''").drop("s")


def _without_a_letter(c: str) -> Column:
    """A word group and all that remain of it without one of its letters: those of two groups a typing error apart have one in common."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.concat(F.left(c, i), F.substring(c, i + 2, F.length(c)))))


def _near(a: Column, b: Column) -> Column:
    d = F.levenshtein(a, b, 2)
    return (F.least(F.length(a), F.length(b)) >= 5) & (d >= 0) & (d <= 2)


def _shortened(c: str) -> Column:
    """A name as it is and with its first word in each of its short forms: typing errors are made in these too."""
    forms = [F.when(F.startswith(F.col(c), F.lit(f"{long} ")), F.concat(F.lit(short), F.substring(c, len(long) + 1, 1000))) for short, long in SHORT.items()]
    return F.array_compact(F.array(F.col(c), *forms))


def _runs_of_words(c: str) -> Column:
    """All runs of up to four words."""
    words = F.split(c, " ")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in (1, 2, 3, 4)])))


def gazetteer(lefts: DataFrame) -> DataFrame:
    """(name, town, is_area, rows): the names among the word groups between commas, misspelled ones with the town they mean; town is
    null where the name is none's. rows: how many addresses have the name, rightly spelled.

    An area's name occurs beside many towns' and regions', so none takes a large share there. Of the others, a region's stands
    beside several towns', a town's always beside the same region's or none. All are tables, counted over all addresses, of which repeated
    ones count once. What is a piece, a run or a misspelling of a name is told by which is the rarer, so that names remain what they
    are in large tables, where any damage has many rows. lefts: left, n (different addresses).
    """
    parts = lefts.select("left", "n", F.explode(F.array_distinct(F.filter(F.split("left", ", "), lambda p: (p != "") & ~p.rlike(r"\d")))).alias("name"))
    often = cut_lineage(parts.groupBy("name").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= NAME_ROWS))
    # Of a group and a run of its words the rarer is none: it is several names without commas, or a piece of the name.
    within = often.select("name", "rows", F.explode(_runs_of_words("name")).alias("run")).filter("run <> name").join(often.select(F.col("name").alias("run"), F.col("rows").alias("run_rows")), "run")
    inner = within.select(F.when(F.col("run_rows") >= F.col("rows"), F.col("name")).otherwise(F.col("run")).alias("name")).distinct()
    # A rare name a typing error away from a frequent one is that one.
    some = cut_lineage(often.join(inner, "name", "left_anti"))
    x = some.select("name", "rows", F.explode(_without_a_letter("name")).alias("key")).alias("x")
    y = some.select("name", "rows", F.explode(_shortened("name")).alias("form")).select("*", F.explode(_without_a_letter("form")).alias("key")).alias("y")
    rarer = (F.col("x.rows") * MISSPELLED <= F.col("y.rows")) & _near(F.col("x.name"), F.col("y.form"))
    wrong = x.join(y, F.col("x.key") == F.col("y.key")).filter(rarer).groupBy("x.name").agg(F.max_by("y.name", F.struct("y.rows", "y.name")).alias("right"))
    names = cut_lineage(often.select("name").join(inner, "name", "left_anti").join(wrong, "name", "left").select("name", F.coalesce("right", "name").alias("right")))
    known = parts.join(names, "name").groupBy("left", "n").agg(F.collect_set("right").alias("names")).filter("size(names) > 1")  # an address has few parts
    beside = known.select("n", "names", F.explode("names").alias("name")).select("name", "n", F.explode("names").alias("other")).filter("name <> other")
    of = lambda c: often.select(F.col("name").alias(c), F.col("rows").alias(f"{c}_rows"))
    beside = beside.groupBy("name", "other").agg(F.sum("n").alias("n")).join(of("name"), "name").join(of("other"), "other")
    beside = cut_lineage(beside.filter(F.col("other_rows") * TOO_RARE >= F.col("name_rows")).select("name", "other", "n"))
    top = lambda df: df.groupBy("name").agg(F.count("*").alias("others"), F.max("n").alias("top"), F.sum("n").alias("sum"))
    wide = cut_lineage(top(beside).filter((F.col("others") >= AREA_BESIDE) & (F.col("top") < AREA_TOP * F.col("sum"))).select("name"))
    among = beside.join(wide.select(F.col("name").alias("other"), F.lit(1).alias("is_wide")), "other", "left").groupBy("name").agg((F.sum(F.when(F.col("is_wide") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("inside"))
    areas = cut_lineage(wide.join(among, "name").filter("inside < 0.5").select("name"))  # a town without regions stands beside areas only
    apart = top(beside.join(areas.select(F.col("name").alias("other")), "other", "left_anti"))
    regions = apart.filter(F.col("top") < TOWN_TOP * F.col("sum")).select("name")
    no_towns = areas.withColumn("is_area", F.lit(True)).unionByName(regions.join(areas, "name", "left_anti").withColumn("is_area", F.lit(True)))
    found = names.join(no_towns.withColumnRenamed("name", "right"), "right", "left").join(often.withColumnRenamed("name", "right"), "right")
    return found.select("name", F.when(F.col("is_area").isNull(), F.col("right")).alias("town"), F.coalesce("is_area", F.lit(False)).alias("is_area"), "rows")


def located(lefts: DataFrame, names: DataFrame) -> DataFrame:
    """(left, town, rest): the town named in what is left of an address, also with a typing error, else null; and the words that are
    no area's or region's, each with its rarity; a known town's words aside, as the town stands for them."""
    spaced = lefts.select("left", "n", F.regexp_replace("left", ",", "").alias("plain"))
    runs = cut_lineage(spaced.select("left", F.explode(_runs_of_words("plain")).alias("name")).filter("name <> ''"))
    hit = runs.join(names, "name")
    # A region of one town stands beside that as the town beside it: the town's is the name that is left out less often.
    towns = hit.filter("town is not null").groupBy("left").agg(F.max_by("town", F.struct("rows", "town")).alias("town"))
    areas = hit.filter("is_area").groupBy("left").agg(F.array_distinct(F.flatten(F.collect_list(F.split("name", " ")))).alias("areas"))
    exact = cut_lineage(spaced.join(towns, "left", "left").join(areas, "left", "left"))
    keyed = names.filter("town is not null").select("name", "town", F.explode(_without_a_letter("name")).alias("key"))
    lost = runs.join(exact.filter("town is null").select("left"), "left", "left_semi").filter("length(name) >= 4").select("left", F.col("name").alias("run"), F.explode(_without_a_letter("name")).alias("key"))
    near = lost.join(keyed, "key").filter(_near(F.col("run"), F.col("name"))).groupBy("left").agg(F.min_by("town", F.levenshtein("run", "name")).alias("near"))
    done = exact.join(near, "left", "left").withColumn("town", F.coalesce("town", "near"))
    words = F.array_except(F.array_except(F.split("plain", " "), F.coalesce("areas", F.array().cast("array<string>"))), F.coalesce(F.split("town", " "), F.array().cast("array<string>")))
    done = cut_lineage(done.select("left", "n", "town", words.alias("words")))
    one = done.select("left", "n", F.explode("words").alias("word")).filter("word <> ''")
    total = done.agg(F.sum("n").alias("total"))
    rarity = one.groupBy("word").agg(F.sum("n").alias("rows")).crossJoin(F.broadcast(total)).select("word", F.log(1 + F.col("total") / F.col("rows")).alias("weight"))  # one row beside
    rest = one.filter("word <> ''").join(rarity, "word").groupBy("left").agg(F.sort_array(F.collect_list(F.struct(F.col("weight"), F.col("word"))), False).alias("rest"))
    return done.select("left", "town").join(rest, "left", "left")


def _only(values: str) -> Column:
    """The one value of a column in a group, null if there are none or several."""
    return F.when(F.min(values) == F.max(values), F.min(values))


def by_postcode(places: DataFrame) -> DataFrame:
    """Towns left out are filled in from the first three characters of the postcode, where nearly all addresses with them agree."""
    places = places.withColumn("area", F.left("post", F.lit(3)))
    seen = places.filter("town is not null and area is not null").select("area", "town", "number", "w", "street").distinct().groupBy("area", "town").count()
    sure = seen.groupBy("area").agg(F.max_by("town", "count").alias("area_town"), F.max("count").alias("top"), F.sum("count").alias("n"))
    sure = sure.filter("n >= 5 and top >= 0.95 * n").select("area", "area_town")
    return places.join(sure, "area", "left").withColumn("town", F.coalesce("town", "area_town")).drop("area", "area_town")


def settled(places: DataFrame) -> DataFrame:
    """Kinds and towns that an address leaves out are filled in where all others of its number and street agree on one."""
    by_street = places.groupBy("number", "w", "street").agg(_only("kind").alias("only_kind"), _only("town").alias("only_town"))
    out = places.join(by_street, ["number", "w", "street"])
    out = cut_lineage(out.withColumns({"kind": F.coalesce("kind", "only_kind"), "town": F.coalesce("town", "only_town")}).drop("only_kind", "only_town"))
    lacking = (F.col("kind").isNull() & F.col("town").isNotNull()) | (F.col("town").isNull() & F.col("post").isNotNull())
    some = out.filter(lacking).select("number", "w", "street").distinct()  # few: only these streets are looked at again
    of_them = out.join(some, ["number", "w", "street"], "left_semi")
    by_town = of_them.filter("town is not null").groupBy("number", "w", "street", "town").agg(_only("kind").alias("only_kind"))
    by_post = of_them.filter("post is not null").groupBy("number", "w", "street", "post").agg(_only("town").alias("only_town"))
    fixed = out.filter(lacking).join(by_town, ["number", "w", "street", "town"], "left").withColumn("kind", F.coalesce("kind", "only_kind")).drop("only_kind")
    fixed = fixed.join(by_post, ["number", "w", "street", "post"], "left").withColumn("town", F.coalesce("town", "only_town")).drop("only_town")
    return out.filter(~lacking).unionByName(fixed)


def _overlap(a: Column, b: Column) -> Column:
    """The weight of the words of one side that the other has too, if need be but for typing errors, over the poorer side's weight;
    null where that is 0."""
    weigh = lambda x: F.aggregate(x, F.lit(0.0), lambda t, w: t + w["weight"])
    words = F.array_intersect(F.transform(a, lambda w: w["word"]), F.transform(b, lambda w: w["word"]))
    near = lambda w, other: F.exists(other, lambda v: ~F.array_contains(words, v["word"]) & _near(w["word"], v["word"]))
    shared = lambda p, q: weigh(F.filter(p, lambda w: F.array_contains(words, w["word"]) | near(w, q)))
    poorer = F.least(weigh(a), weigh(b))
    return F.when(poorer > 0, F.greatest(shared(a, b), shared(b, a)) / poorer)


def place_classes(df: DataFrame, key: str = "lead_id", address: str = "address") -> tuple[DataFrame, DataFrame]:
    """(member, pairs): the class of each address (id, class), and pairs (p, q) of different classes that denote the same place.

    Equal are house number with its letter, direction, street, kind and town; street and town but for typing errors. Where a
    town isn't known, the remaining words must share enough of their weight, or the postcodes be equal. Null addresses and those
    without house number or street are left out, as rows with null ids; repeated ids are taken once for each of their addresses.
    Addresses that are equal once reduced form a class, compared once. An empty table gives empty results.
    """
    places = cut_lineage(parsed(df.filter(F.col(key).isNotNull() & F.col(address).isNotNull()), key, address))
    lefts = cut_lineage(places.drop("id").distinct().groupBy("left").agg(F.count("*").alias("n")))
    where = located(lefts, cut_lineage(gazetteer(lefts)))
    number = lambda c, names: F.when(F.col(c).isNotNull(), F.array_position(in_array(names), F.col(c)).cast("int"))
    found = places.join(where, "left", "left").select("id", "number", F.coalesce("way", F.lit("")).alias("w"), "street", number("kind", list(KINDS)).alias("kind"), "post", F.xxhash64("town").alias("town_hash"), "town", "rest")
    found = cut_lineage(found.withColumn("town", F.when(F.col("town").isNotNull(), F.col("town_hash"))).drop("town_hash"))
    done = settled(by_postcode(found))
    # With a town, postcode and other words don't matter.
    lost = F.col("town").isNull()
    done = done.withColumns({"post": F.when(lost, F.col("post")), "rest": F.when(lost, F.coalesce("rest", F.array().cast("array<struct<weight:double,word:string>>")))})
    cols = ["number", "w", "street", "kind", "town", "post"]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cols]
    words = F.coalesce(F.array_join(F.transform("rest", lambda w: w["word"]), " "), F.lit("?"))
    classed = cut_lineage(done.select("id", F.xxhash64(*texts, words).alias("class"), *cols, "rest"))
    classes = cut_lineage(classed.groupBy("class").agg(*[F.first(c).alias(c) for c in (*cols, "rest")]))
    # Blocks: the digits and one rare word; that is the street, or where it may be mistyped its beginning or end and the town, or
    # where that isn't known one of the words or the postcode.
    words = F.concat(F.transform(F.coalesce("rest", F.array().cast("array<struct<weight:double,word:string>>")), lambda w: w["word"]), F.array("post"))
    rare = F.array_compact(F.when(F.col("town").isNotNull(), F.array(F.col("town").cast("string"))).otherwise(words))
    ends = F.flatten(F.transform(rare, lambda w: F.array(*[F.xxhash64("number", F.lit(n), w, piece) for n, piece in ((1, F.left("street", F.lit(3))), (2, F.right("street", F.lit(3))))])))
    spread = F.xxhash64("number", F.lit(0), "street", "town")
    blocked = classes.select("*", F.explode(F.array_distinct(F.concat(F.array(spread), ends))).alias("block"))
    x, y = blocked.alias("x"), blocked.alias("y")
    u, v = F.col("x.street"), F.col("y.street")
    distance = F.levenshtein(u, v, 2)
    close = (u == v) | ((distance >= 0) & (distance <= F.when(F.least(F.length(u), F.length(v)) >= 7, 2).otherwise(1)))
    kinds = F.col("x.kind").eqNullSafe(F.col("y.kind")) | F.col("x.kind").isNull() | F.col("y.kind").isNull()
    both = (F.col("x.block") == F.col("y.block")) & (F.col("x.number") == F.col("y.number")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.class") < F.col("y.class"))
    met = x.join(y, both & kinds & close & F.col("x.town").eqNullSafe(F.col("y.town"))).filter(F.col("x.town").isNotNull() | same_rest("x", "y")).select(F.col("x.class").alias("p"), F.col("y.class").alias("q"))
    return classed.select("id", "class").distinct(), met.distinct()


def same_rest(x: str, y: str) -> Column:
    return F.coalesce(F.col(f"{x}.post") == F.col(f"{y}.post"), F.lit(False)) | F.coalesce(_overlap(F.col(f"{x}.rest"), F.col(f"{y}.rest")) >= OVERLAP, F.lit(False))


def same_places(df: DataFrame, key: str = "lead_id", address: str = "address") -> DataFrame:
    """(a, b), a < b: every pair of rows whose addresses denote the same place (see place_classes)."""
    member, pairs = place_classes(df, key, address)
    member = cut_lineage(member)
    within = member.alias("m").join(member.alias("n"), (F.col("m.class") == F.col("n.class")) & (F.col("m.id") < F.col("n.id")))
    across = pairs.join(member.select(F.col("class").alias("p"), F.col("id").alias("i")), "p").join(member.select(F.col("class").alias("q"), F.col("id").alias("j")), "q").filter("i <> j")
    return within.select(F.col("m.id").alias("a"), F.col("n.id").alias("b")).unionByName(across.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))).distinct()
