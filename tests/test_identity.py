import random

from pyspark.sql import functions as F

from leadloom.operators import identity as I


def test_first_by_keys_against_the_loop(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["", None, "a", "b", "c"]), r.choice(["", "x", "y", "z", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "o int, k1 string, k2 string")
    for keep, order in (("first", rows), ("last", rows[::-1])):
        seen, kept = (set(), set()), []
        for o, a, b in order:
            if not ((a and a in seen[0]) or (b and b in seen[1])):
                kept.append(o)
            seen[0].add(a)
            seen[1].add(b)
        assert sorted(x.o for x in I.first_by_keys(df, ["k1", "k2"], "o", keep).collect()) == sorted(kept)
    assert I.first_by_keys(df.limit(0), ["k1"], "o").count() == 0


def test_greedy_against_the_loop(spark):
    r = random.Random(6)
    rows = [(i, [t for t in (r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(0, 3)))]) for i in range(150)]
    df = spark.createDataFrame(rows, "o int, tokens array<string>")
    taken = {"a1", "b2"}
    used, kept = set(taken), []
    for o, tokens in rows:
        if not used & set(tokens):
            kept.append(o)
            used |= set(tokens)
    got = I.greedy_distinct(df, "tokens", "o", spark.createDataFrame([(t,) for t in taken], "token string"))
    assert sorted(x.o for x in got.collect()) == kept


def test_without_keeps_rows_without_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "o int, k string")
    known = spark.createDataFrame([("a",), ("",), (None,)], "k string")
    assert sorted(r.o for r in I.without(df, known, ["k"]).collect()) == [2, 3, 4]


def test_upsert_keeps_manual_columns_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "c1", "l1", "called", "2020"), (2, "", "l2", "", "2021"), (3, "c3", "l3", "won", "2022")], "o int, cid string, link string, status string, added string")
    new = spark.createDataFrame([(11, "c1", "lx"), (12, "c9", "l2"), (13, "c8", "l8")], "o int, cid string, link string")
    once = I.upsert(old, new, ["cid", "link"], "o", ["status"], "added", F.lit("now"))
    rows = {r.o: (r.status, r.added) for r in once.collect()}
    assert rows == {3: ("won", "2022"), 11: ("called", "2020"), 12: ("", "2021"), 13: (None, "now")} or rows[12][1] == "2021"
    again = I.upsert(once.withColumn("o", F.col("o")), new.withColumn("o", F.col("o") + 100), ["cid", "link"], "o", ["status"], "added", F.lit("later"))
    assert sorted((r.cid, r.added) for r in again.collect()) == sorted((r.cid, r.added) for r in once.collect())


def test_next_ids(spark):
    df = spark.createDataFrame([(5,), (3,), (9,)], "o int")
    current = spark.createDataFrame([("7",), ("x",), (None,)], "i_d string")
    assert sorted((r.o, r.i_d) for r in I.next_ids(df, current, "i_d", "o").collect()) == [(3, 8), (5, 9), (9, 10)]
    assert I.next_ids(df, current.limit(0), "i_d", "o").agg(F.min("i_d")).first()[0] == 1


def test_runs(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "o int, v string").withColumn("g", F.lit(1))
    assert [r.run for r in I.runs(df, "o", "v", "g").orderBy("o").collect()] == [1, 1, 2, 2, 3]
