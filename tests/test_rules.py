"""Cases where the rules are easily got wrong, each by hand."""

from pyspark.sql import functions as F

from leadloom.functions import reviews as R
from leadloom.functions import text as T
from leadloom.operators import criteria as K
from leadloom.operators import identity as I


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "c string").select(use(F.col("c")).alias("r")).first().r


def test_names(spark):
    for name, key in (("Joe's Gym", "joe s gym"), ("Planet 1 Fitness Studio - Korattur", "planet 1 fitness studio"), ("A-B (x)", "a b"), (" Café  |  Two", "caf"), (None, "")):
        assert one(spark, name, T.chain_key) == key
    for name, shown in (("H24 FITNESS (ABC) GYM", "H24 Fitness (Abc) Gym"), ("OG RF  GYMS", "OG RF Gyms"), ("Quiet Name", "Quiet Name"), ("123", "123"), (None, None), ("BIG name", "Big name")):
        assert one(spark, name, T.display_name) == shown


def test_shorten(spark):
    for text, short in (("One. Two! Three words", "One. Two! ..."), ("One. Two words and more", "One. Two ..."), ("abcdefghijklmnop", "abcdefghijkl ..."), ("a, b, c, - and so on", "a, b, c ..."), ("short", "short")):
        assert one(spark, text, lambda c: T.shorten(c, 12)) == short


def test_lead_id_ignores_spelling(spark):
    make = lambda *v: spark.createDataFrame([v], "m string, w string, p string, n string").select(T.lead_id(*map(F.col, "mwpn")).alias("r")).first().r
    assert make("", "https://WWW.a.example/x", "+1 (555) 010-0199", "A") == make(None, "a.example", "15550100199", "B")
    assert make("HTTPS://Maps/x ", None, None, None) == make("https://maps/x", "z", None, None)
    assert make(None, None, None, " Name") == make("", "", "12", "name") != make(None, None, None, None)


def test_reviews(spark):
    blob = '[{"Stars": 2, "Snippet": " bad\\n thing ", "name": "X"}, "no", {"rating": "4.5", "text": "good"}, {"score": 2.5, "text": "", "body": "meh"}, {"rating": "x", "text": "y"}]'
    found = lambda c: R.complaints(R.reviews(c))
    assert one(spark, blob, found) == ["(2★) bad thing", "(2.5★) meh"]
    assert one(spark, "[{'rating': 1, 'text': \"it's off\"}]", found) == ["(1★) it's off"]
    assert one(spark, '{"rating": 1, "text": "single"}', found) == ["(1★) single"]
    for nothing in (None, "", " ", "[", "{'a'", "plain", '[{"rating": 1, "text": "x"}]\n===', '[{"rating": 1, "text": "x"}] ]'):
        assert one(spark, nothing, found) == []
    assert one(spark, "x", lambda _: R.negative_reviews(F.array(*[F.lit(str(i)) for i in range(7)]))) == "0 | 1 | 2 | 3 | 4 | ...(+2 more)"


def test_upsert_takes_one_row_and_keeps_all_columns(spark):
    old = spark.createDataFrame([(1, "c1", "l1", None, "2020", "x"), (2, "c2", "l2", "called", "2021", "y")], "o int, cid string, link string, status string, added string, _src string")
    new = spark.createDataFrame([(3, "c1", "l2", "z")], "o int, cid string, link string, _src string")
    got = {r.o: r for r in I.upsert(old, new, ["cid", "link"], "o", ["status"], "added", F.lit("now")).collect()}
    assert set(got) == {3} and (got[3].status, got[3].added, got[3]._src) == (None, "2020", "z")  # all from the row of the same cid


LISTING = [
    (1, "Big Gym", "Gym", "1", "5", "50", "L1?utm_source=x", "c1"), (2, "Spa", "Gym/Fitness center", "2", "4.2", "10", "l2", "c1"), (3, "Café Bar", "bar", "3", "4", "9", None, None),
    (4, "Barber", "Hair, bar", None, "4", "9", None, None), (5, "Old", "bar", "5", None, None, "l5", "5.0"), (6, "Known", "bar", "6", "4.9", "60", "l6", "c6"),
]


def test_filter_chain(spark):
    df = spark.createDataFrame(LISTING, "o int, title string, category string, phone string, rating string, review_count string, link string, cid string")
    run = lambda history=None, contacted=None, **row: [r.o for r in K.filter_leads(df, row, "o", history, contacted).collect()]
    assert sorted(run()) == [1, 3, 4, 5, 6]
    assert 2 not in run()  # its cid was there before
    assert sorted(run(phone_required="Yes")) == [1, 3, 5, 6] and run(phone_required="no") == [4]
    assert run(website_required="yes") == [] and len(run(website_required="no")) == 5
    assert sorted(run(min_rating="4.5")) == [1, 6] and sorted(run(min_reviews="9.0")) == [1, 3, 4, 6]
    assert run(allowed_categories="GYM; x") == [1] and sorted(run(allowed_categories="bar")) == [3, 4, 5, 6]
    assert sorted(run(exclude_terms="bar")) == [1] and sorted(run(exclude_terms="caf; c++")) == [1, 3, 4, 5, 6]
    assert sorted(run(review_quality_filter="Any; outdated; none; poor")) == [1, 3, 4, 6]
    seen = spark.createDataFrame([("c6", None), (None, "L1")], "cid string, link string")
    assert sorted(run(seen, exclude_terms="duplicates")) == [1, 3, 4, 5]  # links keep their case behind the host
    done = spark.createDataFrame([("5", ""), ("", "big  gym")], "cid string, business_name string")
    assert sorted(run(None, done, exclude_terms="already contacted")) == [3, 4, 6]
    assert len(run(max_leads="2")) == 2 and len(run(max_leads="-1")) == 5
    assert K.output_columns(df, "Rating; Business Name; Fax").columns == ["Rating", "Business Name", "Fax"] and K.output_columns(df, "").columns == df.columns
    assert K.filter_leads(df.limit(0), {}, "o").count() == 0
