import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import business as B
from leadloom.llm.address import parsed, place_classes, same_places
from leadloom.llm.canon import LEAST, _tokens, canon_names, map_values, match_values
from leadloom.llm.candidates import hot_blocks, pairs_between, pairs_to_earlier
from leadloom.llm.history import History, features, repeats
from leadloom.llm.linkage import LabelModel, link
from leadloom.llm.subjects import OWN_LABELS, Matcher, assign_subjects, best_threshold, calibrate, hits_of, levels, sentences


@pytest.mark.parametrize(
    ("raw", "key"),
    [("+91 17239 98209", "1723998209"), ("016738 12345 extn 4", "1673812345"), ("tel:+61-6-4500-5062", "645005062"), ("06 4500 5062", "645005062"), ("61665819232.0", "665819232"),
     ("00971 1 532 1586 0", "153215860"), ("+61 (0)6 8144 9534", "681449534"), ("'+17983291", "7983291"), ("n/a", None), (None, None), ("123", None)],
)
def test_phone_key(spark, raw, key):
    assert B.phone_key(spark.createDataFrame([(raw,)], "c string"), "c").first().c == key


def test_names_and_hosts(spark):
    df = spark.createDataFrame([("The Brïvi & Co. Plumbing Ltd. | Open Now", '=HYPERLINK("https://www.a-b.example/","x")', "<A+tag@B.example>; c@d.example")], "n string, w string, e string")
    r = B.name_words(df, "n").select("n", B.host_of(F.col("w")).alias("w"), B.emails_of(F.col("e")).alias("e")).first()
    assert (r.n, r.w, r.e) == (["brivi", "plumbing"], "a-b.example", ["a@b.example", "c@d.example"])


def records(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, name string, phone string, site string, mail string, is_new boolean")
    return B.prepare(df, "id", "name", ["phone"], "site", "mail").join(df.select("id", "is_new", F.col("is_new").cast("int").alias("batch")).dropDuplicates(["id"]), "id")


BASE = [
    (1, "Vuvakifu Roofing", "+1 793 298 2449", "https://vuvakifu.example", "info@vuvakifu.example", False),
    (2, "Sesabepe Fight Hall - Eastgate", "+91 16120 71263", "sesabepe.example", None, False),
    (3, "Sesabepe Fight Hall - Riverside", "+91 17722 48680", "sesabepe.example", None, False),
    (4, "Sesabepe Fight Hall - Mill End", "+91 11119 82699", "sesabepe.example", None, False),
    (5, "Labotramu Drains", "+1 694 454 3710", "labotramu.example", None, False),
    (6, "Kubifofu Locks", "+1 694 454 3710", "kubifofu.example", None, False),
]
NEW = [
    (11, "VUVAKIFU ROOFING LLC", "793-298-2449", None, None, True),
    (12, "Vuvakifu Roofing", "+1 555 111 2222", "http://www.vuvakifu.example/home", "info@vuvakifu.example", True),
    (13, "Sesabepe Fight Hall - Old Market", "+91 15555 11111", "sesabepe.example", None, True),
    (14, "Sesabepe Fight Hal - Riverside", "+91 17722 48680", "www.sesabepe.example", None, True),
    (15, "Vuvakifu Roofing", "+1 793 298 2494", "vuva-kifu.example", "inf@vuva-kifu.example", True),
    (16, "Other Name", "+1 694 454 3710", "labotramu.example", None, True),
    (17, None, None, None, None, True), (18, None, None, None, None, True),
]
WANT = {(1, 11), (1, 12), (3, 14), (1, 15), (5, 16)}


def test_repeats_come_batch_by_batch(spark, tmp_path):
    assert {(r.first_id, r.dup_id) for r in repeats(records(spark, BASE + NEW)).collect()} == WANT
    history = History(spark, f"file://{tmp_path}/h")
    history.accept(0, records(spark, BASE), accepted=True)
    found = {}
    for batch in (1, 2, 2, 1):  # a batch that is taken again gives the same
        rows = history.accept(batch, records(spark, NEW[:3] if batch == 1 else NEW[3:])).collect()
        got = {(r.first_id, r.dup_id) for r in rows}
        assert found.setdefault(batch, got) == got
    assert found[1] | found[2] == WANT
    assert repeats(records(spark, BASE + NEW).limit(0)).count() == 0


def test_batches_at_once_and_one_by_one_agree(spark, tmp_path):
    rows = [(100 * n + r[0], *r[1:-1], True) for n in (1, 2, 3) for r in BASE + NEW]
    whole = records(spark, BASE + rows).withColumn("batch", F.floor(F.col("id") / 100).cast("int"))
    want = {(r.first_id, r.dup_id) for r in repeats(whole).collect()}
    assert want == {(r.first_id, r.dup_id) for r in repeats(whole, hot=2).collect()}  # the size of hot blocks changes nothing
    history = History(spark, f"file://{tmp_path}/h")
    history.accept(0, whole.filter("batch = 0"), accepted=True)
    assert want == {(r.first_id, r.dup_id) for n in (1, 2, 3) for r in history.accept(n, whole.filter(f"batch = {n}")).collect()}


def test_a_batch_reads_no_texts_of_the_whole_history(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}/h")
    history.accept(0, records(spark, BASE), accepted=True)
    seen = []
    real = history._until
    history._until = lambda name, batch: seen.append(name) or real(name, batch)
    history.accept(1, records(spark, NEW))
    assert seen.count("records") == 1  # the rows of the pairs that are left
    assert set(spark.read.parquet(f"file://{tmp_path}/h/blocks").columns) == {"id", "block", "lo", "hi", "host", "batch"}


def test_all_batches_are_looked_up_in_one_pass(spark, monkeypatch):
    whole = records(spark, BASE + [(100 * n + r[0], *r[1:-1], True) for n in (1, 2, 3) for r in NEW]).withColumn("batch", F.floor(F.col("id") / 100).cast("int"))
    seen, real = [], History._until
    monkeypatch.setattr(History, "_until", lambda self, name, batch: seen.append(name) or real(self, name, batch))
    assert {(1, 111), (1, 211), (1, 311)} <= {(r.first_id, r.dup_id) for r in repeats(whole).collect()}
    assert seen.count("blocks") == 1 and seen.count("records") == 1


def test_kinds_by_batch_are_those_of_the_batches_before(spark):
    r = np.random.default_rng(5)
    words = [(f"w{int(r.integers(6))}", int(r.integers(12)), int(r.integers(1, 4)), int(b)) for b in r.integers(0, 5, 150)]
    hosts = [(f"h{int(r.integers(7))}", int(r.integers(2)), int(r.integers(3 + 3 * (k % 7))), int(r.integers(1, 30)), int(b)) for k, b in enumerate(r.integers(0, 5, 400))]
    hosts += [("page", 0, 100 + i, 1, i % 5) for i in range(40)] + [("page", 1, 100 + i, 1, i % 5) for i in range(40)]
    words, hosts = spark.createDataFrame(words, "w string, host bigint, n bigint, batch int"), spark.createDataFrame(hosts, "host string, what int, value bigint, n bigint, batch int")
    common, kinds = B.common_words_by_batch(words).collect(), B.host_kinds_by_batch(hosts).collect()
    for n in range(5):
        assert sorted(x.w for x in common if x.since <= n <= x.until) == sorted(x.w for x in B.common_words(words.filter(f"batch <= {n}")).collect())
        assert sorted((x.host, x.kind) for x in kinds if x.since <= n <= x.until) == sorted((x.host, x.kind) for x in B.host_kinds(hosts.filter(f"batch <= {n}")).collect())
    assert common and {x.kind for x in kinds} == {"platform", "chain"}


def test_one_error_changes_few_bits(spark):
    rows = [(1, "Zetopogu Climate", "+1 555 010 0199", None, None, True), (2, "Zetopogu Climate", "+1 555 010 0139", None, None, True), (3, "Zetoqogu Climate", "+1 555 010 0199", None, None, True), (4, "Vabilemo Drains", "+1 802 334 7621", None, None, True)]
    fp = {r.id: (r.lo, r.hi) for r in B.entries(features(records(spark, rows))).collect()}
    apart = lambda a, b: sum((x ^ y & 2**64 - 1).bit_count() if (x ^ y) >= 0 else ((x ^ y) & 2**64 - 1).bit_count() for x, y in zip(fp[a], fp[b], strict=True))
    assert 0 < apart(1, 2) <= 4 and apart(1, 3) <= 4 < apart(1, 4)


def judge_of(full):
    return lambda pairs: B.evidence(B.sides(pairs, full, full)).filter(B.same_business()).select("a", "b")


def test_copies_in_a_hot_block_are_all_linked(spark):
    rows = [(i, "Zetopogu Climate", "+1 555 010 0199", f"zetopogu.example/{i}", f"x{i}@mailnook.example", i > 0) for i in range(60)]
    full = features(records(spark, rows)).cache()
    few = pairs_to_earlier(B.entries(full.filter("is_new")), B.entries(full), judge_of(full), hot_blocks(B.entries(full), 5), most=5)
    linked = {r.b for r in few.collect()}
    assert linked == set(range(1, 60)) and few.count() < 60 * 59 / 2


def crowd(n=14):
    """Businesses of one hot block, each twice, with a typing error in name and phone: of their blocks only this one is common."""
    word = lambda i: "ba" + "".join("bdfgklmnprstvz"[(i * k + k) % 14] * 2 for k in (3, 5, 9)) + "ta"
    line = lambda i: f"{i + 10}{(i * 7 + 3) % 10}{(i * 3 + 1) % 10}"
    one = [(i, f"Zetopogu Climate {word(i)}", f"+1 555 01{line(i)}1", None, None, False) for i in range(n)]
    two = [(n + i, f"Zetopogu Climate {word(i)[:3]}x{word(i)[3:]}", f"+1 555 01{line(i)}7", None, None, True) for i in range(n)]
    return one + two, {(i, n + i) for i in range(n)}


def test_each_row_of_a_hot_block_finds_its_first(spark):
    rows, want = crowd()
    full = features(records(spark, rows)).cache()
    for hot in (hot_blocks(B.entries(full), 5), None):
        found = pairs_to_earlier(B.entries(full.filter("is_new")), B.entries(full), judge_of(full), hot, 5).groupBy("b").agg(F.min("a").alias("a"))
        assert {(r.a, r.b) for r in found.collect()} == want


def test_pairs_do_not_depend_on_the_size_of_a_block(spark):
    rows = crowd()[0] + [(300 + i, "Zetopogu Climate", None if i % 3 else f"+1 555 01{i:02d} 0{i % 4}{i % 5}9", None if i % 2 else "zetopogu.example", None if i % 4 else f"x{i}@nook.example", i > 6) for i in range(24)]
    # of one block (beginnings of name and line) and no more alike than that
    rows += [(400 + i, f"Zetopogu Climate bazol{c}{c}", f"+1 555 01{i:02d} {i * 37 % 90 + 10}4", f"{c * 8}.example", None, i > 6) for i, c in enumerate("bdfgklmnprstvz")]
    full = features(records(spark, rows)).cache()
    left, right = full.filter("not is_new"), full.filter("is_new")
    got = [sorted(map(tuple, pairs_between(left, right, most).collect())) for most in (3, 8, 10**6)]
    assert got[0] and got[0] == got[1] == got[2]


def test_kinds_do_not_depend_on_the_number_of_rows(spark):
    """One business, repeated with errors in every third row, is no chain and no platform, and its name stays its own."""
    wrong = lambda t, i: t[: i % 6 + 1] + "x" + t[i % 6 + 2 :] + ("" if i % 2 else chr(97 + i % 26))
    for copies in (12, 300):
        many = [(i, wrong("Zetopogu", i) if i % 9 == 0 else "Zetopogu Climate", f"+1 555 010 {1000 + i}" if i % 9 == 3 else "+1 555 010 0199", "zetopogu.example", None, False) for i in range(copies)]
        others = [(10_000 + i, f"Lo{chr(97 + i)}omu Climate", f"+1 555 2{i:02d} 7788", f"lo{chr(97 + i)}omu.example", None, False) for i in range(20)]
        page = [(20_000 + i, f"Pa{chr(97 + i)}omu Drains", f"+1 555 3{i:02d} 7788", "bigdeck.example", None, False) for i in range(20)]
        rows = records(spark, many + others + page).cache()
        common = B.common_words(B.word_counts(rows))
        words = {r.w for r in common.collect()}
        assert "climate" in words and "zetopogu" not in words
        kinds = {r.host: r.kind for r in B.host_kinds(B.host_counts(B.classify(rows, common))).collect()}
        assert kinds.get("bigdeck.example") == "platform" and kinds.get("zetopogu.example") != "platform"
        if copies > 100:
            assert "zetopogu.example" not in kinds
        listed = {r.id: r.stem for r in B.classify(rows, common).collect()}
        assert listed == {r.id: r.stem for r in B.classify(rows, common, listed=0).collect()}


def test_link_and_confidence(spark):
    left = records(spark, BASE).drop("is_new")
    right = records(spark, [(100 + r[0], *r[1:]) for r in NEW]).drop("is_new")
    got = {(r.left_id, r.right_id): r.confidence for r in link(left, right).collect()}
    assert set(got) == {(a, 100 + b) for a, b in WANT} and all(0.5 <= c <= 1 for c in got.values())
    assert link(left.limit(0), right).count() == 0


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20000) < 0.3
    sign = np.where(truth, 1, -1)
    cols = [np.where(r.random(20000) < acc, sign, -sign) * (r.random(20000) < cover) for acc, cover in ((0.9, 0.8), (0.8, 0.9), (0.85, 0.7), (0.7, 1.0))]
    cols.append(cols[0].copy())  # a function that copies another must not count twice
    votes, index, counts = np.unique(np.stack(cols, 1), axis=0, return_inverse=True, return_counts=True)
    model = LabelModel().fit(votes, counts.astype(float), (votes.sum(1) > 0).astype(float))
    assert any({0, 4} <= set(c) for c in model.cliques)
    # as right as the posterior from the true accuracies, within a hundredth
    odds = np.log(0.3 / 0.7) + sum(c * np.log(acc / (1 - acc)) for c, acc in zip(cols, (0.9, 0.8, 0.85, 0.7), strict=False))
    best = ((odds > 0) == truth).mean()
    assert ((model.confidence(votes)[index.ravel()] > 0.5) == truth).mean() > best - 0.01


CANON = [("country", 1, "United States"), ("country", 1, "USA"), ("country", 2, "Niger"), ("country", 3, "Nigeria"), ("cat", 4, "Home Handyman"), ("cat", 5, "Window cleaning"), ("cat", 6, "Window installation")]
TYPED = [("country", "uinted sttates"), ("country", "States, United"), ("country", "u.s.a."), ("country", "NIGERIA only"), ("country", "Nigre"), ("country", "???"), ("country", "Atlantis"), ("cat", "best Home H&yman in Al Qasra"), ("cat", "windowcleaning"), ("cat", "Kite fair"), ("cat", None)]


def test_values(spark):
    canon = spark.createDataFrame(CANON, "kind string, canon_id int, name string")
    typed = spark.createDataFrame([(i, *t) for i, t in enumerate(TYPED)], "id int, kind string, value string")
    got = {r.id: r.canon_id for r in map_values(typed, canon).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 3, 4: 2, 5: 0, 6: 0, 7: 4, 8: 5, 9: 0}
    assert map_values(typed.limit(0), canon).count() == 0 and {r.canon_id for r in map_values(typed, canon.limit(0)).collect()} == {0}


def test_join_finds_what_brute_force_finds(spark):
    canon = spark.createDataFrame(CANON, "kind string, canon_id int, name string")
    typed = spark.createDataFrame([(k, v) for k, v in TYPED if v], "kind string, value string")
    got = {(r.kind, r.value): round(r.similarity, 9) for r in match_values(typed, canon).collect()}
    from leadloom.llm.canon import _bare, _light

    sets = lambda df, c: df.withColumn("l", _light(F.col(c))).withColumn("f", F.explode(F.array("l", _bare(F.col("l"))))).withColumn("t", _tokens(F.col("f"))).collect()
    want = {}
    for a in sets(typed, "value"):
        for b in sets(canon, "name"):
            x, y = set(a.t), set(b.t)
            if a.kind == b.kind and x and y and (s := len(x & y) / len(x | y)) >= LEAST:
                want[a.kind, a.value] = max(round(s, 9), want.get((a.kind, a.value), 0))
    assert got == want


def test_canon_names_take_missing_parts(spark):
    df = spark.createDataFrame([("c", 1, "A", None, None, None), ("c", 2, "B", "BB", "BBB", ["b", None])], "kind string, canon_id int, canon_name string, iso2 string, iso3 string, alt_names array<string>")
    assert sorted(r.name for r in canon_names(df).collect()) == ["A", "B", "BB", "BBB", "b"]


ADDRESSES = {
    1: "12A North Lydteson Street, Mont Brisard, BR U4J 1R7, Canada", 2: "Flat 3, 12a n. lydtesno st, mont brisard", 3: "12 North Lydteson Street, Mont Brisard", 4: "12A Lydteson Street, Mont Brisard",
    5: "12A North Lydteson Road, Mont Brisard", 6: "12A North Lydteson Street, Saint Almond", 7: "Mont Brisard, Canada", 8: None, 9: "Opp. Clock Tower, Unit 9, #12A North Lydteson Str\nMont Brisard", 10: "",
}


def test_places(spark):
    fill = [(100 + i, f"{i} Quenuham Street, {t}, BR") for i in range(40) for t in ("Mont Brisard", "Saint Almond")]
    df = spark.createDataFrame([*ADDRESSES.items(), *[(k * 2 + j, a) for j, (k, a) in enumerate(fill)]], "lead_id bigint, address string").dropDuplicates(["lead_id"])
    got = {(r.a, r.b) for r in same_places(df).collect() if r.b < 100}
    assert got == {(1, 2), (1, 9), (2, 9)}
    assert same_places(df.limit(0)).count() == 0
    p = parsed(df.filter("lead_id = 9"), "lead_id", "address").first()
    assert (p.number, p.way, p.street, p.kind) == ("12a", "north", "lydteson", "street")


def test_places_do_not_depend_on_other_towns(spark):
    fill = [(100 + i, f"{i} Quenuham Street, {t}, BR") for i in range(40) for t in ("Mont Brisard", "Saint Almond")]
    more = [(1000 + i, f"{i % 50} Lydteson Street, Town {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ville, R{chr(97 + i % 7)}") for i in range(2000)]
    rows = [*ADDRESSES.items(), *[(k * 2 + j, a) for j, (k, a) in enumerate(fill)]]
    found = []
    for extra in ([], more):
        df = spark.createDataFrame(rows + extra, "lead_id bigint, address string").dropDuplicates(["lead_id"])
        found.append({(r.a, r.b) for r in same_places(df).collect() if r.b < 100})
    assert found[0] == found[1] == {(1, 2), (1, 9), (2, 9)}


def test_places_of_unknown_towns_share_their_rare_words(spark):
    rows = [(1, "5 Elmworth Street, Zorbville"), (2, "Shop 2, 5 Elmworth St, Zorbvile"), (3, "5 Elmworth Street, Quentham"), (4, "5 Elmwroth Street, Zorbville"), (5, "6 Elmworth Street, Zorbville"), (6, "5 Elmworth Street Zorbville Quarter"), (7, "7 Oakton Road, 123456"), (8, "7 Okton Rd 123456")]
    df = spark.createDataFrame(rows, "lead_id bigint, address string")
    assert {(r.a, r.b) for r in same_places(df).collect()} == {(1, 2), (1, 4), (1, 6), (2, 6), (4, 6), (7, 8)}  # (2, 4) has an error in either word
    member, pairs = place_classes(df)
    assert member.count() == 8 and set(member.columns) == {"id", "class"}


def test_names_of_towns_do_not_depend_on_repeated_rows_or_much_damage(spark):
    fill = [(1000 + i, f"{i} Quenuham Street, Saint Almond") for i in range(1, 120)]
    pair = [(1, "5 Elmworth Street, Saint Almond"), (2, "5 Elmworth St, Stt Almond")]
    damaged = [(2000 + i, f"{i} Birkmore Street, {t}") for i in range(1, 12) for t in ("Stt Almond", "Saint")]
    for rows in (fill + pair, [(k * 10_000 + i, a) for k in range(10) for i, a in fill + pair], fill + pair + [(i * 2 + j % 2, a) for j, (i, a) in enumerate(damaged)]):
        df = spark.createDataFrame(rows, "lead_id bigint, address string")
        assert {(r.a, r.b) for r in same_places(df).collect() if r.b < 1000} == {(1, 2)}


def test_thresholds(spark):
    level, true = np.array([3.0, 2.0, 1.0, 0.5]), np.array([True, True, False, False])
    assert best_threshold(level, true) == 1.5 and best_threshold(level[:0], true[:0]) == 0.0 and best_threshold(level, ~true | true) == 0.25


def test_thresholds_are_fitted_on_all_labels(spark):
    r = np.random.default_rng(3)
    subjects = Matcher().subjects[:3]
    rows = [(d, s, float(round(abs(r.normal()) + 0.8 * (d % 3 == k), 4))) for d in range(25_000) for k, s in enumerate(subjects) if (d + k) % 4]
    truth = [(d, subjects[d % 3].replace("_", " ").upper()) for d in range(24_000)] + [(30_000 + d, subjects[2]) for d in range(OWN_LABELS - 1)]
    found, labels = spark.createDataFrame(rows, "doc_id bigint, subject string, level double"), spark.createDataFrame(truth, "doc_id bigint, subject string")
    got = calibrate(found.repartition(7), labels)
    seen = [(s, lv, s == subjects[d % 3]) for d, s, lv in rows if d < 24_000]
    level_of = {(d, s) for d, s, _ in rows}
    missed = [s for d in range(24_000) if (d, s := subjects[d % 3]) not in level_of] + [subjects[2]] * (OWN_LABELS - 1)
    fit = lambda some: best_threshold(np.array([lv for s, lv, _ in seen if s in some]), np.array([t for s, _, t in seen if s in some]), sum(s in some for s in missed))
    assert got == {s: pytest.approx(fit({s} if s in subjects else set(subjects)), abs=1e-12) for s in Matcher().subjects}
    few = calibrate(found.filter("doc_id < 60"), labels.filter("doc_id < 60"))
    assert len(set(few.values())) == 1 and calibrate(found, labels.limit(0)) == dict.fromkeys(Matcher().subjects, 0.0)


def test_levels_are_those_a_fifth_of_sentences_reach(spark):
    docs = spark.createDataFrame([(1, "The boiler. See you. See you. See you. See you."), (2, "The boiler. " + "See you. " * 5), (3, "The boiler and the brakes. The boiler.")], "doc_id bigint, text string")
    hits = hits_of(docs)
    got = {(r.doc_id, r.subject) for r in levels(hits, np.ones(len(Matcher().rows))).collect()}
    assert got == {(1, "heating_cooling"), (3, "heating_cooling"), (3, "vehicles")}


def test_sentences_and_subjects(spark):
    assert sentences(None) == [] and sentences("  ") == []
    assert len(sentences("Health score 3/9\nHIGH: The tap dripped. How do you fix it? Slowly.\n[Home] [Cars] [Salon]")) == 2  # the question and its answer are one; the heading and the menu none
    m = Matcher()
    assert m.find_all(["that idea went down the drain.", "our neighbours do waxing.", "see you."]) == {}
    assert {k: [m.subjects[m.rows[r][1]] for r in rows] for k, rows in m.find_all(["see you.", "the boiler and the brakes."]).items()} == {1: ["heating_cooling", "vehicles"]}
    docs = [
        (1, "The tap dripped all night. We can rod the drain. Parking is behind the building."), (2, "That idea went down the drain. See you soon!"), (3, None), (4, ""), (5, '[{"text": "Los frenos chirriaban."}]'),
        (6, "See you. " * 9 + "The tap dripped."), (7, "DIE ZÄHNE REINIGEN. Haftungsklauseln."), (8, "<p>Nos dijeron que el embrague patinaba.</p>"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame([(1, "Plumbing"), (5, "vehicles"), (99, None)], "doc_id bigint, subject string")
    got = {(r.doc_id, r.subject) for r in assign_subjects(df, labels).collect()}
    assert got == {(1, "plumbing"), (5, "vehicles"), (7, "dental"), (7, "law_privacy"), (8, "vehicles")}
    assert assign_subjects(df.limit(0), labels).count() == 0 and assign_subjects(df.limit(0)).count() == 0
