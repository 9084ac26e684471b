import pytest
from pyspark.sql import functions as F

from leadloom.functions import contact as C
from leadloom.functions import text as T
from leadloom.functions import url as U


def value(spark, expression, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


CASES = [
    (U.clean_url, ("https://a.example/x?utm_source=1&id=2&gclid=3#top",), "https://a.example/x?id=2"), (U.clean_url, ("https://a.example/?UTM_x",), "https://a.example/"), (U.clean_url, (None,), None),
    (U.link_identity, ("HTTPS://A.Example/Path//?q#f",), "https://a.example/Path"), (U.link_identity, (" Foo ",), "foo"), (U.link_identity, (None,), ""),
    (U.normalize_url, (' "a.example" ',), "https://a.example"), (U.normalize_url, (None,), ""), (U.domain_key, ("http://www.A.example:8080/x",), "a.example:8080"),
    (U.sheet_domain_key, ('=HYPERLINK("x")',), ""), (U.sheet_domain_key, ("www.a.example?x",), "a.example"), (U.host_key, ("WWW.a.example",), "a.example"),
    (U.name_from_maps_url, ("https://m.example/maps/place/Joe%27s+Bar/@1",), "Joe's Bar"), (U.url_variants, ("https://a.example",), ["https://a.example", "https://www.a.example", "http://a.example"]),
    (U.meta_refresh_target, ('<meta http-equiv="refresh" content="0; url=/home">',), "/home"),
    (C.phone_last10, ("+91 98765 43210",), "9876543210"), (C.phone_last10, ("12345",), ""), (C.phone_last8, ("0044 20 7946 0958",), "79460958"), (C.phone_plain, ("(01) 23-4",), "01234"),
    (C.to_e164, ("098765 43210", "IN"), "+919876543210"), (C.to_e164, ("+44 20 7946 0958", None), "+442079460958"), (C.to_e164, ("12", "IN"), ""), (C.to_e164, (None, "IN"), ""),
    (C.to_e164_india, ("09876543210",), "+919876543210"), (C.to_e164_india, ("123",), None), (C.phone_region, (" UK ",), "GB"), (C.phone_region, ("x",), None),
    (C.emails_in_text, ("A@b.com, a@B.com x@y.org",), ["a@b.com", "x@y.org"]), (C.is_junk_email, ("logo@2x.png",), True), (C.is_junk_email, ("joe@shop.co",), False), (C.is_junk_email, ("a@0.22.0-x.fb",), True),
    (C.is_valid_email, ("a@b.co",), True), (C.is_valid_email, (None,), False), (C.phones_in_text, ("call +44 20 7946 0958 not 1.2.3.4",), ["+44 20 7946 0958"]),
    (T.number, ("1,234.5",), 1234.5), (T.number, ("nan",), None), (T.number, ("x",), None), (T.whole, ("25.0",), 25), (T.whole, ("",), None), (T.tri_state, ("Yes",), True), (T.tri_state, ("?",), None),
    (T.normalize_cid, ("123.0",), "123"), (T.normalize_cid, ("NaN",), ""), (T.chain_key, ("Joe's Gym - North",), "joe s gym"), (T.chain_key, ("A–B | C",), "a b"), (T.brand_key, ("The Iron House (North) Gym",), "iron house"),
    (T.brand_key, ("Gym",), ""), (T.display_name, ("IRON HOUSE LTD",), "Iron House Ltd"), (T.display_name, ("Iron HOUSE of X",), "Iron HOUSE of X"), (T.pincode, ("Street, City 600037",), "600037"),
    (lambda a: T.area_before_city(a, F.lit("Chennai")), ("1 Main Rd, Korattur, Chennai, Tamil Nadu 600050",), "Korattur"), (T.area_from_address, ("1 Main Rd, Korattur, Chennai, Tamil Nadu 600050",), "Korattur"),
    (T.area_from_address, ("12 Road, near x",), None), (T.area_from_address, (None,), None), (T.safe_text, ("=1+1",), "'=1+1"), (T.finalize_cell, ("https://a.example",), '=HYPERLINK("https://a.example","Open")'),
    (lambda c: T.shorten(c, 20), ("One two three. Four five six seven",), "One two three. ..."), (lambda c: T.shorten(c, 20), ("short",), "short"), (lambda c: T.truncate_cell(c, 3), ("abcd",), "abc ...[TRUNCATED]"),
    (lambda c: T.top_issues(T.parse_issues(c)), ("low: a; HIGH: b; c",), "HIGH: b; MEDIUM: c; LOW: a"), (T.error_label, ("HTTPSConnectionPool: Read timed out",), "Timeout"), (T.error_label, ("odd",), "Other error"),
    (lambda c: T.has_word(c, ["gym"]), ("Big-Gym x",), True), (lambda c: T.has_word(c, ["gym"]), ("gymnast",), False), (T.category_tokens, ("A/B, c",), ["a", "a/b", "a/b, c", "b", "c"]),
    (T.has_value, ("N/A",), False), (T.has_value, (None,), False), (T.norm_name, ("  A   b ",), "a b"),
]


@pytest.mark.parametrize(("expression", "args", "found"), CASES, ids=[str(i) for i in range(len(CASES))])
def test_expression(spark, expression, args, found):
    assert value(spark, expression, *args) == found


def test_variant_is_the_hash_modulo_three(spark):
    import hashlib

    for i in range(20):
        h = hashlib.md5(str(i).encode()).hexdigest()
        assert value(spark, T.variant, h) == int(h, 16) % 3
