from pyspark.sql import functions as F

from leadloom.functions import page as P

HTML = """<html><head><title> Joe's Bar </title><meta name="description" content="Good"><meta name="viewport" content="x"><meta property="og:title" content="T">
<link rel="shortcut icon" href="/f.ico"><script type="application/ld+json">{"@type": "Store"}</script><style>p {}</style></head><body><h1>Hi</h1><p>One <b>two</b></p>
<img src="http://x.example/a.png"><img alt="b"><a href="/about#x">a</a><a href="/about">b</a><a href="https://www.joe.example/c">c</a><a href="tel:+1">t</a><a href="https://facelink.example/joe?ref=1">f</a>
<form action="/search"><input name="q"></form><form><input type="email" name="mail"><textarea></textarea></form></body></html>"""


def test_facts_and_rules(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<a href=x <p>broken"), (4, "<div>" * 400 + "x")], "id int, html string").withColumn("f", P.page_facts("html"))
    rows = {r.id: r for r in df.select("id", "f", P.internal_links(F.col("f.hrefs"), F.lit("joe.example")).alias("own"), P.social_links(F.col("f.hrefs"), ("facelink.example",)).alias("social"),
                                       F.size(P.lead_forms(F.col("f.forms"))).alias("forms"), P.js_shell(F.col("html"), F.col("f")).alias("shell"), P.mixed_content(F.col("html")).alias("mixed")).collect()}
    f = rows[1].f
    assert (f.title, f.h1_count, f.img_total, f.img_missing_alt, f.meta_description, f.has_viewport, f.has_canonical, f.og_title, f.icon_link) == ("Joe's Bar", 1, 2, 1, "Good", True, False, "T", True)
    assert f.text.split()[-6:] == ["two", "a", "b", "c", "t", "f"] and f.jsonld == ['{"@type": "Store"}']
    assert rows[1].own == ["/about", "https://www.joe.example/c"] and rows[1].social == ["https://facelink.example/joe"] and rows[1].forms == 1 and rows[1].mixed == 1
    assert rows[2].f.title is None and rows[2].f.hrefs == [] and rows[4].shell and not rows[1].shell


def test_filters_pass_below_the_parser(spark):
    df = spark.createDataFrame([(1, "x")], "id int, html string").withColumn("f", P.page_facts("html")).filter("id = 2")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter") if "Filter" in plan else True
