import http.server
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from leadloom.sinks import files as S
from leadloom.sources import connectors as N
from leadloom.sources import csv as C
from leadloom.streaming import leads as L


def put(path, text):
    path.write_bytes(text.encode("utf-8"))
    return f"file://{path}"


def test_criteria_with_mark_and_blank_rows(spark, tmp_path):
    df = C.read_criteria(spark, put(tmp_path / "c.csv", '﻿ country ,keywords\r\nIndia,"gym; ""spa"""\r\n,\r\nUAE,"two\nlines"\r\n'))
    assert df.columns == ["country", "keywords", "_ord"]
    assert C.criteria_row(df, 1) == {"country": "India", "keywords": 'gym; "spa"'}
    assert C.criteria_row(df, 2) == {"country": "UAE", "keywords": "two\nlines"}
    for n in (0, 3):
        with pytest.raises(ValueError, match="out of range"):
            C.criteria_row(df, n)


def test_text_and_tidy(spark, tmp_path):
    path = put(tmp_path / "l.csv", "﻿Business Name, Phone ,cid\nA,007,\nNA,,nan\n")
    assert [tuple(r)[:3] for r in C.read_text(spark, path).orderBy("_ord").collect()] == [("A", "007", None), ("NA", None, "nan")]
    assert [tuple(r)[:3] for r in C.read_leads(spark, path).orderBy("_ord").collect()] == [("A", "007", ""), ("NA", "", "nan")]
    tidy = C.read_tidy(spark, path)
    assert tidy.columns[:3] == ["business_name", "phone", "cid"]
    assert C.read_tidy(spark, f"{path}.none").count() == 0 and C.read_master(spark, f"{path}.none").count() == 0 and C.read_contacted(spark, f"{path}.none") is None
    contacted = C.read_contacted(spark, put(tmp_path / "k.csv", "cid,business_name\n12.0,\n,Joe's  Gym\n12,\nnan,\n"))
    assert {tuple(r) for r in contacted.collect()} == {("12", ""), ("", "joe's gym")}


def test_listing_on_its_side(spark, tmp_path):
    text = 'Column,field,v1,v2,v3,v4,v5\nC1,input_id,a,a,,b,a\nC2,title,First,again,pad,"Second, Ltd",Third\nC3,link,l1,,,l2,l3\n'
    df = C.read_listing(spark, put(tmp_path / "t.csv", text))
    assert [tuple(r) for r in df.orderBy("_ord").collect()] == [("a", "First", "l1", 0), ("b", "Second, Ltd", "l2", 1), ("a", "Third", "l3", 2)]
    plain = C.read_listing(spark, put(tmp_path / "p.csv", "input_id,title\n1,A\n"))
    assert plain.columns == ["input_id", "title", "_ord"] and plain.count() == 1
    lost = C.read_listing(spark, put(tmp_path / "q.csv", "Column,field,v1\nC1,title,A\n"))
    assert lost.columns[0] == "Column"


def test_csv_is_put_in_place_over_its_own_input(spark, tmp_path):
    path = put(tmp_path / "m.csv", 'a,b\n2,"x, ""y"""\n1,"two\nlines"\n')
    df = C.read_text(spark, path)
    from leadloom.shared import cut_lineage

    S.write_csv(cut_lineage(df).withColumn("c", F.lit("new")).drop("_ord"), path, order="a", mark=True)
    assert (tmp_path / "m.csv").read_bytes().startswith("﻿".encode())
    assert [tuple(r)[:3] for r in C.read_text(spark, path).orderBy("_ord").collect()] == [("1", "two\nlines", "new"), ("2", 'x, "y"', "new")]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["m.csv"]


def test_ledger_two_files_and_nested(spark, tmp_path):
    df = spark.createDataFrame([(2, "B", ["x"], {"k": "v"}), (1, "A", [], None)], "n int, name string, l array<string>, m map<string,string>")
    folder = f"file://{tmp_path}/ledger"
    S.append_csv(df, folder, ["name", "n", "gone"], "n")
    S.append_csv(df.filter("n = 1"), folder, ["name", "n", "gone"], "n")
    assert sorted(tuple(r) for r in spark.read.csv(folder, header=True).select("name", "n").collect()) == [("A", "1"), ("A", "1"), ("B", "2")]
    S.write_two(df, F.col("n") == 1, f"file://{tmp_path}/all.csv", f"file://{tmp_path}/short.csv", ["n", "l", "m", "none"], ["name"], "n")
    rows = C.read_text(spark, f"file://{tmp_path}/all.csv").orderBy("_ord").collect()
    assert [(r.n, r.l, r.m, r.none) for r in rows] == [("1", "[]", None, None), ("2", '["x"]', '{"k":"v"}', None)]
    assert C.read_text(spark, f"file://{tmp_path}/short.csv").first().name == "A"


def test_sqlite_and_latest(spark, tmp_path):
    one = spark.createDataFrame([("1", "a", [1]), ("2", "b", None)], "id string, v string, l array<int>")
    two = spark.createDataFrame([("2", "c", [2])], "id string, v string, l array<int>")
    path = str(tmp_path / "leads.db")
    assert S.upsert_sqlite(one, path, "leads", "id") == 2 and S.upsert_sqlite(two, path, "leads", "id", batch=1) == 1
    assert sorted(sqlite3.connect(path).execute("SELECT * FROM leads")) == [("1", "a", "[1]"), ("2", "c", "[2]")]
    assert sorted((r.id, r.v) for r in S.latest(one, two, "id").collect()) == [("1", "a"), ("2", "c")]
    S.write_reports(one, f"file://{tmp_path}/reports")
    assert spark.read.json(f"file://{tmp_path}/reports").count() == 2
    r = spark.range(1).select(S.mail_body(F.lit("a\nb")).alias("m"), S.picture(F.lit("data:image/png;base64,aGk=")).alias("p"), S.picture(F.lit("x")).alias("q")).first()
    assert (r.m, bytes(r.p), r.q) == ("a<br>b", b"hi", None)
    assert S.cells(spark.createDataFrame([("a\x01b", 1)], "t string, n int")).first().t == "ab"


class Site(http.server.BaseHTTPRequestHandler):
    tries = 0

    def do_GET(self):
        code, body = {"/": (200, "<p>hello</p>"), "/robots.txt": (200, f"Sitemap: http://127.0.0.1:{self.server.server_port}/map.xml"), "/map.xml": (200, "x")}.get(self.path, (404, ""))
        if self.path == "/shaky":
            Site.tries += 1
            code, body = (503, "") if Site.tries < 3 else (200, "at last")
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_connectors(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(1, f"{base}/"), (2, f"{base}/gone"), (3, f"{base}/shaky"), (4, None), (5, "http://127.0.0.1:9/"), (6, f"{base}/")], "id int, url string")
    got = {r.id: r.page for r in N.probe(df, "url", N.fetch_pages(timeout=3, pause=0.01), N.PAGE, "page").collect()}
    assert (got[1].status, got[1].html) == (200, "<p>hello</p>") == (got[6].status, got[6].html)
    assert got[2].error == "HTTP 404" and got[3].html == "at last" and got[4] is None and got[5].status is None and got[5].error
    site = N.probe(df.filter("id = 1"), "url", N.site_files(3), N.SITE, "site").first().site
    assert (site.robots, site.sitemap, site.favicon, site.redirects) == (True, True, False, None)
    bad = N.probe(spark.createDataFrame([("127.0.0.1:9",)], "host string"), "host", N.certificates(1), N.CERTIFICATE, "c").first().c
    assert bad.valid is False and bad.error
    server.shutdown()
    mails = spark.createDataFrame([("a@ok.example",), ("b@no.example",), ("c@lost.example",), ("nothing",), (None,)], "email string")
    said = {r.email: r.v for r in N.deliverable(mails, "email", {"ok.example": True, "no.example": False}.get, "v").collect()}
    assert said == {"a@ok.example": "mx_ok", "b@no.example": "no_mx", "c@lost.example": "mx_unknown", "nothing": "invalid_format", None: "invalid_format"}


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a", "2026-01-01 00:00:00"), (1, "b", "2026-01-01 00:01:00"), (2, "c", "2026-01-01 00:02:00")], "id int, v string, t string").coalesce(1).write.json(source)
    stream = spark.readStream.schema("id int, v string, t timestamp").json(source)
    L.to_ledger(L.first_leads(stream, "id", "t"), f"{tmp_path}/ledger", ["id"], "id", f"{tmp_path}/ck1").awaitTermination()
    assert sorted(r.id for r in spark.read.csv(f"{tmp_path}/ledger", header=True).collect()) == ["1", "2"]
    L.to_master(stream, f"{tmp_path}/master", "id", f"{tmp_path}/ck2").awaitTermination()
    spark.createDataFrame([(2, "new", "2026-01-02 00:00:00")], "id int, v string, t string").coalesce(1).write.mode("append").json(source)
    L.to_master(stream, f"{tmp_path}/master", "id", f"{tmp_path}/ck2").awaitTermination()
    assert {(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/master/1").collect() if r.id == 2} == {(2, "new")}
