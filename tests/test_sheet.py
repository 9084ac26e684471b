from leadloom.operators.sheet import plan_header, plan_sheet

WANTED = ("Business Name", "Website", "Phone", "Email", "Priority")


def test_headers():
    assert plan_header(None, WANTED, True).is_new
    same = plan_header([*WANTED, "Notes"], WANTED, False)
    assert same.names == (*WANTED, "Notes") and not same.migrated and same.places["Notes"] == 5
    lost = plan_header(["", None], WANTED, False)
    assert lost.migrated and lost.first_row_is_data and lost.places == {"Business Name": 0, "Website": 1}
    moved = plan_header(["Phone", "Own", "Business Name", "Own", ""], WANTED, False)
    assert moved.migrated and moved.names == (*WANTED, "Own") and moved.places == {"Phone": 0, "Business Name": 2, "Own": 1}


def test_rows(spark):
    sheet = spark.createDataFrame([(0, "Phone", "Own", "Business Name"), (1, "+1 555 0100", "n1", "A"), (2, "", "n2", "B")], "_ord int, a string, b string, c string")
    new = [(0, "A2", "a.example", "1 (555) 01-00", "", "HOT"), (1, "b", "", "", "x", "COLD"), (2, "C", "c.example", "", "", "COLD"), (3, "D", "www.c.example/x", "", "", "HOT"), (4, "E", "", "", "e@e.example", "")]
    df = spark.createDataFrame(new, "_ord int, `Business Name` string, Website string, Phone string, Email string, Priority string")
    header, existing, fresh = plan_sheet(sheet, df, WANTED)
    assert [(r["Business Name"], r["Own"], r["Website"]) for r in existing.orderBy("_ord").collect()] == [("A", "n1", ""), ("B", "n2", "")]
    assert [r["Business Name"] for r in fresh.orderBy("_ord").collect()] == ["D", "E"]  # A2 has A's phone, b is B, C comes behind D
    assert plan_sheet(sheet.limit(0), df, WANTED)[2].count() == 4
