"""CSV files as spreadsheets and scrapers write them: byte order marks, untidy headers, blank rows, and listings that lie on their side.

All columns are text; ``_ord`` counts rows from 0 in the order of the file. One file is read by one task, as quoted cells may hold
line breaks; folders of files are read side by side, each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.functions import text as T

MARK = "﻿"
#: What the columns of a master table and of a ledger of contacted businesses are at least.
MASTER = ("cid", "link", "added_at", "last_seen_at", "status", "notes", "contacted_date")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getContentSummary(where).getLength() > 0


def read_text(spark: SparkSession, path: str, empty_is_null: bool = True) -> DataFrame:
    """All cells as text, in order; only '' is null, or nothing is. A byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, emptyValue="", nullValue="", encoding="UTF-8")
    names = [c.replace(MARK, "").strip('"') if i == 0 else c for i, c in enumerate(df.columns)]
    df = df.toDF(*names)
    cell = lambda c: F.nullif(F.col(f"`{c}`"), F.lit("")) if empty_is_null else F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return df.select(*[cell(c).alias(c) for c in names]).withColumn("_ord", F.monotonically_increasing_id())


def _renumbered(df: DataFrame) -> DataFrame:
    """_ord from 0 without gaps: the rows of one file, which is one task's anyway."""
    return df.withColumn("_ord", F.row_number().over(Window.orderBy("_ord")) - 1)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """Names trimmed, rows without any value dropped, the rest counted anew."""
    df = read_text(spark, path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return _renumbered(df.na.drop("all", subset=[c for c in df.columns if c != "_ord"]))


def criteria_row(df: DataFrame, number: int) -> dict[str, str | None]:
    """The row of a number from 1; an error where there is none."""
    found = df.filter(F.col("_ord") == number - 1).limit(1).collect()
    if not found:
        raise ValueError(f"out of range: row {number} of {df.count()}")
    return {k: v for k, v in found[0].asDict().items() if k != "_ord"}


def is_on_its_side(df: DataFrame) -> bool:
    """A listing whose first column is named Column and holds C1, C2, ... only, no input_id."""
    names = [c for c in df.columns if c != "_ord"]
    if len(names) < 2 or names[0].strip().lower() != "column":
        return False
    first = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
    return not df.isEmpty() and df.filter(~first.rlike(r"^C\d+$")).isEmpty()


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """A listing with a row for each business. One that lies on its side is turned: its value columns are cut into runs of equal
    adjacent input_id, the first column of a run is the business, runs without an id are padding. Without an input_id row it
    stays as it is."""
    df = read_text(spark, path)
    if not is_on_its_side(df):
        return df
    names = [c for c in df.columns if c != "_ord"]
    cells = df.select(F.col(f"`{names[1]}`").alias("field"), F.col("_ord").alias("line"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in names[2:]])).alias("at", "value"))
    fields = [r.field for r in df.select(F.col(f"`{names[1]}`").alias("field"), "_ord").orderBy("_ord").collect()]  # a line for each column of a listing
    if "input_id" not in fields:
        return df
    ids = cells.filter(F.col("line") == fields.index("input_id")).select("at", F.trim(F.coalesce("value", F.lit(""))).alias("id"))
    starts = ids.withColumn("before", F.lag("id").over(Window.orderBy("at"))).filter((F.col("id") != "") & ~F.col("before").eqNullSafe(F.col("id"))).select("at")  # of one file's columns
    kept = list(dict.fromkeys(f for f in fields if f))
    turned = cells.join(F.broadcast(starts), "at").groupBy("at").pivot("field", kept).agg(F.last("value"))  # at most a column for each of the file's
    return _renumbered(turned.select(*[F.col(f"`{f}`") for f in kept], F.col("at").alias("_ord")))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A master table; a missing or empty file gives an empty one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in MASTER) + ", _ord bigint")
    return read_text(spark, path)


def read_contacted(spark: SparkSession, path: str) -> DataFrame | None:
    """(cid, business_name) in their compared form, each once; None without a file."""
    if not _exists(spark, path):
        return None
    df = read_text(spark, path)
    column = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(T.normalize_cid(column("cid")).alias("cid"), T.norm_name(column("business_name")).alias("business_name")).filter("cid <> '' or business_name <> ''").distinct()


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Rows as they are, '' for empty cells."""
    return read_text(spark, path, empty_is_null=False)


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    """Names in lower case with underscores, cells trimmed, '' for empty ones; a missing file gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "_ord bigint")
    df = read_leads(spark, path)
    tidy = {}
    for c in df.columns:  # of columns that become one the last counts
        tidy[c.strip().lower().replace(" ", "_")] = c
    return df.select(*[(F.trim(f"`{c}`") if n != "_ord" else F.col(c)).alias(n) for n, c in tidy.items()])
