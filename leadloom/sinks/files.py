"""Files for people and programs that want one: CSV put in place at once, ledgers appended to, JSON, and a database of leads.

Results that are one file are written by one task and never pass through the driver, except into a local database.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from leadloom.functions.text import printable, truncate_cell


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def encoded(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns in a fixed order, null for those that are missing; lists, maps and structs as JSON."""

    def one(c: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast("string").alias(c)
        nested = isinstance(df.schema[c].dataType, ArrayType | MapType | StructType)
        return (F.to_json(f"`{c}`") if nested else F.col(f"`{c}`").cast("string")).alias(c)

    return df.select(*map(one, columns or df.columns))


def cells(df: DataFrame) -> DataFrame:
    """Text columns as spreadsheet cells hold them: no control characters, not over the longest cell."""
    return df.select(*[truncate_cell(printable(F.col(f"`{c}`"))).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: str | None = None, mark: bool = False) -> None:
    """One CSV file, written beside its place and then put there: readers meet the old file or the new one. What is written may be
    read from that same file. ``order``: a column to sort by; ``mark``: a byte order mark before the first name."""
    spark = df.sparkSession
    files, place = _files(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    rows = (df.coalesce(1).sortWithinPartitions(order) if order else df.coalesce(1))
    if mark:
        first = df.columns[0]
        rows = rows.withColumnRenamed(first, "﻿" + first)
    rows.write.csv(aside, header=True, escape='"', quoteAll=False, emptyValue="")
    _, folder = _files(spark, aside)
    made = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
    if made:
        files.delete(place, False)
        if not files.rename(made[0], place):
            raise OSError(f"{path} couldn't be put in place")
    files.delete(folder, True)


def append_csv(df: DataFrame, folder: str, columns: Sequence[str], order: str) -> None:
    """Appends rows to a ledger: a folder of CSV files, each with the header; missing columns are ''. Rows stay in order."""
    found = [(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns]
    df.coalesce(1).sortWithinPartitions(order).select(*found).write.mode("append").csv(folder, header=True, escape='"')


def write_two(df: DataFrame, wanted: Column, all_path: str, short_path: str, columns: Sequence[str], short_columns: Sequence[str], order: str) -> None:
    """All rows in one file and those that are wanted in another, with their own columns."""
    from leadloom.shared import cut_lineage

    rows = cut_lineage(df)  # computed once for both
    write_csv(encoded(rows, [*columns, order] if order not in columns else columns), all_path, order)
    write_csv(encoded(rows.filter(wanted), [*short_columns, order] if order not in short_columns else short_columns), short_path, order)


def latest(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key: a new one takes the place of the existing one of its key; missing columns are null."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_sqlite(df: DataFrame, path: str, table: str, key: str, batch: int = 1000) -> int:
    """Inserts or replaces rows by key in a local database, made if it isn't there; all columns are text. Rows come to the driver
    in batches, one partition at a time, as one file can have one writer. Gives the number of rows."""
    name = lambda c: '"' + c.replace('"', '""') + '"'
    rows, n, total = encoded(df), [], 0
    con = sqlite3.connect(path)
    try:
        con.execute(f"CREATE TABLE IF NOT EXISTS {name(table)} ({', '.join(name(c) + ' TEXT' + (' PRIMARY KEY' if c == key else '') for c in rows.columns)})")
        insert = f"INSERT OR REPLACE INTO {name(table)} ({', '.join(map(name, rows.columns))}) VALUES ({', '.join('?' * len(rows.columns))})"
        for row in rows.toLocalIterator():
            n.append(tuple(row))
            if len(n) == batch:
                con.executemany(insert, n)
                total, n = total + len(n), []
        con.executemany(insert, n)
        con.commit()
    finally:
        con.close()
    return total + len(n)


def write_reports(df: DataFrame, folder: str) -> None:
    """A JSON object for each row, nested as it is, in as many files as the table has partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def mail_body(message: Column) -> Column:
    """A message as the body of a mail: line breaks as tags."""
    return F.regexp_replace(message, "\n", "<br>")


def picture(data_url: Column) -> Column:
    """The bytes of a picture in a data address, null for what is none."""
    return F.when(data_url.rlike("^data:image/[a-z]+;base64,"), F.unbase64(F.substring_index(data_url, ",", -1)))
