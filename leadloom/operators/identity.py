"""De-duplication, anti-joins, upserts and sequences on identity keys.

Empty keys mean no key: such rows match nothing and are kept. Order is an explicit column; ties are broken by it alone, so it
should be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.shared import cut_lineage


def _keyed(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _spread(c: str, by: str) -> Column:
    """The key, and for rows without one a thousand keys that no row of the other side has: they aren't sent to one task."""
    return F.when(_keyed(c), F.col(c).cast("string")).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64(by), F.lit(1000))))


def first_by_keys(df: DataFrame, keys: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """Rows that aren't preceded (followed, for ``keep='last'``) by one with the same value in any of the keys.

    Each key is settled by a partial aggregation to its first row and a join back, so a value that a third of the rows hold makes
    no large group. Dropped rows still count for their other keys.
    """
    pick = F.min if keep == "first" else F.max
    out = df
    for k in keys:
        best = df.filter(_keyed(k)).groupBy(F.col(k).cast("string").alias(f"_{k}")).agg(pick(order).alias("_best"))
        out = out.join(best, _spread(k, order) == F.col(f"_{k}"), "left").filter(F.col("_best").isNull() | (F.col("_best") == F.col(order))).drop(f"_{k}", "_best")
    return out


def without(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows none of whose keys occurs in ``known`` (columns of the same names)."""
    out = df
    for k in keys:
        values = known.filter(_keyed(k)).select(F.col(k).alias(f"_{k}")).distinct()
        out = out.join(values, F.col(k) == F.col(f"_{k}"), "left_anti")
    return out


def greedy_distinct(df: DataFrame, tokens: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """First come, first kept: a row stays if no kept row before it, nor one in ``taken`` (column token), shares a token.

    Only kept rows count, so windows can't tell. In rounds: a row that is the first undecided one of all its tokens is kept, and
    all rows that share a token with it go. The rounds end when nothing is undecided; each is a few aggregations on tokens.
    Rows without tokens are kept.
    """
    rows = df.select(F.col(order).alias("_o"), F.explode(F.array_distinct(tokens)).alias("token")).filter("token is not null and token <> ''")
    if taken is not None:
        hit = rows.join(taken.select("token").distinct(), "token", "left_semi").select("_o").distinct()
        dropped = cut_lineage(hit)
        left = cut_lineage(rows.join(dropped, "_o", "left_anti"))
    else:
        dropped, left = cut_lineage(rows.select("_o").limit(0)), cut_lineage(rows)
    while not left.isEmpty():
        first = left.groupBy("token").agg(F.min("_o").alias("first"))
        marked = left.join(first, "token")
        kept = marked.groupBy("_o").agg(F.bool_and(F.col("first") == F.col("_o")).alias("all")).filter("all").select("_o")
        used = left.join(kept, "_o", "left_semi").select("token").distinct()
        gone = left.join(used, "token", "left_semi").select("_o").distinct().join(kept, "_o", "left_anti")
        gone = cut_lineage(gone)
        dropped = cut_lineage(dropped.unionByName(gone))
        left = cut_lineage(left.join(kept, "_o", "left_anti").join(gone, "_o", "left_anti"))
    return df.join(dropped, F.col(order) == F.col("_o"), "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str, keep_columns: Sequence[str], first_column: str, stamp: Column) -> DataFrame:
    """New rows replace existing ones of the same key (the first key that meets, in the order given).

    The replaced row hands on ``keep_columns`` (filled by hand) where the new one has none, and ``first_column`` (when it was
    first seen); new rows come behind all others; columns of either side stay. Among existing rows with one key the last counts.
    """
    handed = [*keep_columns, first_column]
    # One row is met: by the first key that meets, the last of its rows. Names of our own can't clash with a user's.
    own = lambda name: f"__upsert_{name}"
    merged = new
    for i, k in enumerate(keys):
        last = existing.filter(_keyed(k)).groupBy(F.col(k).alias(own(f"key{i}"))).agg(F.max_by(F.struct(*handed), order).alias(own(f"row{i}")))
        merged = merged.join(last, F.col(k) == F.col(own(f"key{i}")), "left").drop(own(f"key{i}"))
    merged = merged.withColumn(own("met"), F.coalesce(*[F.col(own(f"row{i}")) for i in range(len(keys))])).drop(*[own(f"row{i}") for i in range(len(keys))])
    for c in keep_columns:
        mine = [F.nullif(F.col(c).cast("string"), F.lit(""))] if c in new.columns else []
        merged = merged.withColumn(c, F.coalesce(*mine, F.col(own("met"))[c]))
    first = F.col(own("met"))[first_column]
    merged = merged.withColumn(first_column, F.coalesce(F.nullif(F.trim(first.cast("string")), F.lit("")).cast(existing.schema[first_column].dataType), stamp)).drop(own("met")).withColumn("_new", F.lit(1))
    both = existing.withColumn("_new", F.lit(0)).unionByName(merged, allowMissingColumns=True)
    both = both.withColumn("_at", F.struct("_new", order))
    return first_by_keys(both, keys, "_at", keep="last").drop("_new", "_at")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds a number from 1 in the given order, by range partitions and their sizes, not in one task."""
    parts = cut_lineage(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_from"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return parts.join(F.broadcast(before.drop("_n")), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_from") + 1).drop("_p", "_i", "_from", "_before")


def next_ids(df: DataFrame, current: DataFrame, id_column: str, order: str) -> DataFrame:
    """Ids that go on from the largest valid one, in order. Rows are numbered by range partitions and their sizes, not in one
    task."""
    top = current.select(F.coalesce(F.max(F.col(id_column).try_cast("int")), F.lit(0)).alias("_top"))
    rows = numbered(df, order, "_place")
    return rows.crossJoin(F.broadcast(top)).withColumn(id_column, (F.col("_top") + F.col("_place")).cast("int")).drop("_place", "_top")  # one row beside


def runs(df: DataFrame, order: str, value: str, group: str) -> DataFrame:
    """Numbers the runs of equal adjacent values within each group: a change flag and its running sum."""
    w = Window.partitionBy(group).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")
