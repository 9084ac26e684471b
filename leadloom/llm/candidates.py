"""Candidate pairs from block tables: those that share a block and have fingerprints near each other, whatever the size of the block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.business import BITS, LANES, MAILBOX, PHONE, close_fingerprints, entries, equal_lanes, hashed_lane, lane_sql, lanes_there, own_lanes, within_distance
from leadloom.shared import cut_lineage

#: Blocks of more entries are not joined at once: they are split (pairs_between) or gone through in steps (first_in_hot). This
#: changes the work, not the result.
HOT = 200
#: Each step through a hot block takes so many times the entries of the step before.
GROWTH = 4


def hot_blocks(some: DataFrame, most: int = HOT) -> DataFrame:
    return some.groupBy("block").count().filter(F.col("count") > most).select("block")


def sided(some: DataFrame, side: str) -> DataFrame:
    """Entries with id, lo and hi named for their side of a pair."""
    return some.select("block", F.col("id").alias(side), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"))


def _others(mask: Column) -> Column:
    """Of lanes as bits, those that the block doesn't imply."""
    return mask.bitwiseAND(F.bitwise_not(own_lanes(F.col("block"))))


def _within_hot(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): the pairs of hot blocks with close fingerprints, without going through the other pairs.

    They have a further lane in common, besides the block's own two, and are joined on the first such; or they have none, and are
    close because at most two other lanes are there to differ, or as the block is a whole phone or mailbox. These are joined on
    the lanes that are there.
    """
    parts = lambda side: F.explode(F.array_compact(F.array(*[F.when((F.expr(lane_sql(k, f"{side}_")) != 0) & (_others(F.lit(1 << k)) != 0), F.expr(lane_sql(k, f"{side}_")).bitwiseOR(k << BITS)) for k in range(len(LANES))]))).alias("part")
    x, y = sided(left, "a"), sided(right, "b")
    shared = _others(equal_lanes())
    first = shared.bitwiseAND(-shared) == F.call_function("shiftleft", F.lit(1), F.shiftright("part", BITS).cast("int"))
    third = x.select("*", parts("a")).join(y.select("*", parts("b")), ["block", "part"]).filter(first).select("a", "b")
    x, y = x.withColumn("a_there", lanes_there("a_")), y.withColumn("b_there", lanes_there("b_"))
    whole = own_lanes(F.col("block")).isin(PHONE, MAILBOX)
    few = x.join(y.select("block", "b_there").distinct(), "block").filter(whole | (F.bit_count(_others(F.col("a_there").bitwiseAND(F.col("b_there")))) <= 2))
    none = few.join(y, ["block", "b_there"]).filter(shared == 0).select("a", "b")
    return third.unionByName(none)


def pairs_between(left: DataFrame, right: DataFrame, most: int = HOT) -> DataFrame:
    """(a, b): records of two tables that share a block and have close fingerprints, each pair once. ``most`` doesn't change the
    result."""
    x, y = cut_lineage(entries(left, hashed_lane)), cut_lineage(entries(right, hashed_lane))
    # Only blocks of both sides matter; the smaller side's say which.
    hot = cut_lineage(hot_blocks(x.select("block").unionByName(y.select("block")), most))
    crowded = not hot.isEmpty()
    p, q = (x.join(hot, "block", "left_anti"), y.join(hot, "block", "left_anti")) if crowded else (x, y)
    out = sided(p, "a").join(sided(q, "b"), "block").filter(close_fingerprints()).select("a", "b")
    if crowded:
        out = out.unionByName(_within_hot(x.join(hot, "block", "left_semi"), y.join(hot, "block", "left_semi")))
    return out.distinct()


def ranked(some: DataFrame) -> DataFrame:
    """Adds rank: the place of each entry in its block by id. Numbered by range partitions and their counts, so that a hot block is
    no single task's."""
    parts = some.repartitionByRange("block", "id").sortWithinPartitions("block", "id")
    parts = cut_lineage(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = parts.groupBy("block", "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_from"))  # one row per block and partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("block").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(counts.withColumn("_before", before), ["block", "_p"]).withColumn("rank", F.col("_before") + F.col("_i") - F.col("_from") + 1).drop("_p", "_i", "_n", "_from", "_before")


def first_in_hot(x: DataFrame, y: DataFrame, judge, step: int = HOT) -> DataFrame:
    """(a, b): for each entry of y the first of the entries x of its hot block, of smaller id, that ``judge`` accepts.

    Blocks are gone through in the order of ids, a growing step at a time. A record leaves a block when that has no earlier record
    than the first it matched; one that matches none meets the whole block. judge: (a, b) -> the accepted (a, b).
    """
    order = cut_lineage(ranked(x))
    left, done, best = sided(y, "b"), 0, None
    while True:
        some = sided(order.filter((F.col("rank") > done) & (F.col("rank") <= done + step)), "a")
        bound = left if best is not None else left.withColumn("most_a", F.col("b"))
        met = some.join(bound, "block").filter((F.col("a") < F.col("most_a")) & within_distance())
        found = judge(cut_lineage(met.select("a", "b").distinct()))
        best = cut_lineage((found if best is None else best.unionByName(found)).groupBy("b").agg(F.min("a").alias("a")))
        done, step = done + step, step * GROWTH
        after = order.filter(F.col("rank") == done + 1).select("block", F.col("id").alias("next_a"))
        left = left.select("block", "b", "b_lo", "b_hi").join(after, "block").join(best.withColumnRenamed("a", "best_a"), "b", "left").withColumn("most_a", F.coalesce("best_a", "b")).filter("next_a < most_a")
        left = cut_lineage(left.select("block", "b", "b_lo", "b_hi", "most_a"))
        if left.isEmpty():
            return best.select("a", "b")


def pairs_to_earlier(new: DataFrame, stored: DataFrame, judge, hot: DataFrame | None = None, most: int = HOT) -> DataFrame:
    """(a, b): accepted pairs of a new entry b and a stored entry a of smaller id in one block, with fingerprints within the distance.

    Of ``hot`` blocks (block; None where there are none) only the first that b matches is given: the first over all pairs is the
    same as if all were given. Only the new entries' blocks are looked up.
    """
    p, q = (stored, new) if hot is None else (stored.join(hot, "block", "left_anti"), new.join(hot, "block", "left_anti"))
    out = judge(cut_lineage(sided(p, "a").join(sided(q, "b"), "block").filter((F.col("a") < F.col("b")) & within_distance()).select("a", "b").distinct()))
    if hot is not None:
        out = out.unionByName(first_in_hot(stored.join(hot, "block", "left_semi"), new.join(hot, "block", "left_semi"), judge, most))
    return out
