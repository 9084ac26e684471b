"""New batches against everything accepted: fingerprints in rotated block tables, kept in a folder and appended to.

A fingerprint has eight lanes of bits, one for each end of each detail, with a bit for each pair of letters; so a typing error
changes at most four bits. Each rotated table puts two lanes in front: a batch's own blocks are looked up in the stored ones by
exact match, what meets is verified by the Hamming distance of the fingerprints and then by the texts, which are read for the
pairs that are left only. Then the batch's records, fingerprints and counts are appended.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.llm import business as B
from leadloom.llm.candidates import HOT, hot_blocks, pairs_to_earlier
from leadloom.shared import cut_lineage, scratch_dir

#: The compared columns of a record.
DETAILS = ("words", "phones", "web", "mails", "mail_host")


def features(records: DataFrame) -> DataFrame:
    """Records with the columns compared, where these records are all there are."""
    common = cut_lineage(B.common_words(B.word_counts(records)))
    known = B.classify(records, common)
    return B.with_hosts(known, cut_lineage(B.host_kinds(B.host_counts(known))))


def ledger_records(leads: DataFrame) -> DataFrame:
    """permanent_leads in keyed form, with batch."""
    flags = leads.select(F.col("i_d").alias("id"), F.coalesce("batch_no", F.lit(1)).alias("batch")).dropDuplicates(["id"])
    return B.prepare(leads, "i_d", "business_name", ["phone"], "website", "email").join(flags, "id")


@contextmanager
def _long_loop(spark: SparkSession) -> Iterator[None]:
    """For a driver that runs many jobs in turn: the plans' texts it keeps are cut short, and when a turn is over its garbage is
    collected, so that the shuffle files of finished jobs are removed from the executors' disks."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        gc.collect()
        spark._jvm.System.gc()


class History:
    """The accepted records in a folder, by batch: records, block tables with fingerprints, counts of words and hosts, and the first
    record of each repeat.

    A batch is judged by the counts of what came before it and its own, never by later ones. All parts lie in folders of their
    batch's number and are replaced as a whole, so a batch that is taken again after a failure gives the same result and leaves
    the same history. Ids rise in the order of arrival, over batches too.
    """

    def __init__(self, spark: SparkSession, path: str, hot: int = HOT):
        self.spark, self.path, self.hot_from = spark, path.rstrip("/"), hot
        self.schemas: dict[str, StructType] = {}
        self.hot: DataFrame | None = None

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")
        self.schemas[name] = df.schema
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def _by_batch(self, name: str, batch: int) -> DataFrame:
        """What the batches up to ``batch`` have: others' folders aren't read."""
        return self._all(name).filter(F.col("batch") <= batch)

    def _until(self, name: str, batch: int) -> DataFrame:
        return self._by_batch(name, batch).drop("batch")

    def _among(self, name: str, batches: tuple[int, ...]) -> DataFrame:
        return self._all(name).filter(F.col("batch").isin(*batches))

    def _of(self, name: str, batch: int) -> DataFrame:
        return self._all(name).filter(F.col("batch") == batch).drop("batch")

    def store(self, records: DataFrame) -> None:
        """Writes what doesn't depend on other records: keyed records (id, batch, DETAILS) of one or more batches, their fingerprints in
        the rotated tables, and their counts of words. Of exact copies in all details only the first gets blocks."""
        some = "id is not null and (size(words) > 0 or size(phones) > 0 or web is not null or size(mails) > 0)"
        rows = cut_lineage(records.filter(some).select("id", F.col("batch").cast("int").alias("batch"), *DETAILS, F.xxhash64(*DETAILS).alias("same")).dropDuplicates(["id"]))
        known = rows.select("same", "id")
        if "records" in self.schemas:  # what is stored again takes the place of what there was
            mine = rows.select("batch").distinct()
            there = self._all("records").join(F.broadcast(mine), "batch", "left_anti")  # numbers of batches
            known = known.unionByName(there.select("same", "id").join(rows.select("same").distinct(), "same", "left_semi"))
        firsts = known.groupBy("same").agg(F.min("id").alias("first"))
        stored = self._write("records", rows.join(firsts, "same").select("id", *DETAILS, "same", "first", "batch")).join(F.broadcast(rows.select("batch").distinct()), "batch")
        self._write("words", B.word_counts(stored, "batch"))
        # The stored tables hold every host and name: what marks no business is left out on the side that looks up.
        hosts = F.array_distinct(F.array_compact(F.array("web", "mail_host")))
        whole = stored.filter("id = first").withColumns({"hosts": hosts, "own_mails": F.col("mails"), "chain": F.lit(False), "stem": F.col("words")})
        blocks = self._write("blocks", B.entries(whole, kept=("batch",)))
        hot = cut_lineage(hot_blocks(blocks, self.hot_from))
        self.hot = None if hot.isEmpty() else hot

    def take(self, batch: int) -> None:
        """Takes a stored batch as it is, without a look up."""
        new = self._of("records", batch)
        number = F.lit(batch).cast("int").alias("batch")
        self._write("hosts", B.host_counts(B.classify(new, cut_lineage(B.common_words(self._until("words", batch))))).select("*", number))
        self._write("firsts", new.filter("first < id").select(F.col("id").alias("b"), F.col("first").alias("a"), number))

    def find(self, *batches: int) -> DataFrame:
        """(first_id, dup_id) of the repeats of stored batches that follow each other, in one look up of their blocks in the stored ones.

        A record's first is the first of the earliest record it matches, and so on up. Records without any name and contact match
        nothing; an empty batch has no repeats. What is found doesn't depend on how many batches are looked up at once: each is
        judged by the counts up to and with its own, of which only the changes are gone through.
        """
        last = max(batches)
        new = self._among("records", batches)
        common = cut_lineage(B.common_words_by_batch(self._by_batch("words", last)))
        known = cut_lineage(B.classify_by_batch(new, common))
        self._write("hosts", B.host_counts(known, "batch"))
        kinds = cut_lineage(B.host_kinds_by_batch(self._by_batch("hosts", last)))
        marks = B.with_hosts(known.filter("id = first"), kinds).select("id", "batch", "chain", (F.size("stem") > 0).alias("named"))
        shared = kinds.filter("kind = 'platform'").select(F.col("host").alias("_host"), "since", "until")
        table = B.table_of(F.col("block"))
        real = ~((table == B.WHOLE_HOSTS) & F.col("chain")) & ~((table == B.WHOLE_NAMES) & ~F.col("named"))
        looked = self._among("blocks", batches).join(marks, ["id", "batch"]).filter(real)
        looked = cut_lineage(looked.join(shared, (F.col("host") == F.col("_host")) & F.col("batch").between(F.col("since"), F.col("until")), "left_anti").select("id", "block", "lo", "hi"))
        crowded = self.hot is not None and not looked.join(self.hot, "block", "left_semi").isEmpty()  # most hot blocks are of platforms

        def judge(pairs: DataFrame) -> DataFrame:
            at = pairs.join(new.select(F.col("id").alias("b"), "batch"), "b")  # the batch that a pair is judged at
            met = at.select(F.explode(F.array("a", "b")).alias("id"), "batch").distinct()
            rows = self._until("records", last).select("id", *DETAILS).join(met, "id")
            full = cut_lineage(B.with_hosts(B.classify_by_batch(rows, common), kinds).select("id", "batch", *B.FEATURES))
            return B.evidence(B.sides(at, full, full, also=("batch",))).filter(B.same_business()).select("a", "b")

        found = pairs_to_earlier(looked, self._until("blocks", last), judge, self.hot if crowded else None, self.hot_from)
        parents = found.groupBy("b").agg(F.min("a").alias("a")).unionByName(new.filter("first < id").select(F.col("id").alias("b"), F.col("first").alias("a")))
        # What the parent is in an earlier batch is known; within these batches pointers are doubled until none moves.
        up = self._until("firsts", min(batches) - 1).select(F.col("b").alias("a"), F.col("a").alias("top"))
        now = cut_lineage(parents.join(up, "a", "left").select("b", F.coalesce("top", "a").alias("a")))
        while not (moving := now.join(now.select(F.col("b").alias("a"), F.col("a").alias("top")), "a")).isEmpty():
            now = cut_lineage(now.join(moving.select("b", "top"), "b", "left").select("b", F.coalesce("top", "a").alias("a")))
        self._write("firsts", now.join(new.select(F.col("id").alias("b"), "batch"), "b").select("b", "a", "batch"))
        return self._among("firsts", batches).select(F.col("a").alias("first_id"), F.col("b").alias("dup_id"))

    def accept(self, batch: int, records: DataFrame, accepted: bool = False) -> DataFrame | None:
        """Stores a batch and finds its repeats."""
        self.store(records.drop("batch").withColumn("batch", F.lit(batch)))
        return self.take(batch) if accepted else self.find(batch)


def repeats(records: DataFrame, hot: int = HOT) -> DataFrame:
    """(first_id, dup_id) of all records (id, batch, DETAILS) of batch 1 and later that repeat an earlier one.

    All batches are stored in the history, then their blocks are looked up in it once, not once for every batch.
    """
    history = History(records.sparkSession, scratch_dir(records.sparkSession, "history"), hot)
    with _long_loop(records.sparkSession):
        history.store(records.withColumn("batch", F.greatest("batch", F.lit(0))))
        history.take(0)
        batches = [int(r[0]) for r in records.filter("batch > 0").select("batch").distinct().orderBy("batch").collect()]  # the numbers of batches
        if not batches:
            return records.select(F.col("id").alias("first_id"), F.col("id").alias("dup_id")).limit(0)
        return history.find(*batches)
