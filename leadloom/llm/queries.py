"""The queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.packed_cells import CRITERIA_FIELDS, split_cells
from leadloom.shared import cut_lineage, table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadloom.llm.linkage import lead_records, link, sheet_records

    found = link(lead_records(table(spark, sf_dir, "audited_leads")), sheet_records(table(spark, sf_dir, "call_sheet")))
    return found.select(F.col("left_id").alias("lead_id"), F.col("right_id").alias("sheet_id"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of audited_leads and call_sheet for the same business."""
    return _linked(spark, sf_dir).select("lead_id", "sheet_id")


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with the model's confidence."""
    return _linked(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed countries, categories and each packed category with the entry of canon_list they mean."""
    from leadloom.llm.canon import canon_names, map_values

    rows = table(spark, sf_dir, "handyman")
    packed = split_cells(rows, "criteria_id", CRITERIA_FIELDS).select(F.col("record_id").alias("criteria_id"), "field_name", "pos", F.lit("allowed_category").alias("kind"), F.col("item").alias("value"))
    single = [rows.select("criteria_id", F.lit(c).alias("field_name"), F.lit(1).alias("pos"), F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("country", "business_category")]
    typed = packed.unionByName(single[0]).unionByName(single[1])
    found = map_values(typed, canon_names(table(spark, sf_dir, "canon_list")))
    return found.select("criteria_id", "field_name", F.col("pos").cast("int").alias("pos"), F.col("canon_id").cast("int").alias("canon_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of batches 1 and later that repeat a row accepted before."""
    from leadloom.llm.history import ledger_records, repeats

    return repeats(cut_lineage(ledger_records(table(spark, sf_dir, "permanent_leads")))).select(F.col("first_id").cast("int").alias("first_id"), F.col("dup_id").cast("int").alias("dup_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of audited_leads rows whose addresses denote the same place."""
    from leadloom.llm.address import same_places

    return same_places(table(spark, sf_dir, "audited_leads")).select(F.col("a").alias("lead_id_a"), F.col("b").alias("lead_id_b"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadloom.llm.bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity of pack_specs."""
    from leadloom.llm.bpe import count_tokens
    from leadloom.llm.packing import pack_items

    docs, specs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs")
    out = None
    for (tokenizer,) in specs.select("tokenizer").distinct().orderBy("tokenizer").collect():  # a table of settings, a few rows
        packed = pack_items(count_tokens(docs, tokenizer=tokenizer), specs.filter(F.col("tokenizer") == tokenizer))
        out = packed if out is None else out.unionByName(packed)
    return out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadloom.llm.subjects import assign_subjects

    return assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels")).select("doc_id", "subject")


QUERIES = {"p2_found": p2_found, "p2_confidence": p2_confidence, "p4_found": p4_found, "p5_found": p5_found, "p3_found": p3_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
