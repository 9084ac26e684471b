"""Values packed in cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.operators.packed_cells import CRITERIA_FIELDS, LEAD_FIELDS, split_cells
from leadloom.shared import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value packed in a cell, with its place. SQL can't follow quotes and escapes; tests hold it against a plain scanner."""
    leads = split_cells(table(spark, sf_dir, "audited_leads"), "lead_id", LEAD_FIELDS)
    return leads.unionByName(split_cells(table(spark, sf_dir, "handyman"), "criteria_id", CRITERIA_FIELDS))


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
