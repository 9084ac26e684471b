"""Column expressions for comparing names and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and what they are without (fixed values).
MARKED = "àáâãäåāăąçćčďđèéêëēĕėęěìíîïīįıłľñńňòóôõöøōőŕřśşšșťţțùúûüūůűųýÿžźżß"
PLAIN = "aaaaaaaaacccddeeeeeeeeeiiiiiiillnnnoooooooorrsssstttuuuuuuuuyyzzzs"
assert len(MARKED) == len(PLAIN)


def folded(c: Column) -> Column:
    """Lower case, letters without marks, no combining or invisible characters."""
    return F.translate(F.regexp_replace(F.lower(c), r"[̀-ͯ​-‏⁠﻿­]", ""), MARKED, PLAIN)


def in_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(c: Column, use) -> Column:
    """``use(c)`` with c evaluated once, also where it stands within a lambda."""
    return F.element_at(F.transform(F.array(c), use), 1)


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns whose results are computed once: the generator between keeps the optimizer from copying the expressions into
    every later use."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made).select(*kept, *[F.col(f"_made.{n}").alias(n) for n in columns])
