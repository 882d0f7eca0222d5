"""Threshold checks as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_checks(summary: DataFrame, key: str, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, name, passed, actual, required) in long form. ``thresholds``: column -> ('least' or 'most', bound). A null
    value doesn't pass."""
    one = [
        F.struct(
            F.lit(c).alias("name"),
            F.coalesce(F.col(c).cast("double") >= bound if kind == "least" else F.col(c).cast("double") <= bound, F.lit(False)).alias("passed"),
            F.col(c).cast("double").alias("actual"), F.lit(float(bound)).alias("required"),
        )
        for c, (kind, bound) in thresholds.items()
    ]
    return summary.select(key, F.inline(F.array(*one)))


def roster_violations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either roster that the other lacks, with the side that has them."""
    cols = expected.columns
    return found.select(*cols).exceptAll(expected).withColumn("side", F.lit("unexpected")).unionByName(expected.exceptAll(found.select(*cols)).withColumn("side", F.lit("missing")))
