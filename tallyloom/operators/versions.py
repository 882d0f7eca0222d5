"""Current versions of rows that were recorded more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, latest: Sequence[str], payload: Sequence[Column | str]) -> DataFrame:
    """One row per ``key``: the payload of the row with the greatest ``latest`` columns.

    The choice is a mergeable maximum, so every map task sends at most one row per key and a key that holds a large
    share of all rows costs no more than any other. Exact duplicates collapse; rows that tie on ``latest`` but differ
    are settled by the greatest payload. Nulls in ``latest`` sort below every value; a null key is a group of its own;
    an empty table gives an empty table. Columns of ``df`` that are not named are never read.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in payload]
    packed = df.select(F.col(key).alias("_k"), F.struct(F.struct(*[F.col(c) for c in latest]).alias("v"), F.struct(*columns).alias("p")).alias("_s"))
    return packed.groupBy("_k").agg(F.max("_s").alias("_s")).select(F.col("_k").alias(key), "_s.p.*")
