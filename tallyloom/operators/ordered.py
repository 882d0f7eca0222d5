"""Order-dependent operators that never hold a whole group in one task.

Running totals and ranks over groups of any size: rows are range-partitioned by (group, order), a window runs inside
each range only, and what the ranges before it add up to is joined on as an offset, one small row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import staged


def _ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` staged in ranges of (group, order), with the number of each row's range."""
    return staged(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _earlier(group: list[str]) -> WindowSpec:
    return (Window.partitionBy(*group) if group else Window).orderBy("_range")


def _join_ranges(rows: DataFrame, per_range: DataFrame, group: list[str]) -> DataFrame:
    """Rows as ``p`` beside what is known of their range and group as ``o``: a table of ranges, not of rows."""
    same = F.col("p._range") == F.col("o._range")
    for g in group:
        same = same & F.col(f"p.{g}").eqNullSafe(F.col(f"o.{g}"))
    return rows.alias("p").join(per_range.alias("o"), same)


def running_total(df: DataFrame, group: list[str], order: list[str], weight: Column | str, name: str = "total") -> DataFrame:
    """``df`` with the sum of ``weight`` over its group's rows up to and including each row, in ascending ``order``.

    (group, order) must be unique for a defined result. Nulls in ``order`` come first, a null weight counts as 0, null
    groups form one group, an empty table stays empty. The result is read from a staged table.
    """
    w = F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0))
    placed = _ranges(df.withColumn("_w", w), group, order)
    sums = placed.groupBy(*group, "_range").agg(F.sum("_w").alias("_sum"))
    upto = _earlier(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = _join_ranges(placed.withColumn("_run", F.sum("_w").over(inside)), offsets, group)
    return run.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("_run") + F.col("_offset")).alias(name))


def with_previous(df: DataFrame, group: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with the values of the row before, in ascending ``order`` within the group; null for the first.

    ``columns`` maps a column to the name its earlier value gets. The last row of each group and range is handed on to
    the next range that holds rows of the group; no task ever holds a group. (group, order) must be unique for a
    defined result; nulls in ``order`` come first and null groups form one group.
    """
    placed = _ranges(df, group, order)
    values = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    last = placed.groupBy(*group, "_range").agg(F.max_by(values, F.struct(*order)).alias("_last"))
    handed = last.select(*group, "_range", F.lag("_last").over(_earlier(group)).alias("_handed"))
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    here = placed.withColumn("_before", F.lag(values).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    met = _join_ranges(here, handed, group)
    before = F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("_before"))
    return met.select(*[F.col(f"p.{c}") for c in df.columns], *[before[n].alias(n) for n in columns.values()])


def prefix_under_cap(df: DataFrame, group: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """The rows of each group before the first one, in order, at which the running size exceeds ``cap``.

    A row that alone exceeds the cap ends the prefix; later rows that would fit again stay out."""
    return running_total(df, group, order, size, "running_size").filter(F.col("running_size") <= cap)


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n_equal, n_upto, n): each distinct non-null value of a group, how often it occurs, how many
    values are no greater, and how many there are. Equal values are counted before anything is ordered."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_equal"))
    run = running_total(counted, group, [value], "n_equal", "n_upto")
    totals = run.groupBy(*group).agg(F.sum("n_equal").alias("n"))
    return run.join(totals, group)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """(group, one column per probability): linearly interpolated quantiles of any number of values per group."""
    ranks = value_ranks(df, group, value)
    first = F.col("n_upto") - F.col("n_equal") + 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= F.col("n_upto")), F.col(value)))

    parts = []
    for name, p in probabilities.items():
        place = (F.col("n") - 1) * F.lit(p) + 1
        parts += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_f_{name}")]
    found = ranks.groupBy(*group).agg(*parts)
    return found.select(*group, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probabilities])
