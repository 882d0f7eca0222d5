"""Top N items of every group by mergeable bounded heaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

from ..operators.versions import current_rows
from ..session import table


def _heap(items: Column, n: int) -> Column:
    """Spark's bounded-heap aggregate, keeping the n least. It has no public name, so it is reached through the JVM of a
    classic session; RuntimeError where there is none, as under Spark Connect."""
    if is_remote():
        raise RuntimeError("no bounded-heap aggregate in this session; call top_n with by='window'")
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    sc = SparkSession.active().sparkContext
    companion = getattr(getattr(sc._jvm.org.apache.spark.sql, "Column$"), "MODULE$")
    return Column(companion.internalFn("collect_top_k", _to_seq(sc, [items, F.lit(n), F.lit(True)], _to_java_column)))


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, keep: list[str], by: str = "heap") -> DataFrame:
    """The n first rows of each group in ascending ``order``, with their place: group columns, ``keep``, place.

    ``order`` must end in a unique identifier, so that ties are always settled the same way; negate a number to rank it
    from high to low. Each map task folds its rows into one heap of n rows per group, and only those heaps are shuffled
    and merged: a group of any size sends at most n rows per task, so no group is hot. Null groups form one group;
    nulls in ``order`` come first (filter them out where they are no scores); fewer than n rows give all of them; an
    empty table gives none. Rows repeated in every column count as often as they occur. Columns of ``df`` that are not
    named are never read. ``by='window'`` gives the same by window group limits, for sessions without the aggregate: rows
    are cut to n per group and task, shuffled and cut again.
    """
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], item.alias("item"))
    groups = [f"g{i}" for i in range(len(group))]
    if by == "window":
        place = F.row_number().over(Window.partitionBy(*groups).orderBy("item"))
        found = rows.withColumn("place", place).filter(F.col("place") <= n)
    else:
        found = rows.groupBy(*groups).agg(_heap(F.col("item"), n).alias("heap")).select(*groups, F.posexplode("heap").alias("at", "item"))
        found = found.withColumn("place", (F.col("at") + 1).cast("int"))
    return found.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(group)], *[F.col(f"item.k{i}").alias(c) for i, c in enumerate(keep)], "place")


def best_trials(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    trials = table(spark, sf_dir, "trials")
    current = current_rows(trials, "trial_id", ["recorded_at"], ["item_id", "codec_id", "compressed_bytes", "roundtrip_ok", "repetition"])
    scored = current.filter("roundtrip_ok AND repetition > 0 AND compressed_bytes IS NOT NULL")
    return top_n(scored, ["item_id"], [F.col("compressed_bytes"), F.col("codec_id"), F.col("trial_id")], n, ["trial_id", "codec_id", "compressed_bytes"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_trials(spark, sf_dir).select("item_id", "trial_id")


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_trials(spark, sf_dir)


_SQL = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY recorded_at DESC) AS rn FROM trials) WHERE rn = 1),
t AS (SELECT item_id, trial_id, codec_id, compressed_bytes,
        row_number() OVER (PARTITION BY item_id ORDER BY compressed_bytes, codec_id, trial_id)::int AS place
      FROM c WHERE roundtrip_ok AND repetition > 0 AND compressed_bytes IS NOT NULL)
SELECT {} FROM t WHERE place <= 3"""

QUERIES = {"p4_found": p4_found, "p4_places": p4_places}
ORACLES = {"p4_found": _SQL.format("item_id, trial_id"), "p4_places": _SQL.format("*")}
