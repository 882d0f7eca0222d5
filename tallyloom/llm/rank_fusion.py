"""One ranking from several differently scaled scores: first principal component of their ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import value_ranks
from ..operators.versions import current_rows
from ..session import staged, table


def group_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, rank, n): the mean rank of each distinct non-null value within its group, and the group's size.
    Groups may be of any size; see ``ordered.value_ranks``."""
    ranks = value_ranks(df, group, value)
    return ranks.select(*group, value, (F.col("n_upto") - F.col("n_equal") + (F.col("n_equal") + 1) / 2).alias("rank"), "n")


def first_component(moments: list[list[float]]) -> np.ndarray:
    """Weights of the rank-transformed scores: the first principal component of their correlation matrix, its loading
    signs oriented to the declared directions.

    The scores are turned before, larger being better, so every loading is made positive and keeps its size. Scores
    without variance take no part; without any, all count equally."""
    c = np.nan_to_num(np.array(moments, dtype=float))
    live = np.diag(c) > 1e-12
    if not live.any():
        return np.ones(len(c))
    scale = np.where(live, np.sqrt(np.where(live, np.diag(c), 1)), 1)
    _, vectors = np.linalg.eigh((c / np.outer(scale, scale))[np.ix_(live, live)])
    weights = np.zeros(len(c))
    weights[live] = np.abs(vectors[:, -1]) / scale[live]
    return weights


def fuse_scores(df: DataFrame, group: str, item: str, scores: dict[str, int]) -> DataFrame:
    """(group, item, projection, mean_rank): the items' places on the first principal component of their rank-transformed
    scores, and beside it the plain mean of the ranks.

    ``scores`` maps a column to +1 (larger is better) or -1. Each score becomes its mid-rank within the group, divided
    by the number of items that have it, so range and distribution don't matter; null and non-positive scores are
    missing and stand in the middle. One aggregate over all items gives the moments, a k-by-k matrix for k scores, and
    only that matrix reaches the driver. (group, item) must be unique. Ties share their mean rank; an empty table gives
    an empty table; a group of one item has it in the middle on every score. Items without any score stay in.
    """
    columns = list(scores)
    long = df.select(
        F.col(group).alias("_g"), F.col(item).alias("_i"),
        F.inline(F.array(*[F.struct(F.lit(j).alias("_j"), F.when(F.col(c) > 0, F.col(c).cast("double") * sign).alias("_v")) for j, (c, sign) in enumerate(scores.items())])),
    )
    long = staged(long, "scores")
    ranks = group_ranks(long.filter("_v IS NOT NULL AND NOT isnan(_v)"), ["_g", "_j"], "_v")
    placed = long.join(ranks, ["_g", "_j", "_v"], "left").withColumn("_p", F.coalesce((F.col("rank") - 0.5) / F.col("n"), F.lit(0.5)))
    wide = staged(placed.groupBy("_g", "_i").agg(*[F.max(F.when(F.col("_j") == j, F.col("_p"))).alias(f"_p{j}") for j in range(len(columns))]), "ranked")
    k = range(len(columns))
    moments = wide.agg(*[F.covar_pop(f"_p{a}", f"_p{b}").alias(f"m{a}_{b}") for a in k for b in k if a <= b]).first()
    value = lambda a, b: moments[f"m{min(a, b)}_{max(a, b)}"]
    loadings = first_component([[np.nan if value(a, b) is None else value(a, b) for b in k] for a in k])
    projection = sum((F.col(f"_p{j}") * float(w) for j, w in enumerate(loadings)), F.lit(0.0))
    mean = sum((F.col(f"_p{j}") for j in k), F.lit(0.0)) / max(len(columns), 1)
    return wide.select(F.col("_g").alias(group), F.col("_i").alias(item), projection.alias("projection"), mean.alias("mean_rank"))


# Directions of the census scores.
SCORES = {"compressed_percent": -1, "compression_mbps": 1, "decompression_mbps": 1, "peak_memory_mib": -1}


def fused_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = table(spark, sf_dir, "codec_census").withColumn("_entry", F.struct("census_id", "codec"))
    current = current_rows(census, "_entry", ["measured_at"], ["exact_roundtrip", *SCORES]).filter("exact_roundtrip").select("_entry.*", *SCORES)
    return fuse_scores(current, "census_id", "codec", SCORES)


def _first(by: str) -> Column:
    """The item with the greatest value; equal values are settled by the codec."""
    return F.min(F.struct((-F.round(by, 9)).alias("p"), "codec"))["codec"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_census(spark, sf_dir).groupBy("census_id").agg(_first("projection").alias("codec"))


def p6_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first places by the plain mean of the ranks instead of the component."""
    return fused_census(spark, sf_dir).groupBy("census_id").agg(_first("mean_rank").alias("codec"))


def p6_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Censuses whose first place by the component isn't that by the mean of the ranks."""
    both = fused_census(spark, sf_dir).groupBy("census_id").agg(_first("projection").alias("by_component"), _first("mean_rank").alias("by_mean"))
    return both.filter("by_component <> by_mean")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries with their place; equal projections are settled by the codec."""
    fused = fused_census(spark, sf_dir).withColumn("_key", F.struct((-F.round("projection", 9)).alias("p"), "codec"))
    fused = staged(fused, "fused")
    places = group_ranks(fused, ["census_id"], "_key")
    return fused.join(places, ["census_id", "_key"]).select("census_id", "codec", F.round("projection", 6).alias("projection"), F.col("rank").cast("bigint").alias("place"))


QUERIES = {"p6_found": p6_found, "p6_ranking": p6_ranking, "p6_equal": p6_equal, "p6_differences": p6_differences}
# The component by power iteration over the correlation matrix of the mid-ranks.
_SQL = """
WITH RECURSIVE c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY census_id, codec ORDER BY measured_at DESC) AS rn FROM codec_census) WHERE rn = 1 AND exact_roundtrip),
s AS (SELECT census_id, codec, unnest([1, 2, 3, 4]) AS j, unnest([CASE WHEN compressed_percent > 0 THEN -compressed_percent END, CASE WHEN compression_mbps > 0 THEN compression_mbps END,
      CASE WHEN decompression_mbps > 0 THEN decompression_mbps END, CASE WHEN peak_memory_mib > 0 THEN -peak_memory_mib END]) AS v FROM c),
r AS (SELECT census_id, codec, j, CASE WHEN v IS NULL THEN 0.5 ELSE (rank() OVER w + (count(*) OVER (PARTITION BY census_id, j, v) - 1) / 2.0 - 0.5) / count(v) OVER (PARTITION BY census_id, j) END AS p
      FROM s WINDOW w AS (PARTITION BY census_id, j ORDER BY v NULLS LAST)),
x AS MATERIALIZED (SELECT census_id, codec, max(CASE WHEN j = 1 THEN p END)::double AS a, max(CASE WHEN j = 2 THEN p END)::double AS b, max(CASE WHEN j = 3 THEN p END)::double AS c, max(CASE WHEN j = 4 THEN p END)::double AS d FROM r GROUP BY census_id, codec),
m AS MATERIALIZED (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(a, d) AS ad, corr(b, c) AS bc, corr(b, d) AS bd, corr(c, d) AS cd, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, stddev_pop(d) AS sd FROM x),
i AS (SELECT 0 AS k, 1.0::double AS a, -0.9::double AS b, 0.8::double AS c, -0.7::double AS d UNION ALL
  SELECT k + 1, a / n, b / n, c / n, d / n FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM
    (SELECT k, a + ab * b + ac * c + ad * d AS a, ab * a + b + bc * c + bd * d AS b, ac * a + bc * b + c + cd * d AS c, ad * a + bd * b + cd * c + d AS d FROM i, m)) WHERE k < 500),
f AS (SELECT census_id, codec, (x.a + x.b + x.c + x.d) / 4 AS mean_rank, abs(i.a) / sa * x.a + abs(i.b) / sb * x.b + abs(i.c) / sc * x.c + abs(i.d) / sd * x.d AS projection FROM x, m, i WHERE i.k = 500)
"""
_FIRST = "SELECT census_id, arg_min(codec, (-round({}, 9), codec)) AS {} FROM f GROUP BY census_id"
ORACLES = {
    "p6_found": _SQL + _FIRST.format("projection", "codec"),
    "p6_equal": _SQL + _FIRST.format("mean_rank", "codec"),
    "p6_differences": _SQL + f"SELECT * FROM ({_FIRST.format('projection', 'by_component')}) JOIN ({_FIRST.format('mean_rank', 'by_mean')}) USING (census_id) WHERE by_component <> by_mean",
    "p6_ranking": _SQL + "SELECT census_id, codec, round(projection, 6) AS projection, row_number() OVER (PARTITION BY census_id ORDER BY round(projection, 9) DESC, codec) AS place FROM f",
}
