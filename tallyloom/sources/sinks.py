"""Sinks: write once, overwrite, immutable, checksums and small rendered reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import binary_files


def write_once(df: DataFrame, path: str) -> None:
    """Writes a new table; an existing one is an error, and a failed job leaves none."""
    df.write.mode("errorifexists").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that only one of two tables of equal columns has."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def write_immutable(df: DataFrame, path: str) -> bool:
    """Writes a new table; writing equal rows again does nothing and gives False; other rows are an error."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path)
        columns = known.columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        write_once(df, path)
        return True
    if sorted(columns) != sorted(df.columns) or differing_rows(known, df.select(*columns)).limit(1).count():
        raise ValueError(f"{path} holds other rows")
    return False


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a checksum list of all files below a path, in path order."""
    return binary_files(spark, path).orderBy("path").select(F.concat("sha256", F.lit("  "), F.regexp_extract("path", "([^/]+)$", 1)).alias("line"))


def write_manifest(items: DataFrame, path: str) -> None:
    """One JSON line per item in id order, in parts that are ranges of ids: the parts in order of their names are the
    manifest."""
    items.repartitionByRange("id").sortWithinPartitions("id").write.mode("errorifexists").json(path)


def write_results(summary: DataFrame, path: str) -> None:
    """A result table as JSON and as CSV with a header, side by side."""
    summary.write.mode("overwrite").json(f"{path}/json")
    summary.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
