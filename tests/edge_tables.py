"""Edge-case copies of the test tables: empty, all null, and every row twice beside clashing extra columns."""

from pyspark.sql import functions as F

EXTRA = {"place": "x", "level": 1, "item": "y", "_k": 2, "child_table": "z", "n": 5, "words": "q", "digest": "d", "ids": "i"}


def write(spark, sf_dir, out, names):
    for t in names:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df.limit(0).write.parquet(f"{out}/empty/{t}.parquet")
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        spark.range(3).select(*nulls).write.parquet(f"{out}/nulls/{t}.parquet")
        more = {k: F.lit(v) for k, v in EXTRA.items() if k not in df.columns}
        df.unionByName(df).withColumns(more).write.parquet(f"{out}/twice/{t}.parquet")
    return out


def check(spark, sf_dir, out, queries, found):
    """No query fails; empty tables give no rows, null rows at most as many, repeated rows no new findings."""
    for name in queries:
        assert queries[name](spark, f"{out}/empty").count() == 0, name
        assert queries[name](spark, f"{out}/nulls").count() <= 3, name
    for name in found:
        once = {tuple(r) for r in queries[name](spark, sf_dir).collect()}
        assert {tuple(r) for r in queries[name](spark, f"{out}/twice").collect()} == once, name
