from pyspark.sql import functions as F

from tallyloom.functions import scalars as x


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


def test_text(spark):
    assert one(spark, x.slug(F.col("a")), a="--My file (2).TXT ") == "my-file-2-.txt"
    assert [one(spark, x.extension(F.col("a")), a=p) for p in ("a/b.tar.GZ", ".bashrc", "a/.x.py", "none", "end.")] == [".gz", "", ".py", "", ""]
    assert [one(spark, x.namespace(F.col("a")), a=p) for p in ("Talk:Axiom", "Axiom", ":x")] == ["talk", "", ""]
    assert [one(spark, x.size_bytes(F.col("a")), a=p) for p in ("16MiB", "4096", "unlimited", "2g")] == [16 << 20, 4096, None, 2 << 30]
    assert one(spark, x.repeat_to(F.col("a"), 5), a="ab") == "ababa" and one(spark, x.repeat_to(F.col("a"), 5), a="") == ""


def test_integers(spark):
    assert [one(spark, x.floor_div(F.col("a"), F.col("b")), a=a, b=2) for a in (-7, 7, -8)] == [-4, 3, -4]
    assert [one(spark, x.ceil_div(F.col("a"), F.col("b")), a=a, b=2) for a in (-7, 7, 8)] == [-3, 4, 4]
    for n in (0, -1, 1, 2**40, -(2**40)):
        assert one(spark, x.unzigzag(x.zigzag(F.lit(n).cast("bigint"))), a=1) == n
    assert [one(spark, x.varint_size(F.lit(n).cast("bigint")), a=1) for n in (0, 127, 128, 2**35)] == [1, 1, 2, 6]


def test_prefix(spark):
    assert [one(spark, x.common_prefix(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("abc", "abd"), ("", "a"), ("ab", "ab"))] == [2, 0, 2]


def test_hashes(spark):
    assert one(spark, x.fnv1a64(F.encode(F.col("a"), "UTF-8")), a="a") == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, x.splitmix64(F.lit(0).cast("bigint")), a=1) == 0xE220A8397B1DCDAF - (1 << 64)
