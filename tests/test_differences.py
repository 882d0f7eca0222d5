from pyspark.sql import functions as F

from tallyloom.operators import differences as d
from tallyloom.operators.versions import current_rows


def compare(spark, a, b):
    s = "k long, x string, n long, extra string"
    return {tuple(r) for r in d.compare_copies(spark.createDataFrame(a, s), spark.createDataFrame(b, s), "k", ["x", "n"], "no_left", "no_right").collect()}


def test_missing_and_differing(spark):
    got = compare(spark, [(1, "a", 1, "p"), (2, "b", None, "p"), (3, "c", 3, "p"), (None, "n", 1, "p")], [(1, "a", 1, "q"), (2, "B", 2, "q"), (4, "d", 4, "q"), (None, "n", 2, "q")])
    assert got == {(2, "x", "b", "B"), (2, "n", None, "2"), (3, "no_right", None, None), (4, "no_left", None, None), (None, "n", "1", "2")}


def test_empty_sides(spark):
    assert compare(spark, [], []) == set()
    assert compare(spark, [(1, "a", 1, "")], []) == {(1, "no_right", None, None)}
    assert compare(spark, [], [(1, "a", 1, "")]) == {(1, "no_left", None, None)}


def test_one_range_exchange(spark):
    s = "k long, x string"
    df = d.compare_copies(spark.createDataFrame([(1, "a")], s), spark.createDataFrame([(1, "a")], s), "k", ["x"], "l", "r")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_spellings(spark):
    h = "ab" * 32
    rows = spark.createDataFrame([(h, "Yes"), (f" SHA256:{h.upper()}\n", "1"), (f"sha256-{h}", "T"), (None, "no"), ("", None)], "h string, f string")
    got = rows.select(d.digest_value(F.col("h")).alias("h"), d.flag_value(F.col("f")).alias("f")).collect()
    assert {bytes(r.h) for r in got[:3]} == {bytes.fromhex(h)} and bytes(got[3].h) == bytes(got[4].h) == b"\0"
    assert [r.f for r in got] == ["true", "true", "true", "false", None]


def test_current_rows(spark):
    rows = [(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (2, None, "only"), (3, 5, "b"), (3, 5, "a"), (None, 1, "x")]
    df = spark.createDataFrame(rows, "k long, at long, v string")
    assert {(r.k, r.v) for r in current_rows(df, "k", ["at"], ["v"]).collect()} == {(1, "new"), (2, "only"), (3, "b"), (None, "x")}
    assert current_rows(df.limit(0), "k", ["at"], ["v"]).count() == 0
