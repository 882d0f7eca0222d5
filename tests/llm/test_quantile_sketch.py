import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import quantile_sketch as q


def test_codes_keep_the_order_and_the_value(spark):
    rng = random.Random(5)
    values = sorted({0, 1, -1, 2, 255, 256, 511, 512, 513, 2**53, 2**62, -(2**62), 2**63 - 1, *(rng.randint(-(2 ** rng.randint(1, 62)), 2 ** rng.randint(1, 62)) for _ in range(500))})
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", q.encode(F.col("v")).alias("c")).orderBy("v").collect()
    codes = [r.c for r in rows]
    assert codes == sorted(codes) and 0 <= codes[0] and codes[-1] < 1 << q.WHOLE_BITS
    for r in rows:
        assert abs(q.decode(r.c) - r.v) <= abs(r.v) / 512 + 1


def test_codes_of_doubles(spark):
    rng = random.Random(8)
    values = sorted({0.0, 0.1, 0.9, -0.1, 1.0, 2.0, 0.5, 1e-300, -1e300, 1.7e308, 5e-324, float("inf"), *(rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(500)), *(2.0**e for e in range(-1020, 1023, 37))})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", q.encode_double(F.col("v")).alias("c")).orderBy("v").collect()
    codes = [r.c for r in rows]
    assert codes == sorted(codes) and 0 <= codes[0] and codes[-1] < 1 << q.DOUBLE_BITS
    for r in rows[:-1]:
        assert abs(q.decode(r.c, q.DOUBLE_BITS) - r.v) <= abs(r.v) / 512 + 1e-307, r


def test_percentiles_of_fractions(spark):
    rng = random.Random(9)
    data = [rng.expovariate(3) for _ in range(5000)] + [float("nan")]
    df = spark.createDataFrame([("a", v) for v in data] + [("b", None), ("c", 0.1), ("c", 0.9)], "g string, v double")
    got = {r.g: r for r in q.quantiles(q.build_sketch(df, ["g"], "v"), ["g"], [0.5, 0.995, 0.999]).collect()}
    assert set(got) == {"a", "c"} and got["a"].n == 5000 and abs(got["c"].p99_9 - 0.9) < 0.01
    s = np.sort(data[:-1])
    assert abs(np.searchsorted(s, got["a"].p50) / 5000 - 0.5) < 0.02 and np.searchsorted(s, got["a"].p99_5) / 5000 > 0.97


def test_hash_is_the_engines(spark):
    for level, line, node in ((0, 0, 0), (3, 4, 77), (7, 2, 65_000)):
        want = spark.range(1).select(F.xxhash64(F.lit(q.SEED), F.lit(level), F.lit(line), F.lit(node).cast("bigint")).alias("h")).first().h
        got = q._spark_xxhash64([(q.SEED, 4), (level, 4), (line, 4), (node, 8)])
        assert got == want % (1 << 64)


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, v long, w long, amount long, level long")


def test_ranks_against_sorting(spark):
    rng = random.Random(6)
    data = {"a": [int(rng.lognormvariate(12, 2)) for _ in range(20_000)], "b": [rng.randint(-50, 50) for _ in range(3_000)], "c": [7]}
    df = table(spark, [(g, v, 1, 0, 0) for g, vs in data.items() for v in vs])
    for r in q.quantiles(q.build_sketch(df, ["g"], "v"), ["g"], [0.1, 0.5, 0.9, 0.99]).collect():
        s = np.sort(data[r.g])
        assert r.n == len(s)
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            x = r[name]
            lo, hi = np.searchsorted(s, x - abs(x) / 200 - 1) / len(s), np.searchsorted(s, x + abs(x) / 200 + 1, side="right") / len(s)
            assert lo - 0.02 <= p <= hi + 0.02, (r.g, name, x)


def test_merging_and_deleting(spark):
    rng = random.Random(7)
    rows = [("a", rng.randint(1, 10**6), 1, 0, i % 4) for i in range(4000)]
    whole = q.build_sketch(table(spark, rows), ["g"], "v")
    days = q.merge_sketches(q.build_sketch(table(spark, rows), ["g", "w"], "v"), ["g"])
    key = lambda s: {(r.g, r.level, r.line, r.slot): r.amount for r in s.collect() if r.amount}
    assert key(whole) == key(days)
    extra = [("a", 5, 1, 0, 0)] * 100
    undone = rows + extra + [("a", 5, -1, 0, 0)] * 100
    assert key(q.build_sketch(table(spark, undone), ["g"], "v", "w")) == key(whole)


def test_edges(spark):
    sketch = q.build_sketch(table(spark, [("a", None, 1, 0, 0), (None, 5, 1, 0, 0), ("z", 9, 1, 0, 0), ("z", 9, -1, 0, 0)]), ["g"], "v", "w")
    assert {(r.g, r.n) for r in q.quantiles(sketch, ["g"], [0.5]).collect()} == {(None, 1)}
    assert q.quantiles(q.build_sketch(table(spark, []), ["g"], "v"), ["g"], [0.5]).count() == 0
