import random


from tallyloom.operators import ordered


def test_running_total_over_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(0, 9)) for i in range(2000)]
    got = {(r.g, r.o): r.total for r in ordered.running_total(spark.createDataFrame(rows, "g string, o long, w long"), ["g"], ["o"], "w").collect()}
    sums, want = {}, {}
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + w
        want[g, o] = sums[g]
    assert got == want


def test_prefix_stops_at_the_first_overflow(spark):
    rows = [("a", 1, 5), ("a", 2, 9), ("a", 3, 1), ("b", 1, 11), (None, 1, 3), ("c", 1, None)]
    got = {(r.g, r.o) for r in ordered.prefix_under_cap(spark.createDataFrame(rows, "g string, o long, w long"), ["g"], ["o"], "w", 10).collect()}
    assert got == {("a", 1), (None, 1), ("c", 1)}
    assert ordered.prefix_under_cap(spark.createDataFrame([], "g string, o long, w long"), ["g"], ["o"], "w", 10).count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(2)
    values = {"a": [rng.randint(0, 50) for _ in range(999)], "b": [7], "c": [1, 2]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v long")
    for r in ordered.exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).collect():
        assert abs(r.p50 - np.quantile(values[r.g], 0.5)) < 1e-9 and abs(r.p90 - np.quantile(values[r.g], 0.9)) < 1e-9


def test_value_ranks_count_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 1, 2, 3, 3)], "g string, v long")
    got = {r.v: (r.n_equal, r.n_upto, r.n) for r in ordered.value_ranks(df, ["g"], "v").collect()}
    assert got == {1: (2, 2, 5), 2: (1, 3, 5), 3: (2, 5, 5)}


def test_previous_rows_over_ranges(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rng.randint(0, 9)) for i in rng.sample(range(5000), 1500)] + [(None, 1, 1), (None, 2, 2)]
    got = {(r.g, r.o): r.before for r in ordered.with_previous(spark.createDataFrame(rows, "g string, o long, w long"), ["g"], ["o"], {"w": "before"}).collect()}
    last, want = {}, {}
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        want[g, o] = last.get(g)
        last[g] = w
    assert got == want
    assert ordered.with_previous(spark.createDataFrame([], "g string, o long, w long"), ["g"], ["o"], {"w": "before"}).count() == 0
