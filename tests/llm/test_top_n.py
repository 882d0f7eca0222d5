import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import top_n as t


def rows_of(spark, rows, n=3, by="heap"):
    df = spark.createDataFrame(rows, "g string, s long, id long, place string, item string")
    return t.top_n(df, ["g"], [F.col("s"), F.col("id")], n, ["id", "s"], by)


def test_against_sorting_with_hot_groups_and_ties(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 400)}", rng.randint(0, 9), i, "x", "y") for i in range(5000)]
    got = {}
    for r in rows_of(spark, rows).collect():
        got.setdefault(r.g, {})[r.place] = (r.s, r.id)
    want = {}
    for g, s, i, *_ in rows:
        want.setdefault(g, []).append((s, i))
    assert got == {g: dict(enumerate(sorted(v)[:3], 1)) for g, v in want.items()}


def test_edges(spark):
    assert rows_of(spark, []).count() == 0
    got = {(r.g, r.id, r.place) for r in rows_of(spark, [(None, 2, 1, "", ""), (None, None, 2, "", ""), ("a", 1, 5, "", ""), ("a", 1, 5, "", "")]).collect()}
    assert got == {(None, 2, 1), (None, 1, 2), ("a", 5, 1), ("a", 5, 2)}


def test_heaps_are_built_before_the_shuffle(spark):
    plan = rows_of(spark, [("a", 1, 1, "", "")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_top_k" in plan


def test_no_silent_change_of_the_method(spark, monkeypatch):
    monkeypatch.setattr(t, "is_remote", lambda: True)
    with pytest.raises(RuntimeError, match="by='window'"):
        rows_of(spark, [("a", 1, 1, "", "")])


def test_window_form_gives_the_same(spark):
    rows = [("a", i % 4, i, "", "") for i in range(50)]
    want = {tuple(r) for r in rows_of(spark, rows).collect()}
    assert {tuple(r) for r in rows_of(spark, rows, by="window").collect()} == want
