from tallyloom.llm import mixing as m


def test_quotas_and_shortfalls():
    routed = m.route_mix({("a",): 100, ("b",): 10}, {"a": (50, 1), "b": (40, 3), "c": (5, 9)})
    assert routed == {(("a",), "a"): 50, (("b",), "b"): 30}


def test_overlapping_sources_share_without_needless_repeats():
    # a's own documents suffice for a, so what belongs to both goes to b
    routed = m.route_mix({("a",): 60, ("a", "b"): 40}, {"a": (60, 2), "b": (40, 2)})
    assert routed == {(("a",), "a"): 60, (("a", "b"), "b"): 40}
    routed = m.route_mix({("a", "b"): 40}, {"a": (40, 2), "b": (40, 2)})
    assert sum(routed.values()) == 80


def docs(spark, rows):
    return spark.createDataFrame(rows, "key long, sources array<string>, tokens long, pattern string")


TARGETS = "mix_id string, source string, target_share double, max_repeats long, size_ratio double"


def test_selection_keeps_to_plan_and_repeats(spark):
    rows = [(i, ["big"], 10, "x") for i in range(1000)] + [(2000 + i, ["small"], 7, "x") for i in range(10)] + [(3000, None, 5, "x"), (3001, [None], 5, "x"), (3002, ["big"], 0, "x")]
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.1), ("m", "small", 0.5, 4, 0.1), ("m", "gone", 0.0, 2, 0.1)], TARGETS)
    plan, routes = m.plan_mixes(docs(spark, rows), targets)
    p = {r.source: r for r in plan.collect()}
    assert p["small"].tokens == 280 < p["small"].quota and p["big"].tokens == p["big"].quota and p["gone"].tokens == 0
    picked = m.select_documents(docs(spark, rows), routes, targets).collect()
    assert {r.repeats for r in picked if r.source == "small"} == {4} and {r.repeats for r in picked if r.source == "big"} == {1}
    big = sum(r.tokens for r in picked if r.source == "big")
    assert p["big"].quota - 10 < big <= p["big"].quota
    assert [r.key for r in m.select_documents(docs(spark, rows), routes, targets).orderBy("source", "key").collect()] == [r.key for r in sorted(picked, key=lambda r: (r.source, r.key))]


def test_many_routes_are_not_broadcast(spark, monkeypatch):
    rows = [(i, ["big"] if i % 3 else ["big", "small"], 10, "x") for i in range(600)]
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.3), ("m", "small", 0.5, 4, 0.3)], TARGETS)
    _, routes = m.plan_mixes(docs(spark, rows), targets)
    want = sorted(tuple(r) for r in m.select_documents(docs(spark, rows), routes, targets).collect())
    monkeypatch.setattr(m, "BROADCAST_ROUTES", 0)
    assert sorted(tuple(r) for r in m.select_documents(docs(spark, rows), routes, targets).collect()) == want and want


def test_patterns_are_of_listed_sources_only(spark, monkeypatch):
    """Any number of sources that no mix lists makes no more patterns."""
    monkeypatch.setattr(m, "MOST_PATTERNS", 4)
    rows = [(i, ["big", f"unlisted{i}"] if i % 2 else [f"unlisted{i}", "big", "small", "small"], 10, "x") for i in range(100)]
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.5), ("m", "small", 0.5, 1, 0.5)], TARGETS)
    plan, routes = m.plan_mixes(docs(spark, rows), targets)
    assert {r.source: r.tokens for r in plan.collect()} == {"big": 250, "small": 250}
    got = m.select_documents(docs(spark, rows), routes, targets).groupBy("source").sum("tokens").collect()
    assert {r[0]: r[1] for r in got} == {"big": 250, "small": 250}


def test_empty(spark):
    targets = spark.createDataFrame([("m", "a", 0.5, None, None), ("m", None, None, 1, 1.0)], TARGETS)
    plan, routes = m.plan_mixes(docs(spark, []), targets)
    assert plan.count() == 2 and m.select_documents(docs(spark, []), routes, targets).count() == 0
    plan, _ = m.plan_mixes(docs(spark, [(1, ["a"], 5, "x")]), targets.limit(0))
    assert plan.count() == 0
