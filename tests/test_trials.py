import pytest
from pyspark.sql import functions as F

from tallyloom.operators import trials as t
from tallyloom.plans import gates, reports


def test_frontier(spark):
    rows = [("a", 10, 5.0), ("b", 20, 9.0), ("c", 20, 5.0), ("d", 10, 5.0)]
    df = spark.createDataFrame(rows, "codec_id string, n long, speed double")
    assert {r.codec_id for r in t.pareto_frontier(df, ["codec_id"], [], ["n"], ["speed"]).collect()} == {"a", "b", "d"}
    assert t.pareto_frontier(df.limit(0), ["codec_id"], [], ["n"], ["speed"]).count() == 0


def test_oracle_settles_ties_by_name(spark):
    df = spark.createDataFrame([("i", "b", 1), ("i", "a", 1), ("j", "a", None), ("j", "c", 9)], "item_id string, codec_id string, n long")
    assert {(r.item_id, r.codec_id) for r in t.item_oracle(df, "n").collect()} == {("i", "a"), ("j", "c")}


def test_coverage_of_a_slow_large_candidate_is_zero(spark):
    m = spark.createDataFrame([("i", "good", 500, 10.0), ("i", "bad", 900, 20.0)], "item_id string, codec_id string, compressed_bytes long, total_ms double")
    got = {r.codec_id: r.coverage_percent for r in t.frontier_coverage(m, t.pareto_frontier(m, ["codec_id"], ["item_id"], ["compressed_bytes", "total_ms"], [])).collect()}
    assert got == {"good": 100.0, "bad": 0.0}


def test_bootstrap_is_deterministic_and_holds_the_median():
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    low, high = t.bootstrap_interval(values, "seed")
    assert (low, high) == t.bootstrap_interval(values, "seed") and low <= 3.0 <= high


def test_rates(spark):
    r = spark.range(1).select(t.mbps(F.lit(2_000_000), F.lit(10**9)).alias("a"), t.mbps(F.lit(1), F.lit(0)).alias("b"), t.percent(F.lit(1), F.lit(0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (2.0, 0.0, 0.0)


def test_checks_and_reports(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "k string, v double")
    checks = gates.threshold_checks(df, "k", {"v": ("least", 5)})
    assert {(r.k, r.passed) for r in checks.collect()} == {("a", True), ("b", False)}
    lines = [r.line for r in reports.gate_lines(checks, ["k", "name"]).orderBy("line_no").collect()]
    assert lines == ["**FAIL**", "", "| k | name | passed | actual | required |", "| --- | --- | --- | --- | --- |", "| a | v | ✅ pass | 5.00 | 5.00 |", "| b | v | ❌ fail |  | 5.00 |"]
    assert [r.line for r in reports.gate_lines(checks.filter("k = 'a'"), ["k"]).orderBy("line_no").collect()][0] == "**PASS**"
    assert [r.line for r in reports.gate_lines(checks.limit(0), ["k"]).orderBy("line_no").collect()][0] == "**FAIL**"
    many = reports.markdown_lines(spark.range(2500), ["id"]).orderBy("line_no").collect()
    assert len(many) == 2502 and [r.line_no for r in many] == list(range(1, 2503)) and many[-1].line == "| 2499 |"
    assert gates.roster_violations(df.select("k"), df.select("k").filter("k = 'a'")).collect()[0].side == "unexpected"


def test_markers_escapes_and_charts(spark):
    df = spark.createDataFrame([("win: a|b", 2.0), ("Loss", 1.0), ("odd\\", None), (None, -1.0)], "k string, v double")
    got = [r.o for r in df.select(reports.outcome(F.col("k")).alias("o")).collect()]
    assert got == ["✅ win: a\\|b", "❌ Loss", "— odd\\\\", None]
    lines = [r.line for r in reports.svg_lines(df.fillna({"k": "<&>"}), "k", "v", ["k"], "t").orderBy("line_no").collect()]
    assert len(lines) == 6 and lines[0].startswith("<svg") and lines[-1] == "</svg>" and "&lt;&amp;&gt;" in lines[1]
    import xml.etree.ElementTree as ET

    widths = [float(r.get("width")) for r in ET.fromstring("\n".join(lines)).iter("{http://www.w3.org/2000/svg}rect")]
    assert sorted(widths) == [0.0, 0.0, 300.0, 600.0]
    assert [r.line for r in reports.svg_lines(df.limit(0), "k", "v", ["k"], "t").orderBy("line_no").collect()][-1] == "</svg>"
