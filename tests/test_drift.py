import json

from tallyloom.operators import drift
from tallyloom.session import staged


def changes(spark, files):
    rows = [("l", no, json.dumps(d) if isinstance(d, dict) else d, "x") for no, docs in files for d in docs]
    df = spark.createDataFrame(rows, "lane string, file_no long, body string, path string")
    return {tuple(r) for r in drift.field_changes(staged(drift.path_values(df), "t")).collect()}


def doc(run, config=None, summary=(), **more):
    return {"run_id": run, "schema_version": 1, "config": config or {}, "summary": list(summary), **more}


def test_each_kind_of_change(spark):
    first = [doc("a", {"x": 1, "gone": 1, "t": 5}, [{"s": 1}, {"s": 2}]), doc("b", {"x": 2, "gone": 9, "t": 6}, [{"s": None}])]
    second = [doc("a", {"limits": {"x": 1}, "t": "5"}, [{"z": 1}, {"z": 2.0}]), doc("b", {"limits": {"x": 2}, "new": None}, [{"z": None}])]
    got = changes(spark, [(1, first), (4, second), (4, second)])
    assert got == {("l", 4, "renamed", "config.limits.x", "config.x"), ("l", 4, "renamed", "summary.z", "summary.s"), ("l", 4, "removed", "config.gone", ""), ("l", 4, "added", "config.new", ""), ("l", 4, "type", "config.t", "")}


def test_no_rename_without_shared_runs_or_across_sections(spark):
    got = changes(spark, [(1, [doc("a", {"x": 1})]), (2, [doc("b", {"y": 1})])])
    assert got == {("l", 2, "removed", "config.x", ""), ("l", 2, "added", "config.y", "")}
    got = changes(spark, [(1, [doc("a", {"x": 1})]), (2, [doc("a", {}, [{"x": 1}])])])
    assert got == {("l", 2, "removed", "config.x", ""), ("l", 2, "added", "summary.x", "")}


def test_equal_signatures_go_by_name(spark):
    got = changes(spark, [(1, [doc("a", {"left": True, "right": True})]), (2, [doc("a", {"left2": True, "right2": True})])])
    assert got == {("l", 2, "renamed", "config.left2", "config.left"), ("l", 2, "renamed", "config.right2", "config.right")}


def test_nulls_have_no_type_and_broken_documents_no_fields(spark):
    assert changes(spark, [(1, [doc("a", {"x": None})]), (2, [doc("a", {"x": 1})])]) == set()
    assert changes(spark, [(1, ["{", None, "[]", doc("a", {"x": 1})]), (2, [doc("a", {"x": 1})])]) == set()


def test_empty(spark):
    df = spark.createDataFrame([], "lane string, file_no long, body string")
    paths = staged(drift.path_values(df), "t")
    found = drift.field_changes(paths)
    assert found.count() == 0 and drift.typed_runs(paths, found).count() == 0


def test_typed_runs_follow_renames_and_report_failed_casts(spark):
    rows = [("l", 1, json.dumps(doc("a", {"warmups": 3}))), ("l", 2, json.dumps(doc("a", {"warm": 3}))), ("l", 2, json.dumps(doc("b", {"warm": "many"})))]
    paths = staged(drift.path_values(spark.createDataFrame(rows, "lane string, file_no long, body string")), "t")
    found = staged(drift.field_changes(paths), "t")
    got = {(r.file_no, r.run_id): r.warmups for r in drift.typed_runs(paths, found).collect()}
    assert got == {(1, "a"): 3, (2, "a"): 3, (2, "b"): None}
    bad = drift.cast_report(paths, found).collect()
    assert [(r.file_no, r.column, r.n_failed, r.sample) for r in bad] == [(2, "warmups", 1, "many")]


def test_tables_hold_every_field_along_long_chains(spark):
    names = ["warmups", *(f"w{i}" for i in range(12))]
    files = [(i, doc("a", {n: i + 3, "splits": ["s"], "runner": {"api": "é\"1"}}, [{"pareto": True, "ns": 1.5}, {"pareto": "odd", "ns": 2}])) for i, n in enumerate(names)]
    # each pair of neighbours shares run "b", whose value tells the rename
    rows = [("l", i, json.dumps(d)) for i, d in files] + [("l", i, json.dumps(doc("b", {n: 7}))) for i, n in enumerate(names)]
    rows = [r for r in rows if json.loads(r[2])["run_id"] == "b" or r[1] in (0, 12)]
    paths = staged(drift.path_values(spark.createDataFrame(rows, "lane string, file_no long, body string")), "t")
    found = staged(drift.field_changes(paths), "t")
    runs = {(r.file_no, r.run_id): r for r in drift.typed_runs(paths, found).collect()}
    assert len(runs) == 15 and all(runs[i, "b"].warmups == 7 for i in range(13)) and runs[12, "a"].warmups == 15
    assert runs[12, "a"].splits == ["s"] and runs[12, "a"].runner_api == 'é"1' and "w3" not in runs[0, "a"]
    rows = {(r.file_no, r.element): (r.pareto, r.ns) for r in drift.typed_summary(paths, found).filter("run_id = 'a'").collect()}
    assert rows == {(0, 0): (True, 1.5), (0, 1): (None, 2.0), (12, 0): (True, 1.5), (12, 1): (None, 2.0)}


def test_casts_of_all_fields_are_reported(spark):
    rows = [("l", 1, json.dumps(doc(r, {"retry": v}, [{"ns": v}]))) for r, v in (("a", 1), ("b", 2), ("c", "odd"))]
    paths = staged(drift.path_values(spark.createDataFrame(rows, "lane string, file_no long, body string")), "t")
    bad = drift.cast_report(paths, staged(drift.field_changes(paths), "t")).collect()
    assert {(r.section, r.column, r.n_values, r.n_failed, r.sample) for r in bad} == {("config", "retry", 3, 1, "odd"), ("summary", "ns", 3, 1, "odd")}


def test_names_that_come_back():
    chain = [(2, "renamed", "y", "x"), (3, "removed", "y", ""), (4, "added", "y", "")]
    assert drift.lane_names(chain) == [("y", 2, None, "x")]
    taken = [(2, "renamed", "y", "x"), (3, "added", "x", "")]
    assert sorted(drift.lane_names(taken)) == [("x", 3, None, "x#2"), ("y", 2, None, "x")]
    assert sorted(drift.lane_names([(2, "renamed", "y", "x"), (2, "renamed", "x", "y")])) == [("x", 2, None, "y"), ("y", 2, None, "x")]
