import json

import pytest

from tallyloom.operators import nested


def children(body):
    return {(c["child_table"], c["child_key"], c["parent_key"]) for c in nested.receipt_children(json.dumps(body), nested.receipt_automaton())}


BASE = {"schema_version": 1, "candidate_commit": "c", "name": "n"}


def test_sections_in_any_shape():
    evidence = {"file": "f", "line": 1}
    round_ = {"arm": "a1"}
    plain = {**BASE, "gates": [{"name": "g", "passed": True, "evidence": [evidence]}], "tracks": [{"track": "t", "items": [{"item_id": "i", "rounds": [round_]}]}]}
    lone = {**BASE, "gates": {"name": "g", "passed": True, "evidence": evidence}, "tracks": {"track": "t", "items": {"item_id": "i", "rounds": round_}}}
    encoded = {**BASE, "gates": json.dumps(plain["gates"]), "tracks": json.dumps([{"track": "t", "items": json.dumps([{"item_id": "i", "rounds": json.dumps([round_])}])}])}
    want = {("gates", "0", ""), ("evidence", "0/0", "0"), ("tracks", "0", ""), ("items", "0/0", "0"), ("rounds", "0/0/0", "0/0")}
    assert children(plain) == children(lone) == children(encoded) == want
    for envelope in ({"receipt": plain, "sent_by": "x"}, {"payload": lone, "sent_by": "x"}, {"receipt": json.dumps(encoded), "sent_by": "x"}):
        assert children(envelope) == want


def test_digests_in_any_shape():
    for artifacts in ({"results.json": "d", "a.txt": None, "b.txt": ""}, [{"file": "results.json", "sha256": "d"}, {"path": "a.txt", "sha256": None}, None], {"results": {"json": "d"}, "a": {"txt": None}}):
        assert children({**BASE, "artifacts": artifacts}) == {("artifacts", "results.json", "")}


def test_nulls_take_a_position_but_give_no_row():
    assert children({**BASE, "gates": [None, {"name": "g", "passed": True, "evidence": [None, {"file": "f", "line": 2}]}]}) == {("gates", "1", ""), ("evidence", "1/1", "1")}
    assert children({**BASE, "gates": None, "tracks": [], "a1_context": {"decision": None}}) == set()
    assert children({**BASE, "a1_context": {"decision": "x"}}) == {("a1_context", "decision", "")}


@pytest.mark.parametrize("body", ["", "{", '{"a": NaN}', "[1,", "{'a': 1}"])
def test_what_is_not_json_is_refused(body):
    with pytest.raises(ValueError):
        nested.receipt_children(body, nested.receipt_automaton())


@pytest.mark.parametrize("body", ["1", "null", '"text"', "[]", "{}"])
def test_json_without_a_record_has_no_children(body):
    assert nested.receipt_children(body, nested.receipt_automaton()) == []


def test_latest_valid_delivery_counts(spark):
    good = json.dumps({**BASE, "artifacts": {"a": "1"}})
    newer = json.dumps({**BASE, "artifacts": {"b": "2"}})
    rows = [(1, 1, 1, good, "x"), (2, 1, 3, newer[:-1], "x"), (3, 1, 2, newer, "x"), (4, 2, 1, None, "x"), (5, None, 1, good, "x"), (6, 3, 1, good, "x"), (7, 3, 1, newer, "x")]
    df = spark.createDataFrame(rows, "delivery_no long, receipt_no long, received_at long, body string, child_key string")
    got = {(r.receipt_no, r.child_key) for r in nested.shred_receipts(df, "receipt_no", ["received_at", "delivery_no"], "body").collect()}
    assert got == {(1, "b"), (None, "a"), (3, "b")}
    assert nested.shred_receipts(df.limit(0), "receipt_no", ["received_at", "delivery_no"], "body").count() == 0


def test_long_body(spark):
    body = json.dumps({**BASE, "gates": [{"name": "g" * 1000, "passed": True}] * 3000})
    df = spark.createDataFrame([(1, 1, 1, body)], "delivery_no long, receipt_no long, received_at long, body string")
    assert nested.shred_receipts(df, "receipt_no", ["received_at"], "body").count() == 3000


def test_typed_table(spark):
    body = json.dumps({**BASE, "tracks": [{"track": "t", "items": [{"item_id": "i", "rounds": [{"arm": "a", "elapsed_ns": 5, "peak_rss_bytes": "2 MiB"}, {"arm": "b", "elapsed_ns": "x"}]}]}]})
    df = spark.createDataFrame([(1, 1, 1, body)], "delivery_no long, receipt_no long, received_at long, body string")
    rows = nested.typed_table(nested.shred_receipts(df, "receipt_no", ["received_at"], "body"), "rounds").orderBy("child_key").collect()
    assert [(r.arm, r.elapsed_ns, r.peak_rss_bytes) for r in rows] == [("a", 5, 2 << 20), ("b", None, None)]


def test_every_typed_table_is_a_query(spark, sf_dir):
    from tallyloom.queries.p1_nested import QUERIES

    for kind, known in nested.SUBTYPES.items():
        got = QUERIES[f"p1_{kind}"](spark, sf_dir)
        assert all(set(columns) <= set(got.columns) for columns in known.values())
        assert got.count() == QUERIES["p1_found"](spark, sf_dir).filter(f"child_table = '{kind}'").count()
        if len(known) > 1:
            assert got.count() == sum(QUERIES[f"p1_{name}"](spark, sf_dir).count() for name in known)


def routes(body):
    return {(c["child_table"], c["child_key"]): c["subtype"] for c in nested.receipt_children(json.dumps(body), nested.receipt_automaton())}


def test_states_route_to_subtypes():
    body = {
        **BASE, "artifacts": {"a": "1"}, "binaries": [{"name": "b", "sha256": "2"}],
        "gates": [{"name": "g", "passed": True}, {"name": "g", "passed": True, "actual": 3}, {"name": "g"}, "text", {"file": "f", "line": 1}],
        "tracks": json.dumps([{"track": "t", "items": {"item_id": "i", "rounds": [{"arm": "a"}, {"arm": "a", "peak_rss_bytes": None}, 7]}}]),
    }
    assert routes(body) == {
        ("artifacts", "a"): "artifacts_map", ("binaries", "b"): "binaries_entry",
        # what has another shape, even that of another table, stays in its section's table, untyped
        ("gates", "0"): "gates_plain", ("gates", "1"): "gates_actual", ("gates", "2"): "gates_untyped", ("gates", "3"): "gates_untyped", ("gates", "4"): "gates_untyped",
        ("tracks", "0"): "tracks_typed", ("items", "0/0"): "items_typed", ("rounds", "0/0/0"): "rounds_plain", ("rounds", "0/0/1"): "rounds_memory", ("rounds", "0/0/2"): "rounds_untyped",
    }
    assert routes({**BASE, "artifacts": {"a": {"b": "1"}}}) == {("artifacts", "a.b"): "artifacts_tree"}


def test_any_number_of_encodings():
    value = [{"name": "g", "passed": True}]
    for _ in range(8):
        value = json.dumps(value)
    assert children({**BASE, "gates": value}) == {("gates", "0", "")}
