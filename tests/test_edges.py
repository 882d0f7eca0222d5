import edge_tables

from tallyloom.queries import p1_nested, p2_drift, p3_differences


def test_empty_null_and_repeated_rows(spark, sf_dir, tmp_path):
    out = edge_tables.write(spark, sf_dir, str(tmp_path), ["receipts", "run_files", "trials", "trials_mirror"])
    queries = {**p1_nested.QUERIES, **p2_drift.QUERIES, **p3_differences.QUERIES}
    edge_tables.check(spark, sf_dir, out, queries, ["p1_found", "p2_found", "p3_found"])


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
