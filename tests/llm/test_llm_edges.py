import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import edge_tables  # noqa: E402

from tallyloom.llm.registry import QUERIES  # noqa: E402

TABLES = ["trials", "corpus_items", "estimator_sources", "codec_census", "documents", "mix_targets"]


def test_empty_null_and_repeated_rows(spark, sf_dir, tmp_path):
    out = edge_tables.write(spark, sf_dir, str(tmp_path), TABLES)
    edge_tables.check(spark, sf_dir, out, QUERIES, ["p4_found", "p5_found", "p6_found", "p7_found"])
    once = sorted((r.doc_id, list(r.ids)) for r in QUERIES["p8_ids"](spark, sf_dir).collect())
    assert sorted((r.doc_id, list(r.ids)) for r in QUERIES["p8_ids"](spark, f"{out}/twice").collect()) == sorted(once * 2)
