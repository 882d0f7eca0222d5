"""Problem 1: publication receipts as flat related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..session import table


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shred_receipts(table(spark, sf_dir, "receipts"), "receipt_no", ["received_at", "delivery_no"], "body")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(spark, sf_dir).select("receipt_no", "child_table", "child_key", "parent_key")


def p1_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per receipt: the common columns and the number of its records by table."""
    c = children(spark, sf_dir)
    pick = lambda kind, key, name: F.max(F.when((F.col("child_table") == kind) & (F.col("child_key") == key), F.col("fields")[name]))
    counts = [F.count_if(F.col("child_table") == k).alias(f"n_{k}") for k in ("gates", "evidence", "tracks", "items", "rounds")]
    return c.groupBy("receipt_no").agg(
        pick("a1_context", "decision", "decision").alias("a1_context_decision"),
        pick("artifacts", "results.json", "digest").alias("artifacts_results_json"),
        pick("binaries", "a2_sha256", "digest").alias("binaries_a2_sha256"),
        *counts,
    )


def _typed(kind: str):
    return lambda spark, sf_dir: nested.typed_table(children(spark, sf_dir), kind)


def _subtype(name: str):
    return lambda spark, sf_dir: nested.subtype_table(children(spark, sf_dir), name)


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(spark, sf_dir).groupBy("child_table", "subtype", "variant").agg(F.count("*").alias("n_rows"))


SPLIT = [name for kind, known in nested.SUBTYPES.items() for name in known if len(known) > 1]  # kinds of one subtype are its table
QUERIES = {"p1_found": p1_found, "p1_receipts": p1_receipts, **{f"p1_{kind}": _typed(kind) for kind in nested.SUBTYPES}, **{f"p1_{name}": _subtype(name) for name in SPLIT}, "p1_variants": p1_variants}

# Receipts are the whole body or lie under one of two members; sections may be encoded as text, lone or in an array.
_DECODED = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'NULL' THEN [] ELSE [{0}] END"


def _rows(name: str, above: str, member: str, key: str) -> str:
    """CTEs of the elements of a member that is a list or a lone object, with the keys of those above."""
    return f"""{name}_s AS (SELECT receipt_no, {key} AS up, {_DECODED.format('x')} AS x FROM (SELECT *, j -> '{member}' AS x FROM {above}) WHERE x IS NOT NULL),
{name}_l AS (SELECT receipt_no, up, json_type(x) = 'ARRAY' AS listed, {_LIST.format('x')} AS l FROM {name}_s),
{name} AS (SELECT * FROM (SELECT receipt_no, up, listed, i AS at, CASE WHEN up = '' THEN '' ELSE up || '/' END || i AS path, {_DECODED.format('l[i + 1]')} AS j FROM (SELECT *, unnest(range(len(l))) AS i FROM {name}_l)) WHERE json_type(j) <> 'NULL')"""


_SQL = f"""
WITH d AS (SELECT receipt_no, CAST(body AS JSON) AS j FROM (SELECT *, row_number() OVER (PARTITION BY receipt_no ORDER BY received_at DESC, delivery_no DESC) AS rn FROM receipts WHERE json_valid(body)) WHERE rn = 1),
r AS (SELECT receipt_no, coalesce(j -> 'receipt', j -> 'payload', j) AS j FROM d),
{_rows('contexts', 'r', 'a1_context', "''")},
{_rows('gates', 'r', 'gates', "''")},
{_rows('evidence', 'gates', 'evidence', 'path')},
{_rows('tracks', 'r', 'tracks', "''")},
{_rows('items', 'tracks', 'items', 'path')},
{_rows('rounds', 'items', 'rounds', 'path')},
named AS (SELECT receipt_no, unnest(['artifacts', 'binaries']) AS kind, unnest([j -> 'artifacts', j -> 'binaries']) AS x FROM r),
sections AS (SELECT receipt_no, kind, {_DECODED.format('x')} AS x FROM named WHERE x IS NOT NULL),
maps AS (SELECT receipt_no, kind, unnest(json_keys(x)) AS name, x FROM sections WHERE json_type(x) = 'OBJECT'),
members AS (SELECT receipt_no, kind, name, json_extract(x, '$."' || name || '"') AS v FROM maps),
trees AS (SELECT receipt_no, kind, name || '.' || unnest(json_keys(v)) AS name, unnest(CAST(json_extract(v, '$.*') AS JSON[])) ->> '$' AS digest, 'tree' AS form FROM members WHERE json_type(v) = 'OBJECT'),
digests AS (SELECT receipt_no, kind, name, v ->> '$' AS digest, CASE WHEN (receipt_no, kind) IN (SELECT (receipt_no, kind) FROM trees) THEN 'tree' ELSE 'map' END AS form FROM members WHERE json_type(v) = 'VARCHAR' UNION ALL SELECT * FROM trees UNION ALL
  SELECT receipt_no, kind, coalesce(e ->> 'file', e ->> 'path', e ->> 'name'), coalesce(e ->> 'sha256', e ->> 'digest'), 'entry' FROM (SELECT receipt_no, kind, unnest(CAST(x AS JSON[])) AS e FROM sections WHERE json_type(x) = 'ARRAY')),
found AS (SELECT receipt_no, 'a1_context' AS child_table, 'decision' AS child_key, '' AS parent_key FROM contexts WHERE coalesce(json_type(j, 'decision'), 'NULL') <> 'NULL'
  UNION ALL SELECT receipt_no, kind, name, '' FROM digests WHERE digest <> ''
  UNION ALL SELECT receipt_no, 'gates', path, '' FROM gates UNION ALL SELECT receipt_no, 'evidence', path, up FROM evidence
  UNION ALL SELECT receipt_no, 'tracks', path, '' FROM tracks UNION ALL SELECT receipt_no, 'items', path, up FROM items UNION ALL SELECT receipt_no, 'rounds', path, up FROM rounds)
"""
_BYTES = "CASE WHEN j ->> 'peak_rss_bytes' LIKE '%MiB' THEN CAST(CAST(trim(replace(j ->> 'peak_rss_bytes', 'MiB', '')) AS DOUBLE) * 1048576 AS BIGINT) ELSE TRY_CAST(j ->> 'peak_rss_bytes' AS BIGINT) END AS peak_rss_bytes"
_COLUMNS = {
    "gates": "j ->> 'name' AS name, TRY_CAST(j ->> 'passed' AS BOOLEAN) AS passed", "evidence": "j ->> 'file' AS file, TRY_CAST(j ->> 'line' AS BIGINT) AS line", "tracks": "j ->> 'track' AS track",
    "items": "j ->> 'item_id' AS item_id, TRY_CAST(j ->> 'original_bytes' AS BIGINT) AS original_bytes", "rounds": "j ->> 'arm' AS arm, TRY_CAST(j ->> 'elapsed_ns' AS BIGINT) AS elapsed_ns",
}


def _of(kind: str, state: str, more: str = "", where: str = "true") -> str:
    variant = f"CASE WHEN encoded THEN 'encoded ' ELSE '' END || CASE WHEN listed THEN 'array of ' ELSE '' END || {state}"
    up = "path" if kind in ("gates", "tracks") else "up"
    parent = "''" if kind in ("gates", "tracks") else "up"
    section = {"gates": "r", "tracks": "r", "evidence": "gates", "items": "tracks", "rounds": "items"}[kind]
    holder = "''" if section == "r" else "path"
    return _SQL + f""", enc AS (SELECT receipt_no, {holder} AS up, json_type(j -> '{kind}') = 'VARCHAR' AS encoded FROM {section} WHERE (j -> '{kind}') IS NOT NULL)
SELECT receipt_no, path AS child_key, {parent} AS parent_key, {variant} AS variant, {_COLUMNS[kind]}{more} FROM {kind} JOIN enc USING (receipt_no, up) WHERE {where}"""


_ACTUAL, _MEMORY = "json_type(j, 'actual') IS NOT NULL", "json_type(j, 'peak_rss_bytes') IS NOT NULL"
_MORE = {"gates": ", TRY_CAST(j ->> 'actual' AS DOUBLE) AS actual", "rounds": f", {_BYTES}"}
_PICKS = ", ".join(f"count(*) FILTER (WHERE child_table = '{k}') AS n_{k}" for k in ("gates", "evidence", "tracks", "items", "rounds"))
ORACLES: dict[str, str] = {
    "p1_found": _SQL + "SELECT * FROM found",
    "p1_receipts": _SQL + f"""SELECT receipt_no, max((SELECT max(j ->> 'decision') FROM contexts c WHERE c.receipt_no = f.receipt_no)) AS a1_context_decision,
  max((SELECT max(digest) FROM digests g WHERE g.receipt_no = f.receipt_no AND kind = 'artifacts' AND name = 'results.json' AND digest <> '')) AS artifacts_results_json,
  max((SELECT max(digest) FROM digests g WHERE g.receipt_no = f.receipt_no AND kind = 'binaries' AND name = 'a2_sha256' AND digest <> '')) AS binaries_a2_sha256, {_PICKS} FROM found f GROUP BY receipt_no""",
    "p1_a1_context": _SQL + "SELECT receipt_no, 'decision' AS child_key, '' AS parent_key, CASE WHEN encoded THEN 'encoded ' ELSE '' END || 'context' AS variant, j ->> 'candidate_commit' AS candidate_commit, CAST(j ->> 'frozen_peak_rss_limit_mib' AS DOUBLE) AS frozen_peak_rss_limit_mib, j ->> 'decision' AS decision FROM contexts JOIN (SELECT receipt_no, json_type(j -> 'a1_context') = 'VARCHAR' AS encoded FROM r) USING (receipt_no) WHERE coalesce(json_type(j, 'decision'), 'NULL') <> 'NULL'",
    "p1_gates": _of("gates", f"CASE WHEN {_ACTUAL} THEN 'gate_actual' ELSE 'gate' END", _MORE["gates"]),
    "p1_gates_actual": _of("gates", "'gate_actual'", _MORE["gates"], _ACTUAL),
    "p1_gates_plain": _of("gates", "'gate'", "", f"NOT ({_ACTUAL})"),
    "p1_evidence": _of("evidence", "'evidence'"),
    "p1_tracks": _of("tracks", "'track'"),
    "p1_items": _of("items", "'item'"),
    "p1_rounds": _of("rounds", f"CASE WHEN {_MEMORY} THEN 'round_memory' ELSE 'round' END", _MORE["rounds"]),
    "p1_rounds_memory": _of("rounds", "'round_memory'", _MORE["rounds"], _MEMORY),
    "p1_rounds_plain": _of("rounds", "'round'", "", f"NOT ({_MEMORY})"),
}
for _kind in ("artifacts", "binaries"):
    _variant = "CASE form WHEN 'entry' THEN 'array of digest_entry' ELSE 'digest_' || form END AS variant"
    ORACLES[f"p1_{_kind}"] = _SQL + f"SELECT receipt_no, name AS child_key, '' AS parent_key, {_variant}, digest FROM digests WHERE kind = '{_kind}' AND digest <> ''"
    for _form in ("map", "tree", "entry"):
        ORACLES[f"p1_{_kind}_{_form}"] = ORACLES[f"p1_{_kind}"] + f" AND form = '{_form}'"
_SUBTYPE = {
    "a1_context": "'a1_context_typed'", "evidence": "'evidence_typed'", "tracks": "'tracks_typed'", "items": "'items_typed'",
    "gates": "CASE WHEN variant LIKE '%gate_actual' THEN 'gates_actual' ELSE 'gates_plain' END", "rounds": "CASE WHEN variant LIKE '%round_memory' THEN 'rounds_memory' ELSE 'rounds_plain' END",
    **{k: f"'{k}_' || regexp_extract(variant, '[a-z]+$')" for k in ("artifacts", "binaries")},
}
ORACLES["p1_variants"] = "SELECT child_table, subtype, variant, count(*) AS n_rows FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS child_table, {sub} AS subtype, variant FROM ({ORACLES[f'p1_{k}']})" for k, sub in _SUBTYPE.items()) + ") GROUP BY ALL"
