"""Problem 2: drifting fields of benchmark run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift
from ..session import staged, table


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(drift.path_values(table(spark, sf_dir, "run_files")), "p2-paths")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.field_changes(_paths(spark, sf_dir))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    return drift.typed_runs(paths, staged(drift.field_changes(paths), "p2-changes"))


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    return drift.typed_summary(paths, staged(drift.field_changes(paths), "p2-changes"))


def p2_cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    return drift.cast_report(paths, staged(drift.field_changes(paths), "p2-changes"))


def p2_path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = drift.path_values(table(spark, sf_dir, "run_files")).filter("path <> ''")
    return p.groupBy("path").agg(F.bit_or("kinds").alias("kinds"), F.count("*").alias("n_values"), F.count_if(F.col("kinds") == 0).alias("n_null"))


QUERIES = {"p2_found": p2_found, "p2_runs": p2_runs, "p2_summary": p2_summary, "p2_cast_failures": p2_cast_failures, "p2_path_types": p2_path_types}
# Fields of all documents by the JSON tree: their types as bits, and their values with equal numbers spelled alike.
_SQL = r"""
WITH d AS (SELECT lane, file_no, row_number() OVER () AS doc, body FROM run_files WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'),
t AS (SELECT lane, file_no, doc, json_extract_string(body, '$.run_id') AS run_id, replace(j.fullkey, '"', '') AS fullkey, j.type, CAST(j.value AS VARCHAR) AS value FROM d, json_tree(d.body) j),
l AS (SELECT lane, file_no, doc, run_id, CASE WHEN fullkey LIKE '$.summary[%' THEN 'summary.' || regexp_replace(fullkey, '^\$\.summary\[[0-9]+\]\.', '') ELSE substring(fullkey, 3) END AS path,
    TRY_CAST(regexp_extract(fullkey, '^\$\.summary\[([0-9]+)\]', 1) AS BIGINT) AS element,
    CASE type WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 8 WHEN 'NULL' THEN 0 ELSE 2 END AS kind,
    CASE WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) ELSE value END AS value
  FROM t WHERE type <> 'OBJECT' AND (fullkey = '$.schema_version' OR (fullkey LIKE '$.config.%' AND NOT contains(fullkey, '[')) OR regexp_matches(fullkey, '^\$\.summary\[[0-9]+\]\.[^\[]+$'))),
p AS (SELECT lane, file_no, doc, run_id, path, bit_or(kind) AS kinds, string_agg(element || ':' || value, ' ' ORDER BY element) AS listed, max(value) AS single FROM l GROUP BY ALL)"""
_CHANGES = _SQL + r""",
files AS (SELECT lane, file_no, lag(file_no) OVER (PARTITION BY lane ORDER BY file_no) AS prior_no FROM (SELECT DISTINCT lane, file_no FROM run_files)),
s AS (SELECT lane, file_no, path, bit_or(kinds) AS kinds FROM p GROUP BY ALL),
now AS (SELECT f.lane, f.file_no, s.path, s.kinds FROM files f JOIN s ON s.lane = f.lane AND s.file_no = f.file_no WHERE prior_no IS NOT NULL),
old AS (SELECT f.lane, f.file_no, s.path, s.kinds FROM files f JOIN s ON s.lane = f.lane AND s.file_no = f.prior_no),
c AS (SELECT lane, file_no, path, CASE WHEN old.kinds IS NULL THEN 'added' WHEN now.kinds IS NULL THEN 'removed' ELSE 'type' END AS kind FROM now FULL JOIN old USING (lane, file_no, path)
  WHERE old.kinds IS NULL OR now.kinds IS NULL OR (old.kinds <> 0 AND now.kinds <> 0 AND old.kinds & now.kinds = 0)),
v AS (SELECT lane, file_no, run_id, path, max(coalesce(listed, single)) AS value FROM p WHERE run_id IS NOT NULL GROUP BY ALL),
runs AS (SELECT DISTINCT lane, file_no, json_extract_string(body, '$.run_id') AS run_id FROM d),
shared AS (SELECT f.lane, f.file_no, f.prior_no, a.run_id FROM files f JOIN runs a ON a.lane = f.lane AND a.file_no = f.file_no JOIN runs b ON b.lane = f.lane AND b.file_no = f.prior_no AND b.run_id = a.run_id),
g AS (SELECT c.lane, c.file_no, c.kind, c.path, string_split(c.path, '.')[1] AS section, string_agg(v.run_id || '=' || v.value, ';' ORDER BY v.run_id) AS signature FROM c JOIN shared h ON h.lane = c.lane AND h.file_no = c.file_no
  JOIN v ON v.lane = c.lane AND v.file_no = CASE c.kind WHEN 'added' THEN h.file_no ELSE h.prior_no END AND v.run_id = h.run_id AND v.path = c.path WHERE c.kind <> 'type' AND contains(c.path, '.') GROUP BY ALL),
m AS (SELECT a.lane, a.file_no, a.path AS field_path, b.path AS prior_path, levenshtein(a.path, b.path) AS far FROM g a JOIN g b ON b.lane = a.lane AND b.file_no = a.file_no AND b.section = a.section AND b.signature = a.signature WHERE a.kind = 'added' AND b.kind = 'removed'),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane, file_no, field_path ORDER BY far, prior_path) AS i, row_number() OVER (PARTITION BY lane, file_no, prior_path ORDER BY far, field_path) AS j FROM m) WHERE i = 1 AND j = 1)"""
ORACLES: dict[str, str] = {
    "p2_found": _CHANGES + """
SELECT lane, file_no, kind AS change_kind, path AS field_path, '' AS prior_path FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.lane = c.lane AND r.file_no = c.file_no AND ((c.kind = 'added' AND r.field_path = c.path) OR (c.kind = 'removed' AND r.prior_path = c.path)))
UNION ALL SELECT lane, file_no, 'renamed', field_path, prior_path FROM r""",
    "p2_path_types": _SQL + " SELECT path, bit_or(kinds)::int AS kinds, count(*) AS n_values, count(*) FILTER (WHERE kinds = 0) AS n_null FROM p GROUP BY path",
}
