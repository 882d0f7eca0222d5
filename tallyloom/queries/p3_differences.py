"""Problem 3: differences between trials and trials_mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import differences as d
from ..operators.versions import current_rows
from ..session import table

NUMBERS = ["repetition", "original_bytes", "compressed_bytes", "compression_ns", "decompression_ns"]
TEXTS = ["run_id", "item_id", "codec_id", "selected_backend", "error"]
DIGESTS = ["source_sha256", "restored_sha256"]
FIELDS = ["run_id", "item_id", "codec_id", *NUMBERS, "roundtrip_ok", *DIGESTS, "selected_backend", "error"]


def _normal(df: DataFrame) -> list:
    return (
        [F.col(c) for c in NUMBERS]
        + [d.text_value(F.col(c)).alias(c) for c in TEXTS]
        + [d.digest_value(F.col(c)).alias(c) for c in DIGESTS]
        + [d.flag_value(F.col("roundtrip_ok")).alias("roundtrip_ok")]
    )


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials, mirror = table(spark, sf_dir, "trials"), table(spark, sf_dir, "trials_mirror")
    left = current_rows(trials, "trial_id", ["recorded_at"], _normal(trials))
    right = current_rows(mirror, "trial_id", ["recorded_at", "mirrored_at"], _normal(mirror))
    return d.compare_copies(left, right, "trial_id", FIELDS, "missing_in_trials", "missing_in_mirror", tuple(DIGESTS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir).select("trial_id", "issue")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir)


def p3_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir).groupBy("issue").agg(F.count("*").alias("n_rows"))


def _sql_side(name: str, order: str) -> str:
    num = ", ".join(NUMBERS)
    txt = ", ".join(f"coalesce({c}, '') AS {c}" for c in TEXTS)
    dig = ", ".join(f"coalesce(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^(sha-?256|sha-?1|md5)\\s*[:=-]\\s*', ''), '') AS {c}" for c in DIGESTS)
    flag = "CASE WHEN lower(trim(roundtrip_ok::varchar)) IN ('true','t','yes','y','1','on') THEN 'true' WHEN lower(trim(roundtrip_ok::varchar)) IN ('false','f','no','n','0','off') THEN 'false' WHEN trim(roundtrip_ok::varchar) = '' THEN NULL ELSE lower(trim(roundtrip_ok::varchar)) END AS roundtrip_ok"
    return f"(SELECT * FROM (SELECT trial_id, {num}, {txt}, {dig}, {flag}, row_number() OVER (PARTITION BY trial_id ORDER BY {order}) AS rn FROM {name}) WHERE rn = 1)"


def _sql(columns: str) -> str:
    a, b = _sql_side("trials", "recorded_at DESC"), _sql_side("trials_mirror", "recorded_at DESC, mirrored_at DESC")
    parts = [f"SELECT l.trial_id, '{f}' AS issue, l.{f}::varchar AS left_value, r.{f}::varchar AS right_value FROM l JOIN r USING (trial_id) WHERE l.{f} IS DISTINCT FROM r.{f}" for f in FIELDS]
    parts.append("SELECT trial_id, 'missing_in_mirror', NULL, NULL FROM l ANTI JOIN r USING (trial_id)")
    parts.append("SELECT trial_id, 'missing_in_trials', NULL, NULL FROM r ANTI JOIN l USING (trial_id)")
    return f"WITH l AS {a}, r AS {b}, d AS ({' UNION ALL '.join(parts)}) SELECT {columns}"


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p3_issue_counts": p3_issue_counts}
ORACLES = {
    "p3_found": _sql("trial_id, issue FROM d"),
    "p3_values": _sql("* FROM d"),
    "p3_issue_counts": _sql("issue, count(*)::bigint AS n_rows FROM d GROUP BY issue"),
}
