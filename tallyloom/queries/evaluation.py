"""Evaluation algebra over trials: projections, filters, joins, aggregates, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import trials as t
from ..session import staged, table
from .sqlbook import DERIVED, Book, current, medians, summary

book = Book()
M, S, C = (DERIVED[n][1] for n in ("medians", "summary", "current"))

# --- The flagship: medians, totals and the Pareto frontier.


@book.frame(
    "scoreboard_pareto",
    f"""WITH s AS {S} SELECT codec_id, items, compressed_percent, compression_mbps, decompression_mbps FROM s c WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.compressed_bytes <= c.compressed_bytes
    AND o.compression_mbps >= c.compression_mbps AND o.decompression_mbps >= c.decompression_mbps AND (o.compressed_bytes < c.compressed_bytes OR o.compression_mbps > c.compression_mbps OR o.decompression_mbps > c.decompression_mbps))""",
)
def scoreboard_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = staged(summary(spark, sf_dir), "summary")
    return t.pareto_frontier(s, ["codec_id"], [], ["compressed_bytes"], ["compression_mbps", "decompression_mbps"]).select("codec_id", "items", "compressed_percent", "compression_mbps", "decompression_mbps")


book.sql("a01_trial_medians", "SELECT * FROM {medians}")
book.sql("a02_codec_summary", "SELECT * FROM {summary}")

# --- Projections.
book.sql("proj01_compressed_percent", "SELECT trial_id, CASE WHEN original_bytes <> 0 THEN round(100.0 * CAST(compressed_bytes AS DOUBLE) / original_bytes, 6) ELSE CAST(0 AS DOUBLE) END AS compressed_percent FROM {current}")
book.sql("proj02_savings_percent", "SELECT trial_id, CASE WHEN original_bytes <> 0 THEN round(100.0 * (1 - CAST(compressed_bytes AS DOUBLE) / original_bytes), 6) ELSE CAST(0 AS DOUBLE) END AS savings_percent FROM {current}")
book.sql(
    "proj03_throughputs",
    "SELECT trial_id, "
    + ", ".join(f"CASE WHEN {ns} > 0 THEN round((original_bytes / CAST(1000000 AS DOUBLE)) / ({ns} / CAST(1000000000 AS DOUBLE)), 6) ELSE CAST(0 AS DOUBLE) END AS {n}" for n, ns in (("compression_mbps", "compression_ns"), ("decompression_mbps", "decompression_ns"), ("compression_cpu_mbps", "compression_cpu_ns")))
    + " FROM {current}",
)
book.sql(
    "proj04_transfer_costs",
    "SELECT item_id, codec_id, bw AS mbit, CAST(floor(compressed_bytes * 8000 / CAST(bw AS DOUBLE)) AS BIGINT) AS transfer_ns, round((compression_ns + decompression_ns + floor(compressed_bytes * 8000 / CAST(bw AS DOUBLE))) / CAST(1000000 AS DOUBLE), 6) AS total_ms FROM {medians} CROSS JOIN (SELECT 10 AS bw UNION ALL SELECT 100 UNION ALL SELECT 1000) b",
)
book.sql("proj05_bandwidth_keys", "SELECT bw, CASE WHEN bw % 1 = 0 THEN CAST(CAST(bw AS BIGINT) AS STRING) ELSE replace(CAST(bw AS STRING), '.', '_') END AS label FROM (SELECT CAST(100 AS DOUBLE) AS bw UNION ALL SELECT CAST(12.5 AS DOUBLE) UNION ALL SELECT CAST(1000 AS DOUBLE)) b")
book.sql(
    "proj06_gain_percent",
    "SELECT s.codec_id, round((r.compressed_bytes - s.compressed_bytes) / CAST(r.compressed_bytes AS DOUBLE) * 100, 6) AS gain_percent FROM {summary} s CROSS JOIN (SELECT compressed_bytes FROM {summary} WHERE codec_id = 'zstd-3') r",
)
book.sql("proj07_basis_points", "SELECT item_id, codec_id, CAST(floor((original_bytes - compressed_bytes) * 10000 / CAST(original_bytes AS DOUBLE)) AS BIGINT) AS gain_bp FROM {medians} WHERE original_bytes > 0")
book.sql("proj08_ceiling_blocks", "SELECT item_id, codec_id, -CAST(floor(-compressed_bytes / CAST(4096 AS DOUBLE)) AS BIGINT) AS blocks FROM {medians}")
book.sql(
    "proj09_projected_bytes",
    "SELECT item_id, codec_id, compressed_bytes + CAST(ceil(compressed_bytes * 5 / CAST(1000 AS DOUBLE)) AS BIGINT) + 16 * CAST(ceil(compressed_bytes / CAST(1048576 AS DOUBLE)) AS BIGINT) + 64 AS projected_bytes FROM {medians}",
)
book.sql(
    "proj10_ratio_to_leader",
    "SELECT item_id, codec_id, round(original_bytes / CAST(compressed_bytes AS DOUBLE), 6) AS ratio, round(compressed_bytes / CAST(1048576 AS DOUBLE), 6) AS mib, round(100.0 * (compressed_bytes - min(compressed_bytes) OVER (PARTITION BY item_id)) / CAST(min(compressed_bytes) OVER (PARTITION BY item_id) AS DOUBLE), 6) AS larger_than_leader_percent FROM {medians} WHERE compressed_bytes > 0",
)
book.sql("proj11_margin_test", "SELECT m.item_id, m.codec_id, m.compressed_bytes * 100 <= 95 * r.compressed_bytes AS passes FROM {medians} m JOIN (SELECT item_id, compressed_bytes FROM {medians} WHERE codec_id = 'gzip-6') r ON r.item_id = m.item_id")
book.sql(
    "proj12_kill_lines",
    "SELECT s.codec_id, l.arm, s.compressed_bytes * 100 <= l.line * r.compressed_bytes AS survives FROM {summary} s CROSS JOIN (SELECT 'c1' AS arm, 90 AS line UNION ALL SELECT 'c2', 95 UNION ALL SELECT 'c3', 97 UNION ALL SELECT 'c8', 93) l CROSS JOIN (SELECT compressed_bytes FROM {summary} WHERE codec_id = 'zstd-3') r",
)
book.sql("proj13_expansion_allowance", "SELECT item_id, codec_id, compressed_bytes - original_bytes AS expansion, compressed_bytes - original_bytes <= 64 + original_bytes * 0.001 AS allowed FROM {medians}")
book.sql(
    "proj14_savings_and_costs",
    "SELECT m.item_id, m.codec_id, greatest(0, r.compressed_bytes - m.compressed_bytes) AS available_savings, CAST(m.compression_ns AS DOUBLE) / 80 AS false_positive_cost FROM {medians} m JOIN (SELECT item_id, compressed_bytes FROM {medians} WHERE codec_id = 'zstd-9') r ON r.item_id = m.item_id",
)
book.sql("proj15_weighted_ratio", "SELECT codec_id, round(sum(compressed_bytes / CAST(original_bytes AS DOUBLE) * original_bytes) / sum(original_bytes), 9) AS weighted_ratio FROM {medians} WHERE original_bytes > 0 GROUP BY codec_id")

# --- Filters.
book.sql("f01_split_in", "SELECT id, lower(trim(split)) AS split FROM {corpus_items} WHERE lower(trim(split)) IN ('train', 'validation')")
book.sql("f02_valid_trials", "SELECT trial_id, item_id, codec_id FROM {current} WHERE roundtrip_ok")
book.sql("f03_measured_trials", "SELECT trial_id, repetition FROM {current} WHERE roundtrip_ok AND repetition > 0")
book.sql("f04_failures", "SELECT item_id, codec_id, repetition, error FROM {current} WHERE NOT roundtrip_ok")
book.sql("f14_execution_validity", "SELECT trial_id, CASE WHEN coalesce(roundtrip_ok, false) AND coalesce(source_sha256 = restored_sha256, false) AND coalesce(compressed_bytes > 0, false) AND coalesce(compression_ns > 0, false) AND coalesce(decompression_ns > 0, false) THEN 'valid' ELSE 'invalid' END AS execution FROM {current}")
book.sql("f15_available_codecs", "SELECT id, family, CASE WHEN available THEN 'available' ELSE 'unavailable' END AS class FROM {codecs}")
book.sql("f19_digest_violations", "SELECT id, sha256 FROM {corpus_items} WHERE sha256 IS NULL OR NOT (length(sha256) = 64 AND length(regexp_replace(sha256, '[0-9a-f]', '')) = 0)", "SELECT id, sha256 FROM {corpus_items} WHERE sha256 IS NULL OR NOT (length(sha256) = 64 AND length(regexp_replace(sha256, '[0-9a-f]', '', 'g')) = 0)")


@book.frame("f20_undersized_interior", f"SELECT run_id, trial_id, original_bytes FROM (SELECT run_id, trial_id, original_bytes, lead(trial_id) OVER (PARTITION BY run_id ORDER BY order_index, trial_id) AS nxt FROM {C}) x WHERE nxt IS NOT NULL AND original_bytes < 65536")
def undersized_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small segments that are not the last of their run: those that some row has before it."""
    rows = current(spark, sf_dir).select("run_id", "order_index", "trial_id", "original_bytes")
    run = ordered.with_previous(rows, ["run_id"], ["order_index", "trial_id"], {"trial_id": "before", "original_bytes": "n_before"})
    return run.filter("before IS NOT NULL AND n_before < 65536").select("run_id", F.col("before").alias("trial_id"), F.col("n_before").alias("original_bytes"))



# --- Joins.
book.sql("j01_trial_grid", "SELECT i.id AS item_id, c.id AS codec_id FROM {corpus_items} i CROSS JOIN {codecs} c WHERE c.available")
book.sql("j02_manifest_join", "SELECT t.trial_id, i.path, t.source_sha256 = lower(trim(i.sha256)) AS digest_ok FROM {current} t JOIN {corpus_items} i ON i.id = t.item_id")
book.sql("j03_family_lookup", "SELECT t.trial_id, c.family, c.level FROM {current} t JOIN {codecs} c ON c.id = t.codec_id")
book.sql("j04_roster_gaps", "SELECT i.item_id, c.codec_id FROM (SELECT DISTINCT item_id FROM {medians}) i CROSS JOIN (SELECT DISTINCT codec_id FROM {medians}) c LEFT JOIN {medians} m ON m.item_id = i.item_id AND m.codec_id = c.codec_id WHERE m.item_id IS NULL")
book.sql("j05_digest_and_size_join", "SELECT a.trial_id, b.id FROM {current} a JOIN {corpus_items} b ON b.id = a.item_id AND b.sha256 = a.source_sha256 AND b.size_bytes = a.original_bytes")
book.sql("j06_roster_full_outer", "SELECT coalesce(a.item_id, b.id) AS item_id, a.item_id IS NULL AS untried, b.id IS NULL AS unknown FROM (SELECT DISTINCT item_id FROM {current}) a FULL OUTER JOIN {corpus_items} b ON b.id = a.item_id WHERE a.item_id IS NULL OR b.id IS NULL")


@book.frame(
    "j08_item_frontier",
    f"""WITH m AS (SELECT item_id, codec_id, compressed_bytes, compression_ns + decompression_ns AS total_ns FROM {M})
    SELECT * FROM m c WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.item_id = c.item_id AND o.compressed_bytes <= c.compressed_bytes AND o.total_ns <= c.total_ns AND (o.compressed_bytes < c.compressed_bytes OR o.total_ns < c.total_ns))""",
)
def item_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = staged(medians(spark, sf_dir).select("item_id", "codec_id", "compressed_bytes", (F.col("compression_ns") + F.col("decompression_ns")).alias("total_ns")), "medians")
    return t.pareto_frontier(m, ["codec_id"], ["item_id"], ["compressed_bytes", "total_ns"], [])


_COVERAGE = f"""m AS (SELECT item_id, codec_id, compressed_bytes, round((compression_ns + decompression_ns + floor(compressed_bytes * 80.0::double)) / 1e6, 6) AS total_ms FROM {M}),
    p AS (SELECT * FROM m c WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.item_id = c.item_id AND o.compressed_bytes <= c.compressed_bytes AND o.total_ms <= c.total_ms AND (o.compressed_bytes < c.compressed_bytes OR o.total_ms < c.total_ms))),
    v AS (SELECT codec_id, count(*) AS covered FROM m c WHERE EXISTS (SELECT 1 FROM p WHERE p.item_id = c.item_id AND c.compressed_bytes <= p.compressed_bytes * 1.05::double AND c.total_ms <= p.total_ms * 1.10::double) GROUP BY codec_id)"""


@book.frame("j09_frontier_coverage", f"WITH {_COVERAGE} SELECT codec_id, coalesce(covered, 0) AS covered, (SELECT count(DISTINCT item_id) FROM m) AS items, round(100.0::double * coalesce(covered, 0) / (SELECT count(DISTINCT item_id) FROM m), 6) AS coverage_percent FROM (SELECT DISTINCT codec_id FROM m) LEFT JOIN v USING (codec_id)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = medians(spark, sf_dir).select("item_id", "codec_id", "compressed_bytes", F.round((F.col("compression_ns") + F.col("decompression_ns") + F.floor(F.col("compressed_bytes") * 80.0)) / 1e6, 6).alias("total_ms"))
    m = staged(m, "medians")
    return t.frontier_coverage(m, t.pareto_frontier(m, ["codec_id"], ["item_id"], ["compressed_bytes", "total_ms"], []))


book.sql("j10_candidate_absent", "SELECT i.item_id, CASE WHEN m.item_id IS NULL THEN 'missing' ELSE 'measured' END AS state FROM (SELECT DISTINCT item_id FROM {current}) i LEFT JOIN {medians} m ON m.item_id = i.item_id AND m.codec_id = 'jls2'")
_RANGES = "(SELECT 'a' AS family, 100 AS first_id, 999 AS last_id UNION ALL SELECT 'b', 2000, 3999 UNION ALL SELECT 'c', 3500, 3600)"
book.sql("j11_range_select", "SELECT r.family, count(*) AS n, min(e.event_id) AS first_event, max(e.event_id) AS last_event, count(*) = max(r.last_id - r.first_id + 1) AS complete FROM {events} e JOIN " + _RANGES + " r ON e.event_id BETWEEN r.first_id AND r.last_id GROUP BY r.family")
book.sql("j17_trial_matrix_gaps", "SELECT r.run_id, c.codec_id FROM (SELECT DISTINCT run_id FROM {current}) r CROSS JOIN (SELECT DISTINCT codec_id FROM {current}) c EXCEPT SELECT run_id, codec_id FROM {current}")
book.sql("j18_leave_one_out", "SELECT a.codec_id AS held_out, round(avg(b.compressed_percent), 3) AS mean_of_others FROM {summary} a JOIN {summary} b ON a.codec_id <> b.codec_id GROUP BY a.codec_id")
book.sql("j19_shard_roster", "SELECT s.item_category, s.item_split, count(*) AS rows_found, count(DISTINCT s.codec_id) AS codecs_found, (SELECT count(*) FROM {codecs}) AS codecs_expected FROM {current} s GROUP BY s.item_category, s.item_split")
book.sql("j20_receipt_merge", "SELECT a.trial_id, a.recorded_at AS first_at, b.mirrored_at AS second_at FROM {current0} a LEFT JOIN (SELECT trial_id, max(mirrored_at) AS mirrored_at FROM {trials_mirror} GROUP BY trial_id) b ON b.trial_id = a.trial_id".replace("{current0}", "(SELECT trial_id, max(recorded_at) AS recorded_at FROM {trials} GROUP BY trial_id)"))

# --- Aggregates.


@book.frame("a03_item_oracle", f"SELECT item_id, arg_min(codec_id, (compressed_bytes, codec_id)) AS codec_id, min(compressed_bytes) AS compressed_bytes FROM {M} WHERE compressed_bytes IS NOT NULL GROUP BY item_id")
def item_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.item_oracle(medians(spark, sf_dir), "compressed_bytes")


_BW = "(SELECT 10 AS bw UNION ALL SELECT 100 UNION ALL SELECT 1000)"
book.sql(
    "a04_oracle_by_bandwidth",
    "WITH c AS (SELECT item_id, codec_id, bw, round((compression_ns + decompression_ns + floor(compressed_bytes * 8000 / CAST(bw AS DOUBLE))) / CAST(1000000 AS DOUBLE), 6) AS ms FROM {medians} CROSS JOIN " + _BW + " b WHERE compressed_bytes IS NOT NULL AND compression_ns IS NOT NULL AND decompression_ns IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY bw, item_id ORDER BY ms, codec_id) AS place FROM c) SELECT bw, codec_id, count(*) AS times_best FROM r WHERE place = 1 GROUP BY bw, codec_id",
)
book.sql("a05_repetition_summary", "SELECT repetition, codec_id, count(*) AS trials, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes, CAST(sum(original_bytes) AS BIGINT) AS original_bytes FROM {current} WHERE roundtrip_ok AND repetition > 0 GROUP BY repetition, codec_id")


_REPS = "SELECT codec_id, repetition, CASE WHEN sum(original_bytes) > 0 THEN 100 * CAST(sum(compressed_bytes) AS DOUBLE) / sum(original_bytes) ELSE 0 END AS compressed_percent, CASE WHEN sum(compression_ns) > 0 THEN sum(original_bytes) / CAST(1000000 AS DOUBLE) / (sum(compression_ns) / CAST(1000000000 AS DOUBLE)) ELSE 0 END AS compression_mbps, CASE WHEN sum(decompression_ns) > 0 THEN sum(original_bytes) / CAST(1000000 AS DOUBLE) / (sum(decompression_ns) / CAST(1000000000 AS DOUBLE)) ELSE 0 END AS decompression_mbps FROM {current} WHERE roundtrip_ok AND repetition > 0 GROUP BY codec_id, repetition"
book.sql(
    "a06_metric_distribution",
    "WITH r AS (" + _REPS + "), v AS (SELECT codec_id, 'compressed_percent' AS metric, compressed_percent AS value FROM r UNION ALL SELECT codec_id, 'compression_mbps', compression_mbps FROM r UNION ALL SELECT codec_id, 'decompression_mbps', decompression_mbps FROM r) SELECT codec_id, metric, count(*) AS repetitions, round(median(value), 6) AS median, round(coalesce(CASE WHEN avg(value) <> 0 THEN 100 * stddev_samp(value) / avg(value) END, 0), 5) AS cv_percent, round(min(value), 6) AS least, round(max(value), 6) AS most FROM v GROUP BY codec_id, metric",
)
book.sql(
    "a04_oracle_totals",
    "WITH c AS (SELECT item_id, codec_id, bw, (compression_ns + decompression_ns + floor(compressed_bytes * 8000 / CAST(bw AS DOUBLE))) / CAST(1000000 AS DOUBLE) AS ms FROM {medians} CROSS JOIN (SELECT 10 AS bw UNION ALL SELECT 100 UNION ALL SELECT 1000) b WHERE compressed_bytes IS NOT NULL AND compression_ns IS NOT NULL AND decompression_ns IS NOT NULL), o AS (SELECT bw, sum(best) AS oracle_ms FROM (SELECT bw, item_id, min(ms) AS best FROM c GROUP BY bw, item_id) x GROUP BY bw), f AS (SELECT bw, codec_id, ms, row_number() OVER (PARTITION BY bw ORDER BY ms, codec_id) AS place FROM (SELECT bw, codec_id, (compression_ns + decompression_ns + floor(compressed_bytes * 8000 / CAST(bw AS DOUBLE))) / CAST(1000000 AS DOUBLE) AS ms FROM {summary} CROSS JOIN (SELECT 10 AS bw UNION ALL SELECT 100 UNION ALL SELECT 1000) b) y) SELECT o.bw, f.codec_id AS best_fixed_codec, round(o.oracle_ms, 3) AS oracle_ms, round(f.ms, 3) AS best_fixed_ms, round(100 * (1 - o.oracle_ms / f.ms), 6) AS gain_percent FROM o JOIN f ON f.bw = o.bw AND f.place = 1",
)
book.sql("j07_pareto_pairs", "SELECT a.codec_id, b.codec_id AS dominated FROM {summary} a JOIN {summary} b ON a.codec_id <> b.codec_id AND a.compressed_bytes <= b.compressed_bytes AND a.compression_mbps >= b.compression_mbps AND a.decompression_mbps >= b.decompression_mbps AND (a.compressed_bytes < b.compressed_bytes OR a.compression_mbps > b.compression_mbps OR a.decompression_mbps > b.decompression_mbps)")


@book.frame(
    "a06_trial_distribution",
    f"""WITH v AS (SELECT codec_id, unnest(['compression_ns', 'decompression_ns']) AS metric, unnest([compression_ns, decompression_ns]) AS value FROM {C} WHERE roundtrip_ok AND repetition > 0)
    SELECT codec_id, metric, count(value) AS n, min(value) AS least, max(value) AS most, round(coalesce(CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / avg(value) * 100 END, 0), 4) AS cv_percent, quantile_cont(value, 0.5) AS median FROM v WHERE value IS NOT NULL GROUP BY codec_id, metric""",
)
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = current(spark, sf_dir).filter("roundtrip_ok AND repetition > 0")
    v = v.select("codec_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("compression_ns", "decompression_ns")]))).filter("value IS NOT NULL")
    v = staged(v, "measures")
    cv = F.when(F.avg("value") != 0, F.stddev_samp("value") / F.avg("value") * 100)
    moments = v.groupBy("codec_id", "metric").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.coalesce(cv, F.lit(0.0)), 4).alias("cv_percent"))
    return moments.join(ordered.exact_quantiles(v, ["codec_id", "metric"], "value", {"median": 0.5}), ["codec_id", "metric"])


@book.frame("a07_point_medians", f"SELECT codec_id, round(median(value), 6) AS median FROM (SELECT codec_id, repetition, sum(original_bytes) / 1e6::double / (sum(compression_ns) / 1e9::double) AS value FROM {C} WHERE roundtrip_ok AND repetition > 0 AND compression_ns > 0 GROUP BY codec_id, repetition) GROUP BY codec_id")
def point_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medians that the bootstrap intervals are about."""
    return bootstrap_ci(spark, sf_dir).select("codec_id", F.round("median", 6).alias("median"))


@book.frame("a07_bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the median over repetitions of each codec's throughput."""
    r = current(spark, sf_dir).filter("roundtrip_ok AND repetition > 0 AND compression_ns > 0")
    per = r.groupBy("codec_id", "repetition").agg((F.sum("original_bytes") / 1e6 / (F.sum("compression_ns") / 1e9)).alias("value"))
    return t.bootstrap_medians(per.select("codec_id", F.lit("compression_mbps").alias("metric"), "repetition", "value"))


book.sql(
    "a08_coverage_range",
    "WITH m AS (SELECT item_id, codec_id, repetition, min(compressed_bytes) AS b FROM {current} WHERE roundtrip_ok AND repetition > 0 GROUP BY item_id, codec_id, repetition), p AS (SELECT item_id, repetition, min(b) AS best FROM m GROUP BY item_id, repetition), c AS (SELECT m.codec_id, m.repetition, 100.0 * CAST(sum(CASE WHEN m.b <= p.best * 1.05 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pct FROM m JOIN p ON p.item_id = m.item_id AND p.repetition = m.repetition GROUP BY m.codec_id, m.repetition) SELECT codec_id, round(min(pct), 6) AS lowest, round(max(pct), 6) AS highest, round(max(pct) - min(pct), 6) AS spread FROM c GROUP BY codec_id",
)
book.sql("a09_all_checks", "SELECT codec_id, bool_and(roundtrip_ok) AS exact, bool_and(coalesce(compressed_bytes <= original_bytes, false)) AS never_expands FROM {current} GROUP BY codec_id")


@book.frame(
    "a10_holdout_commitment",
    "SELECT s AS split, count(*) AS items, sum(size_bytes)::bigint AS bytes, sum(('0x' || substr(sha256(id || chr(9) || coalesce(sha256, '')), 1, 12))::bigint)::bigint AS commitment FROM (SELECT *, lower(trim(split)) AS s FROM corpus_items) GROUP BY s",
)
def holdout_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free commitment: the sum of the leading 48 bits of each item's SHA-256, so no split is ever collected."""
    i = table(spark, sf_dir, "corpus_items").withColumn("split", F.lower(F.trim("split")))
    bits = F.conv(F.substring(F.sha2(F.concat("id", F.lit("\t"), F.coalesce("sha256", F.lit(""))), 256), 1, 12), 16, 10).cast("bigint")
    return i.groupBy("split").agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"), F.sum(bits).alias("commitment"))


book.sql("a20_category_headroom", "WITH b AS (SELECT m.item_id, m.codec_id, i.category, m.compressed_bytes FROM {medians} m JOIN {corpus_items} i ON i.id = m.item_id), f AS (SELECT category, codec_id, CAST(sum(compressed_bytes) AS BIGINT) AS total, count(*) AS items FROM b GROUP BY category, codec_id), o AS (SELECT category, CAST(sum(best) AS BIGINT) AS oracle FROM (SELECT category, item_id, min(compressed_bytes) AS best FROM b GROUP BY category, item_id) x GROUP BY category), s AS (SELECT category, count(DISTINCT item_id) AS items FROM b GROUP BY category) SELECT o.category, o.oracle, s.items FROM o JOIN s ON s.category = o.category")
book.sql("a21_conservative_speed", "WITH r AS (SELECT item_category, codec_id, repetition, CAST(sum(original_bytes) AS DOUBLE) / sum(compression_ns) AS speed, max(compression_peak_rss_bytes) AS rss FROM {current} WHERE roundtrip_ok AND repetition > 0 AND compression_ns > 0 AND original_bytes IS NOT NULL GROUP BY item_category, codec_id, repetition) SELECT item_category, codec_id, round(min(speed) * 1000, 6) AS slowest_mbps, max(rss) AS max_rss FROM r GROUP BY item_category, codec_id")
book.sql("a22_backend_counts", "SELECT codec_id, selected_backend, count(*) AS n FROM {current} GROUP BY codec_id, selected_backend")
book.sql("a23_batch_means", "SELECT run_id, codec_id, round(avg(compression_ns), 3) AS mean_ns, round(avg(selector_ns), 3) AS mean_selector_ns, max(compression_peak_rss_bytes) AS max_rss, count(DISTINCT selected_backend) = 1 AS single_backend FROM {current} GROUP BY run_id, codec_id")
book.sql("a25_classification_metrics", "WITH w AS (SELECT item_id, min(CASE WHEN codec_id = 'zstd-9' THEN compressed_bytes END) AS a, min(CASE WHEN codec_id = 'lzma-6' THEN compressed_bytes END) AS b, min(original_bytes) AS o FROM {medians} GROUP BY item_id), c AS (SELECT *, b < a AS wins, o > 4000000 AS predicted FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT CAST(sum(CASE WHEN wins AND predicted THEN a - b ELSE 0 END) AS BIGINT) AS captured, CAST(sum(CASE WHEN wins THEN a - b ELSE 0 END) AS BIGINT) AS available, CAST(sum(CASE WHEN predicted AND NOT wins THEN b - a ELSE 0 END) AS BIGINT) AS regret, count(*) AS items FROM c")
book.sql("a26_cost_objective", "WITH w AS (SELECT item_id, min(CASE WHEN codec_id = 'zstd-9' THEN compressed_bytes END) AS a, min(CASE WHEN codec_id = 'lzma-6' THEN compressed_bytes END) AS b, min(original_bytes) AS o FROM {medians} GROUP BY item_id), t AS (SELECT 1000000 AS line UNION ALL SELECT 4000000 UNION ALL SELECT 8000000) SELECT line, CAST(sum(CASE WHEN b < a AND NOT o > line THEN a - b WHEN NOT b < a AND o > line THEN b - a ELSE 0 END) AS BIGINT) + 4096 AS cost FROM w CROSS JOIN t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY line")
book.sql("a27_upper_bounds", "SELECT item_category, codec_id, count(*) AS n, round(avg(compressed_bytes), 4) AS mean, round(avg(compressed_bytes) + 2 * stddev_pop(compressed_bytes) / sqrt(count(compressed_bytes)), 2) AS upper_bound FROM {current} WHERE roundtrip_ok AND compressed_bytes IS NOT NULL GROUP BY item_category, codec_id")
book.sql("a28_stream_rollup", "SELECT run_id, count(*) AS segments, count_if(selected_backend <> '') AS selected, CASE WHEN count(DISTINCT codec_family) = 1 THEN min(codec_family) ELSE '' END AS single_family, CAST(sum(compressed_bytes) AS BIGINT) AS bytes FROM {current} GROUP BY run_id")
book.sql("a30_attribution_deltas", "SELECT a.codec_id AS arm, b.codec_id AS without, greatest(0, b.compressed_bytes - a.compressed_bytes) AS credit FROM {summary} a JOIN {summary} b ON a.codec_id < b.codec_id")
book.sql("a31_completion", "SELECT codec_id, 25 * (CASE WHEN compressed_percent < 50 THEN 1 ELSE 0 END + CASE WHEN compression_mbps > 10 THEN 1 ELSE 0 END + CASE WHEN decompression_mbps > 50 THEN 1 ELSE 0 END + CASE WHEN expanded_items = 0 THEN 1 ELSE 0 END) AS completion FROM {summary}")
book.sql("a33_artifact_determinism", "SELECT item_id, codec_id, count(DISTINCT compressed_bytes) = 1 AS same_size, count(DISTINCT restored_sha256) = 1 AS same_restored, count(*) AS n FROM {current} WHERE roundtrip_ok GROUP BY item_id, codec_id")
book.sql("a34_segment_gain", "SELECT item_category, CAST(sum(original_bytes) AS BIGINT) AS whole, CAST(sum(least(original_bytes, compressed_bytes)) AS BIGINT) AS safe_upper_bound FROM {current} WHERE roundtrip_ok GROUP BY item_category")
book.sql("a_rollup_categories", "SELECT item_category, codec_id, count(*) AS n, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes FROM {current} WHERE roundtrip_ok GROUP BY ROLLUP (item_category, codec_id)")

# --- Orders, limits and top-k.
book.sql("t01_summary_order", "SELECT row_number() OVER (ORDER BY compressed_percent, codec_id) AS place, codec_id, compressed_percent FROM {summary}")
book.sql("t05_argmin_pairs", "SELECT item_category, min(compressed_bytes) AS compressed_bytes FROM {current} WHERE roundtrip_ok GROUP BY item_category")
book.sql("t07_leader_per_item", "SELECT item_id, codec_id, compressed_bytes FROM (SELECT item_id, codec_id, compressed_bytes, row_number() OVER (PARTITION BY item_id ORDER BY compressed_bytes, codec_id) AS place FROM {medians} WHERE compressed_bytes IS NOT NULL) x WHERE place = 1")
book.sql("t08_rule_routing", "SELECT id, min(rule) AS rule FROM (SELECT id, 1 AS rule FROM {corpus_items} WHERE path LIKE '%.csv' UNION ALL SELECT id, 2 FROM {corpus_items} WHERE category LIKE '%text%' UNION ALL SELECT id, 3 FROM {corpus_items} WHERE size_bytes > 4000000 UNION ALL SELECT id, 9 FROM {corpus_items}) r GROUP BY id")
book.sql("t11_deterministic_order", "SELECT item_id, codec_id, row_number() OVER (PARTITION BY item_id ORDER BY codec_id) AS position FROM {medians}")

# --- Set operations.
book.sql("u01_train_eval_disjoint", "SELECT lower(trim(sha256)) AS digest FROM {corpus_items} WHERE lower(trim(split)) = 'train' AND sha256 IS NOT NULL INTERSECT SELECT lower(trim(sha256)) FROM {corpus_items} WHERE lower(trim(split)) <> 'train' AND sha256 IS NOT NULL")
book.sql("u02_roster_equality", "(SELECT DISTINCT codec_id, 'only trials' AS side FROM {trials} WHERE codec_id NOT IN (SELECT id FROM {codecs})) UNION ALL (SELECT id, 'only codecs' FROM {codecs} WHERE id NOT IN (SELECT codec_id FROM {trials} WHERE codec_id IS NOT NULL))")
book.sql("u03_competitor_union", "SELECT codec AS competitor, complete_bytes AS bytes, 'census' AS origin FROM {codec_census} WHERE exact_roundtrip UNION ALL SELECT codec_id, compressed_bytes, 'trials' FROM {summary}")
book.sql("u04_skip_imported", "SELECT s.dataset FROM {estimator_sources} s LEFT ANTI JOIN {corpus_items} i ON lower(trim(i.sha256)) = lower(trim(s.digest))", "SELECT s.dataset FROM {estimator_sources} s ANTI JOIN {corpus_items} i ON lower(trim(i.sha256)) = lower(trim(s.digest))")
book.sql("u05_extension_lanes", "SELECT DISTINCT regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) AS extension FROM {corpus_items}")
book.sql("u07_duplicate_trials", "SELECT trial_id, count(*) AS versions FROM {trials} GROUP BY trial_id HAVING count(*) > 1")
book.sql("u08_manifest_projection", "SELECT l.id, i.size_bytes, i.id IS NULL AS missing FROM (SELECT DISTINCT item_id AS id FROM {trials}) l LEFT JOIN {corpus_items} i ON i.id = l.id")
book.sql("u09_unknown_codecs", "SELECT DISTINCT c.codec FROM {codec_census} c LEFT JOIN {codecs} k ON k.id = c.codec WHERE k.id IS NULL")

# --- Ordered state over trials.


@book.frame("w10_running_cap", f"SELECT run_id, trial_id, original_bytes, running_size FROM (SELECT run_id, trial_id, original_bytes, sum(coalesce(original_bytes, 0)) OVER (PARTITION BY run_id ORDER BY order_index, trial_id ROWS UNBOUNDED PRECEDING)::bigint AS running_size FROM {C}) WHERE running_size <= 200000000")
def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current(spark, sf_dir).select("run_id", "order_index", "trial_id", "original_bytes")
    return ordered.prefix_under_cap(rows, ["run_id"], ["order_index", "trial_id"], "original_bytes", 200_000_000).drop("order_index")


book.sql("w14_range_overlap", "SELECT family, first_id, coalesce(lag(last_id) OVER (ORDER BY first_id) >= first_id, false) AS overlaps FROM " + _RANGES + " r")
book.sql("w15_strictly_increasing", "SELECT lane, file_no, file_name FROM (SELECT lane, file_no, file_name, lag(file_name) OVER (PARTITION BY lane ORDER BY file_no) AS before FROM (SELECT DISTINCT lane, file_no, file_name FROM {run_files}) f) x WHERE before >= file_name")
book.sql("w17_seeded_order", "SELECT item_id, codec_id, row_number() OVER (PARTITION BY item_id ORDER BY md5(concat('20260715', item_id, codec_id)), codec_id) AS position FROM {medians}")


@book.frame("w18_segment_snapshots", f"SELECT run_id, segment, count(*) AS records, min(order_index) AS first_index FROM (SELECT run_id, order_index, ((sum(coalesce(compressed_bytes, 0)) OVER (PARTITION BY run_id ORDER BY order_index, trial_id ROWS UNBOUNDED PRECEDING) - coalesce(compressed_bytes, 0)) // 16777216)::bigint AS segment FROM {C}) GROUP BY run_id, segment")
def segment_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current(spark, sf_dir).select("run_id", "order_index", "trial_id", F.coalesce("compressed_bytes", F.lit(0)).alias("n_bytes"))
    run = ordered.running_total(rows, ["run_id"], ["order_index", "trial_id"], "n_bytes", "upto")
    return run.groupBy("run_id", F.expr("(upto - n_bytes) div 16777216").alias("segment")).agg(F.count("*").alias("records"), F.min("order_index").alias("first_index"))




@book.frame("w19_budgeted_sweep", f"SELECT codec_id, item_id, CASE WHEN position <= 10 THEN 'run' ELSE 'skipped_budget_cap' END AS status FROM (SELECT codec_id, item_id, row_number() OVER (PARTITION BY codec_id ORDER BY item_id) AS position FROM {M}) x")
def budgeted_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ordered.running_total(medians(spark, sf_dir).select("codec_id", "item_id"), ["codec_id"], ["item_id"], F.lit(1), "position")
    return run.select("codec_id", "item_id", F.when(F.col("position") <= 10, "run").otherwise("skipped_budget_cap").alias("status"))



QUERIES, ORACLES = book.queries, book.oracles
