"""Streaming forms, sinks and rosters as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..plans import gates, reports
from ..session import own_path, table
from ..sources import files, sinks
from ..streaming import events as e
from .sqlbook import DERIVED, Book, summary

book = Book()
_UPTO = "sum(coalesce(strlen(props), 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@book.frame("g03_stream_accounts", "SELECT event_type, count(*) AS n, sum(strlen(props))::bigint AS n_bytes, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def stream_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.run_to_table(e.running_accounts(e.file_stream(spark, f"{sf_dir}/events.parquet")), "accounts", "complete")


@book.frame("g01_stream_segments", f"SELECT user_id, event_id, (({_UPTO} - coalesce(strlen(props), 0)) // 256)::bigint AS segment FROM events")
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.run_to_table(e.segments(e.file_stream(spark, f"{sf_dir}/events.parquet")), "segments")


@book.frame("g05_stream_reuse", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, coalesce(props, '') ORDER BY event_id) > 1 AS reused FROM events")
def stream_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.run_to_table(e.first_sights(e.file_stream(spark, f"{sf_dir}/events.parquet")), "reuse")


@book.frame("k01_write_once", "SELECT r_regionkey, r_name FROM region")
def write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "sinks", "table")
    sinks.write_once(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return spark.read.parquet(path)


@book.frame("k06_immutable_rewrite", "SELECT n_nationkey, n_name FROM nation")
def immutable_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after it was written twice with equal rows."""
    path = own_path(spark, "sinks", "table")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.write_immutable(nation, path)
    sinks.write_immutable(nation, path)
    return spark.read.parquet(path)


@book.frame("k03_results_round_trip", f"SELECT codec_id, items, compressed_bytes FROM {DERIVED['summary'][1]}")
def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "sinks", "table")
    sinks.write_results(summary(spark, sf_dir).select("codec_id", "items", "compressed_bytes"), path)
    return spark.read.schema("codec_id string, items bigint, compressed_bytes bigint").option("header", "true").csv(f"{path}/csv")


@book.frame("k05_manifest_round_trip", "SELECT id, path, size_bytes FROM corpus_items")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "sinks", "table")
    sinks.write_manifest(table(spark, sf_dir, "corpus_items").select("id", "path", "size_bytes"), path)
    return spark.read.schema("id string, path string, size_bytes bigint").json(path)


@book.frame("k07_checksums")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.checksums(spark, sf_dir)


@book.frame("k04_gate_checks", f"""SELECT codec_id, unnest(['compressed_percent', 'compression_mbps', 'decompression_mbps']) AS name, unnest([coalesce(compressed_percent <= 60, false), coalesce(compression_mbps >= 5, false), coalesce(decompression_mbps >= 50, false)]) AS passed,
    unnest([compressed_percent, compression_mbps, decompression_mbps]) AS actual, unnest([60.0::double, 5.0::double, 50.0::double]) AS required FROM {DERIVED['summary'][1]}""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.threshold_checks(summary(spark, sf_dir), "codec_id", {"compressed_percent": ("most", 60), "compression_mbps": ("least", 5), "decompression_mbps": ("least", 50)})


@book.frame("u02_roster_violations", "SELECT id, 'missing' AS side FROM codecs WHERE id NOT IN (SELECT codec FROM codec_census) UNION ALL SELECT DISTINCT codec, 'unexpected' FROM codec_census WHERE codec NOT IN (SELECT id FROM codecs)")
def roster_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "codec_census").select(F.col("codec").alias("id")).distinct()
    return gates.roster_violations(found, table(spark, sf_dir, "codecs").select("id"))


@book.frame("s12_wiki_pages", "SELECT doc_id AS page_id, path AS title FROM documents WHERE contains(text, '[[') OR contains(text, '{{')")
def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki texts written as a MediaWiki XML dump and read back as articles."""
    d = table(spark, sf_dir, "documents").filter("contains(text, '[[') OR contains(text, '{{')")
    clean = F.regexp_replace("text", r"[^\t\n\r -\uD7FF\uE000-\uFFFD]", "?")
    pages = d.select(F.col("path").alias("title"), F.lit(0).alias("ns"), F.col("doc_id").alias("id"), F.array(F.struct(F.lit(1).alias("id"), F.concat(F.lit("x"), clean).alias("text"))).alias("revision"))
    path = own_path(spark, "sinks", "table")
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return files.wiki_pages(spark, path).select("page_id", "title")


@book.frame("k02_overwrite", "SELECT r_name FROM region")
def overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "sinks", "table")
    sinks.overwrite(table(spark, sf_dir, "nation").select(F.col("n_name").alias("r_name")), path)
    sinks.overwrite(table(spark, sf_dir, "region").select("r_name"), path)
    return spark.read.parquet(path)


_BEST = "CASE WHEN compressed_percent = min(compressed_percent) OVER () THEN 'win: smallest' WHEN expanded_items > 0 THEN 'mixed: some items grow' ELSE 'loss: larger' END"
_CARD = f"""(SELECT codec_id, items, compressed_percent, compression_mbps, CASE WHEN o LIKE 'win%' THEN '✅ ' WHEN o LIKE 'mixed%' THEN '⚠️ ' ELSE '❌ ' END || o AS outcome, row_number() OVER (ORDER BY compressed_percent, codec_id) AS place FROM (SELECT *, {_BEST} AS o FROM {DERIVED['summary'][1]}))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(spark, sf_dir)
    least = s.agg(F.min("compressed_percent").alias("_least"))
    kind = F.when(F.col("compressed_percent") == F.col("_least"), "win: smallest").when(F.col("expanded_items") > 0, "mixed: some items grow").otherwise("loss: larger")
    return s.crossJoin(least).select("codec_id", "items", "compressed_percent", "compression_mbps", reports.outcome(kind).alias("outcome"))


@book.frame("k08_scorecard", f"""SELECT 1 AS line_no, '| codec_id | items | compressed_percent | compression_mbps | outcome |' AS line UNION ALL SELECT 2, '|' || repeat(' --- |', 5) UNION ALL
  SELECT place + 2, '| ' || concat_ws(' | ', codec_id, items, printf('%.2f', compressed_percent), printf('%.2f', compression_mbps), outcome) || ' |' FROM {_CARD}""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered scoreboard, one row per line."""
    return reports.markdown_lines(_scored(spark, sf_dir), ["compressed_percent", "codec_id"])


@book.frame("k08_chart", f"""WITH c AS (SELECT * FROM {_CARD}), n AS (SELECT count(*) AS n, max(compressed_percent) AS m FROM c)
  SELECT 1 AS line_no, printf('<svg xmlns="http://www.w3.org/2000/svg" width="860" height="%d"><title>Percent of the original size</title>', (n + 2) * 20) AS line FROM n UNION ALL
  SELECT place + 1, printf('<g><text x="0" y="%d">%s</text><rect x="180" y="%d" width="%.2f" height="16"/><text x="%.2f" y="%d">%s</text></g>', place * 20 + 14, codec_id, place * 20, round(compressed_percent / m * 600, 2), round(compressed_percent / m * 600, 2) + 184, place * 20 + 14, printf('%.2f', compressed_percent)) FROM c, n UNION ALL
  SELECT n + 2, '</svg>' FROM n""")
def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard as an SVG bar chart, one row per line."""
    return reports.svg_lines(summary(spark, sf_dir), "codec_id", "compressed_percent", ["compressed_percent", "codec_id"], "Percent of the original size")


@book.frame("k04_gate_report", f"""WITH g AS (SELECT codec_id, unnest(['compressed_percent', 'compression_mbps']) AS name, unnest([coalesce(compressed_percent <= 60, false), coalesce(compression_mbps >= 5, false)]) AS passed,
    unnest([compressed_percent, compression_mbps]) AS actual, unnest([60.0::double, 5.0::double]) AS required FROM {DERIVED['summary'][1]})
  SELECT 1 AS line_no, CASE WHEN bool_and(passed) THEN '**PASS**' ELSE '**FAIL**' END AS line FROM g UNION ALL SELECT 2, '' UNION ALL SELECT 3, '| codec_id | name | passed | actual | required |' UNION ALL SELECT 4, '|' || repeat(' --- |', 5) UNION ALL
  SELECT 4 + row_number() OVER (ORDER BY codec_id, name), '| ' || concat_ws(' | ', codec_id, name, CASE WHEN passed THEN '✅ pass' ELSE '❌ fail' END, printf('%.2f', actual), printf('%.2f', required)) || ' |' FROM g""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = gates.threshold_checks(summary(spark, sf_dir), "codec_id", {"compressed_percent": ("most", 60), "compression_mbps": ("least", 5)})
    return reports.gate_lines(checks, ["codec_id", "name"])


@book.frame("g02_ordered_segments", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events")
def ordered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    return ordered.running_total(rows, ["user_id"], ["event_id"], F.lit(1), "position")


QUERIES, ORACLES = book.queries, book.oracles
