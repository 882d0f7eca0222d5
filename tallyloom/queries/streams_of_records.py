"""Scans, record transforms, dictionaries and code lengths over documents, tables and numeric columns."""

from __future__ import annotations

import json
import keyword
import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import frames, mixtures, ordered
from ..operators import records as r
from ..operators import rules, scopes, selectors
from ..session import own_path, staged, table
from ..sources import files
from .sqlbook import Book

book = Book()
docs = lambda spark, d: table(spark, d, "documents")

# --- Scans.
book.sql("s01_manifest_scan", "SELECT id, path, lower(trim(split)) AS split, size_bytes, length(regexp_replace(lower(trim(coalesce(sha256, ''))), '[0-9a-f]', '')) = 0 AND length(trim(sha256)) = 64 AS digest_ok FROM {corpus_items} WHERE lower(trim(split)) IN ('train', 'development')", "SELECT id, path, lower(trim(split)) AS split, size_bytes, length(regexp_replace(lower(trim(coalesce(sha256, ''))), '[0-9a-f]', '', 'g')) = 0 AND length(trim(sha256)) = 64 AS digest_ok FROM {corpus_items} WHERE lower(trim(split)) IN ('train', 'development')")
book.sql("s02_conventional_manifest", "SELECT split, count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM {corpus_items} GROUP BY split")


@book.frame("s03_binary_scan")
def binary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the folder by size and digest."""
    return files.binary_files(spark, sf_dir).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "n_bytes", "sha256")


@book.frame("s01_verified_files", "SELECT CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS problem WHERE false")
def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the folder's files, written and read back, whose files are not there or have another size or digest."""
    found = files.binary_files(spark, sf_dir)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    items = found.select(F.lit(2).alias("schema_version"), F.array(F.struct(name.alias("id"), name.alias("path"), F.lit("train").alias("split"), F.col("n_bytes").alias("size_bytes"), "sha256")).alias("items"))
    path = own_path(spark, "sinks", "manifest")
    items.write.json(path)
    return files.verify_manifest(files.manifest(spark, path, ["train"]), found, found.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1)).first()[0])


def _archived(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The texts as members of archives of their bundles, each of up to 4,096 consecutive ids, named by path and id."""
    part = F.concat_ws("-", "bundle_id", F.expr("doc_id div 4096"))
    member = F.concat("path", F.lit("-"), "doc_id", F.lit(".txt"))
    return files.packed_archives(docs(spark, sf_dir).select(part.alias("archive"), member.alias("member"), F.col("text").cast("binary").alias("content")), kind)


_LINES_DUCK = "(SELECT doc_id, unnest(range(1, len(p) + 1)) AS rec_no, len(p) AS n, p FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"


def _lines(df: DataFrame) -> DataFrame:
    """(doc_id, source, rec_no, record, terminated): records end at line feeds only; the empty rest after the last one
    is no record, an unterminated tail is."""
    parts = df.filter("text IS NOT NULL").select("doc_id", "source", F.split("text", "\n", -1).alias("p"))
    rows = parts.select("doc_id", "source", F.size("p").alias("n"), F.posexplode("p").alias("pos", "record"))
    return rows.filter("pos < n - 1 OR record <> ''").select("doc_id", "source", (F.col("pos") + 1).cast("bigint").alias("rec_no"), "record", (F.col("pos") < F.col("n") - 1).alias("terminated"))


@book.frame("s04_ndjson_records", f"SELECT doc_id, rec_no, strlen(p[rec_no])::bigint AS n_bytes, md5(p[rec_no]) AS digest, rec_no < n AS terminated FROM {_LINES_DUCK} WHERE rec_no < n OR p[rec_no] <> ''")
def ndjson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(docs(spark, sf_dir)).select("doc_id", "rec_no", F.octet_length("record").cast("bigint").alias("n_bytes"), F.md5("record").alias("digest"), "terminated")


@book.frame("s05_log_records", f"SELECT source, count(*) AS records, count_if(rec_no = n) AS unterminated FROM {_LINES_DUCK.replace('SELECT doc_id, unnest', 'SELECT source, unnest')} WHERE rec_no < n OR p[rec_no] <> '' GROUP BY source")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(docs(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("records"), F.count_if(~F.col("terminated")).alias("unterminated"))


@book.frame("s06_any_line_ends", "SELECT doc_id, len(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+'))::bigint AS n_lines FROM documents WHERE text IS NOT NULL")
def any_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+"), 0)).cast("bigint").alias("n_lines"))


_DELIMITERS = [",", ";", "\t", "|"]


def _delimiter(text) -> object:
    """The most frequent of the four candidates; the first of equals."""
    n = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _DELIMITERS]
    most = F.greatest(*n)
    pick = F.when(n[0] == most, _DELIMITERS[0])
    for c, k in zip(_DELIMITERS[1:], n[1:]):
        pick = pick.when(k == most, c)
    return pick


_COUNT_DUCK = [f"(length(text) - length(replace(text, {c}, '')))" for c in ("','", "';'", "chr(9)", "'|'")]
_DELIM_DUCK = "CASE greatest(" + ", ".join(_COUNT_DUCK) + ") " + " ".join(f"WHEN {n} THEN {c}" for n, c in zip(_COUNT_DUCK, ("','", "';'", "chr(9)", "'|'"))) + " END"


@book.frame("a16_delimiter_detect", f"SELECT source, ascii({_DELIM_DUCK})::int AS delimiter, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def delimiter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter("text IS NOT NULL").groupBy("source", F.ascii(_delimiter(F.col("text"))).alias("delimiter")).agg(F.count("*").alias("n"))


def _cells(df: DataFrame) -> DataFrame:
    """(doc_id, row_no, col_no, cell, arity) of delimited texts: no quoting, ragged rows kept."""
    found = df.filter("text IS NOT NULL").withColumn("delimiter", _delimiter(F.col("text")))
    rows = found.select("doc_id", "delimiter", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("row_no", "line")).filter("line <> ''")
    cells = rows.withColumn("cells", F.call_function("split", "line", F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E")), F.lit(-1)))
    return cells.select("doc_id", "row_no", F.size("cells").alias("arity"), F.posexplode("cells").alias("col_no", "cell"))


_CELLS_DUCK = f"""(SELECT doc_id, row_no, len(cells) AS arity, unnest(range(0, len(cells))) AS col_no, cells FROM (SELECT doc_id, row_no, string_split(line, d) AS cells FROM
  (SELECT doc_id, d, unnest(range(0, len(p))) AS row_no, p[row_no + 1] AS line FROM (SELECT doc_id, {_DELIM_DUCK} AS d, string_split(replace(text, chr(13), ''), chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE line <> ''))"""


@book.frame("s07_delimited_scan", f"SELECT doc_id, arity::bigint AS arity, count(DISTINCT row_no) AS n_rows FROM {_CELLS_DUCK} GROUP BY ALL")
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(docs(spark, sf_dir)).groupBy("doc_id", F.col("arity").cast("bigint").alias("arity")).agg(F.countDistinct("row_no").alias("n_rows"))


@book.frame("r03_column_streams", f"SELECT doc_id, col_no::bigint AS col_no, count(*) AS n_values, sum(strlen(cells[col_no + 1]))::bigint AS n_bytes, count(DISTINCT cells[col_no + 1]) AS n_distinct FROM {_CELLS_DUCK} GROUP BY ALL")
def column_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column-major streams of delimited texts by size."""
    c = _cells(docs(spark, sf_dir))
    return c.groupBy("doc_id", F.col("col_no").cast("bigint").alias("col_no")).agg(F.count("*").alias("n_values"), F.sum(F.octet_length("cell")).alias("n_bytes"), F.countDistinct("cell").alias("n_distinct"))


_RUNS = "[ \\t,;|\\r\\n]+|[^ \\t,;|\\r\\n]+"


def _tables(df: DataFrame) -> DataFrame:
    """Texts that are delimited tables: two lines or more, four in five of which hold the text's delimiter."""
    lines = F.filter(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1), lambda x: x != "")
    found = df.filter("text IS NOT NULL").withColumn("_delimiter", _delimiter(F.col("text"))).withColumn("_lines", lines)
    holding = F.size(F.filter("_lines", lambda x: F.contains(x, F.col("_delimiter"))))
    return found.filter((F.size("_lines") >= 2) & (holding >= 0.8 * F.size("_lines"))).select(*df.columns)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are source code: some line defines, imports or returns something."""
    return docs(spark, sf_dir).filter(F.col("text").rlike(r"(?m)^[ \t]*(def \w+\(|class \w+|import \w+|from \w+ import |return\b)"))


@book.frame("s08_token_runs", f"SELECT doc_id, len(regexp_extract_all(text, '{_RUNS}'))::bigint AS n_runs, len(regexp_extract_all(text, '[ \\t,;|\\r\\n]+'))::bigint AS n_separators FROM documents WHERE text IS NOT NULL")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_RUNS), 0)).cast("bigint").alias("n_runs"), F.size(F.regexp_extract_all("text", F.lit("[ \\t,;|\\r\\n]+"), 0)).cast("bigint").alias("n_separators"))


book.sql("s09_source_bundles", "SELECT bundle_id, count(*) AS files, CAST(sum(octet_length(text)) AS BIGINT) AS n_bytes, min(path) AS first_path, max(path) AS last_path, count(DISTINCT path) = count(*) AS unique_paths FROM {documents} WHERE text IS NOT NULL GROUP BY bundle_id", "SELECT bundle_id, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, min(path) AS first_path, max(path) AS last_path, count(DISTINCT path) = count(*) AS unique_paths FROM {documents} WHERE text IS NOT NULL GROUP BY bundle_id")
book.sql("s10_wiki_bundle", "SELECT doc_id, regexp_extract(text, '[|] name = ([^|}}]+)', 1) AS title_line, octet_length(text) AS n_bytes FROM {documents} WHERE contains(text, '[[') OR contains(text, concat(chr(123), chr(123)))", "SELECT doc_id, regexp_extract(text, '[|] name = ([^|}}]+)', 1) AS title_line, strlen(text) AS n_bytes FROM {documents} WHERE contains(text, '[[') OR contains(text, concat(chr(123), chr(123)))")


@book.frame("s11_bundle_prefix", "SELECT doc_id, bundle_id, running_size::bigint AS running_size FROM (SELECT doc_id, bundle_id, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY bundle_id ORDER BY path, doc_id ROWS UNBOUNDED PRECEDING) AS running_size FROM documents) WHERE running_size <= 20000")
def bundle_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each bundle in path order until the first one that exceeds the byte cap."""
    d = docs(spark, sf_dir).select("doc_id", "bundle_id", "path", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return ordered.prefix_under_cap(d, ["bundle_id"], ["path", "doc_id"], "n_bytes", 20_000).select("doc_id", "bundle_id", "running_size")


@book.frame("s11_tar_prefix", "SELECT bundle_id, member, running_size::bigint AS running_size FROM (SELECT bundle_id, path || '-' || doc_id || '.txt' AS member, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY bundle_id ORDER BY path || '-' || doc_id || '.txt' ROWS UNBOUNDED PRECEDING) AS running_size FROM documents) WHERE running_size <= 20000")
def tar_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe text members of the bundles' tar archives in path order until the first one that exceeds the byte cap."""
    members = files.safe_members(files.tar_members(_archived(spark, sf_dir, "tar")), ["txt"])
    sized = members.select(F.regexp_replace("archive", "-[0-9]+$", "").alias("bundle_id"), "member", F.octet_length("content").cast("bigint").alias("n_bytes"))
    return ordered.prefix_under_cap(sized, ["bundle_id"], ["member"], "n_bytes", 20_000).select("bundle_id", "member", "running_size")


@book.frame("s15_zip_prefix", f"SELECT doc_id, max(upto)::bigint AS n_bytes FROM (SELECT doc_id, sum(strlen(p[rec_no]) + 1) OVER (PARTITION BY doc_id ORDER BY rec_no) AS upto FROM {_LINES_DUCK} WHERE rec_no < n) WHERE upto <= 400 GROUP BY doc_id")
def zip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the whole records within a cap of every gzip member of the bundles' zip archives."""
    head = F.substring("content", 1, 400)
    m = files.zip_members(_archived(spark, sf_dir, "zip+gzip"), "[.]txt[.]gz$")
    cut = m.select(F.regexp_extract("member", "-([0-9]+)[.]txt$", 1).cast("bigint").alias("doc_id"), F.decode(head, "ISO-8859-1").alias("head"))
    return cut.select("doc_id", F.length(F.regexp_extract("head", "(?s)^(.*\\n)", 1)).cast("bigint").alias("n_bytes")).filter("n_bytes > 0")


_RANGES = "(SELECT 'a' AS family, 0 AS first_id, 499 AS last_id UNION ALL SELECT 'b', 700, 899 UNION ALL SELECT 'c', 90000000, 90000009)"
book.sql("s13_range_scan", "SELECT r.family, count(e.event_id) AS n, count(e.event_id) = max(r.last_id - r.first_id + 1) AS complete, CAST(sum(octet_length(e.props)) AS BIGINT) AS n_bytes FROM " + _RANGES + " r LEFT JOIN {events} e ON e.event_id BETWEEN r.first_id AND r.last_id GROUP BY r.family", "SELECT r.family, count(e.event_id) AS n, count(e.event_id) = max(r.last_id - r.first_id + 1) AS complete, CAST(sum(strlen(e.props)) AS BIGINT) AS n_bytes FROM " + _RANGES + " r LEFT JOIN {events} e ON e.event_id BETWEEN r.first_id AND r.last_id GROUP BY r.family")
@book.frame("s13_zip_ranges", "SELECT r.family, count(e.event_id) AS n, coalesce(count(e.event_id) = max(r.last_id - r.first_id + 1), false) AS complete, CAST(sum(strlen(e.props)) AS BIGINT) AS n_bytes FROM " + _RANGES + " r LEFT JOIN events e ON e.event_id BETWEEN r.first_id AND r.last_id GROUP BY r.family")
def zip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of record ids of the JSON lines in zip archives, with their completeness; a record whose id isn't that of
    its line is an error."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.to_json(F.struct("event_id", "props")).alias("line")))), lambda v: v["line"]), "\n")
    parts = table(spark, sf_dir, "events").select("event_id", "props", F.expr("event_id div 8192").alias("part")).groupBy("part").agg(lines.alias("lines"), F.min("event_id").alias("first_id"))
    packed = files.packed_archives(parts.select(F.col("part").cast("string").alias("archive"), F.concat(F.lit("events-"), "first_id", F.lit(".jsonl")).alias("member"), F.col("lines").cast("binary").alias("content")), "zip")
    m = files.zip_members(packed, "[.]jsonl$").select(F.regexp_extract("member", "-([0-9]+)[.]", 1).cast("bigint").alias("first_id"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("at", "line"))
    rows = m.select("first_id", "at", F.from_json("line", "event_id bigint, props string").alias("r")).select("first_id", "at", "r.*")
    checked = rows.filter(F.assert_true(F.col("event_id") == F.col("first_id") + F.col("at")).isNull())
    ranges = spark.createDataFrame([("a", 0, 499), ("b", 700, 899), ("c", 90000000, 90000009)], "family string, first bigint, last bigint")
    met = F.broadcast(ranges).join(checked, F.col("event_id").between(F.col("first"), F.col("last")), "left")
    return met.groupBy("family").agg(F.count("event_id").alias("n"), F.coalesce(F.count("event_id") == F.max(F.col("last") - F.col("first") + 1), F.lit(False)).alias("complete"), F.sum(F.octet_length("props")).alias("n_bytes"))


book.sql("s14_range_disjoint", "SELECT a.family AS family_a, b.family AS family_b FROM " + _RANGES + " a JOIN " + _RANGES + " b ON a.first_id < b.first_id AND b.first_id <= a.last_id")


@book.frame("s15_record_aligned_prefix", f"SELECT doc_id, max(upto)::bigint AS n_bytes FROM (SELECT doc_id, sum(strlen(p[rec_no]) + 1) OVER (PARTITION BY doc_id ORDER BY rec_no) AS upto FROM {_LINES_DUCK} WHERE rec_no < n) WHERE upto <= 400 GROUP BY doc_id")
def record_aligned_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each text's whole records within a cap; lines of one text are ordered inside its own group."""
    lines = _lines(docs(spark, sf_dir)).filter("terminated")
    run = F.sum(F.octet_length("record") + 1).over(Window.partitionBy("doc_id").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("upto", run).filter("upto <= 400").groupBy("doc_id").agg(F.max("upto").cast("bigint").alias("n_bytes"))


book.sql("s17_import_new", "SELECT d.doc_id, sha2(d.text, 256) AS sha256, concat(substring(sha2(d.text, 256), 1, 16), '.txt') AS stored_name FROM {documents} d LEFT ANTI JOIN {corpus_items} i ON i.content = d.text WHERE d.text IS NOT NULL", "SELECT d.doc_id, sha256(d.text) AS sha256, concat(substring(sha256(d.text), 1, 16), '.txt') AS stored_name FROM {documents} d ANTI JOIN {corpus_items} i ON i.content = d.text WHERE d.text IS NOT NULL")
book.sql("s21_result_documents", "SELECT lane, file_no, get_json_object(body, '$.run_id') AS run_id, get_json_object(body, '$.system.platform') AS platform FROM {run_files}", "SELECT lane, file_no, json_extract_string(body, '$.run_id') AS run_id, json_extract_string(body, '$.system.platform') AS platform FROM {run_files}")
_SAMPLE = "CASE WHEN length(text) <= 96 THEN text ELSE concat(substring(text, 1, 32), substring(text, CAST(floor(length(text) / 2) AS INT) - 15, 32), substring(text, length(text) - 31, 32)) END"
book.sql("s24_representative_sample", "SELECT doc_id, md5(" + _SAMPLE + ") AS sample_digest FROM {documents} WHERE text IS NOT NULL")


def _offsets(size: str, chunk: int, most: int) -> str:
    return f"transform(sequence(0, least({most}, {size} div {chunk}) - 1), i -> i * ({size} - {chunk}) div greatest(least({most}, {size} div {chunk}) - 1, 1))"


book.sql("s25_sample_offsets", f"SELECT doc_id, explode({_offsets('octet_length(text)', 64, 8)}) AS at FROM {{documents}} WHERE octet_length(text) >= 64", "SELECT doc_id, i * (n - 64) // greatest(least(8, n // 64) - 1, 1) AS at FROM (SELECT doc_id, strlen(text) AS n, unnest(range(0, least(8, strlen(text) // 64))) AS i FROM {documents} WHERE strlen(text) >= 64)")
book.sql("s26_window_offsets", f"SELECT doc_id, count(*) AS n_windows, CAST(max(at) AS BIGINT) AS last_at FROM (SELECT doc_id, explode({_offsets('length(text)', 48, 16)}) AS at FROM {{documents}} WHERE length(text) >= 48) w GROUP BY doc_id", "SELECT doc_id, count(*) AS n_windows, CAST(max(i * (n - 48) // greatest(least(16, n // 48) - 1, 1)) AS BIGINT) AS last_at FROM (SELECT doc_id, length(text) AS n, unnest(range(0, least(16, length(text) // 48))) AS i FROM {documents} WHERE length(text) >= 48) GROUP BY doc_id")
book.sql("s27_five_ranges", "SELECT doc_id, r.k, substring(text, CAST(floor(length(text) * r.k / 5.0) AS INT) + 1, 16) AS piece FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r WHERE length(text) >= 80", "SELECT doc_id, r.k, substring(text, CAST(floor(length(text) * r.k / 5.0::double) AS INT) + 1, 16) AS piece FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r WHERE length(text) >= 80")
book.sql("s29_codec_registry", "SELECT k.id, k.available, coalesce(k.version, '') AS version, count(t.codec_id) AS n_trials FROM {codecs} k LEFT JOIN {trials} t ON t.codec_id = k.id GROUP BY k.id, k.available, k.version")

# --- Text predicates.
book.sql("f05_structured_text", "SELECT doc_id, length(regexp_replace(text, '[^ -~]', '')) >= 0.85 * length(text) AND size(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,63}}', 0)) >= 8 AS structured FROM {documents} WHERE text IS NOT NULL", "SELECT doc_id, length(regexp_replace(text, '[^ -~]', '', 'g')) >= 0.85 * length(text) AND len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,63}}')) >= 8 AS structured FROM {documents} WHERE text IS NOT NULL")
book.sql("f06_json_documents", "SELECT doc_id, substring(regexp_replace(substring(text, 1, 4096), '^[ \t\n\r]+', ''), 1, 1) IN ('{{', '[') AS is_json FROM {documents} WHERE text IS NOT NULL")


@book.frame("f07_numeric_lexemes", f"SELECT doc_id, count(*) AS n_cells, count_if(regexp_full_match(cells[col_no + 1], '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')) AS n_numeric FROM {_CELLS_DUCK} GROUP BY doc_id")
def numeric_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(docs(spark, sf_dir))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.count_if(F.col("cell").rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$")).alias("n_numeric"))


book.sql("f08_json_numbers", "SELECT event_id, CAST(value AS STRING) RLIKE '^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$' AS json_number FROM {events}", "SELECT event_id, regexp_full_match(CAST(value AS VARCHAR), '-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?') AS json_number FROM {events}")


@book.frame("f09_flat_json_records", f"SELECT doc_id, count(*) AS n_records, count_if(json_valid(p[rec_no]) AND coalesce(json_type(CASE WHEN json_valid(p[rec_no]) THEN p[rec_no] END), '') = 'OBJECT') AS n_objects FROM {_LINES_DUCK} WHERE rec_no < n OR p[rec_no] <> '' GROUP BY doc_id")
def flat_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.json_skeletons(docs(spark, sf_dir), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_records"), F.count("skeleton").alias("n_objects"))


@book.frame("f10_rectangular", f"SELECT doc_id, min(arity) = max(arity) AND min(arity) > 0 AS rectangular, max(arity)::bigint AS widest FROM {_CELLS_DUCK} GROUP BY doc_id")
def rectangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(docs(spark, sf_dir))
    return c.groupBy("doc_id").agg(((F.min("arity") == F.max("arity")) & (F.min("arity") > 0)).alias("rectangular"), F.max("arity").cast("bigint").alias("widest"))


book.sql("f11_path_rules", "SELECT id, path FROM {corpus_items} WHERE (path LIKE '%.csv' OR path LIKE '%.txt' OR path LIKE '%.jsonl' OR path LIKE '%.json') AND path NOT LIKE 'holdout/%' AND path NOT LIKE '%/vendor/%'")
book.sql("f12_safe_paths", "SELECT id, path LIKE '/%' OR path LIKE '%..%' OR path LIKE '%//%' OR path = '' AS unsafe FROM {corpus_items}")
book.sql("f13_page_filter", "SELECT doc_id FROM {documents} WHERE text <> '' AND NOT lower(text) LIKE '#redirect%' AND regexp_extract(text, '^([A-Za-z]+):', 1) = ''")
book.sql("f16_token_savings", "SELECT doc_id, token, n FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, explode(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,63}}', 0)) AS token FROM {documents}) t GROUP BY doc_id, token) c WHERE n >= 2 AND n * (length(token) - 2) - length(token) - 1 > 0", "SELECT doc_id, token, n FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,63}}')) AS token FROM {documents}) t GROUP BY doc_id, token) c WHERE n >= 2 AND n * (length(token) - 2) - length(token) - 1 > 0")


@book.frame("f18_store_shortcut")
def store_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.per_text(docs(spark, sf_dir), "doc_id", "text", "stored boolean", lambda t: [(r.incompressible(t.encode()),)])


# --- Tokens, dictionaries and features.
_TOKENS = "(SELECT doc_id, pos, token FROM (SELECT doc_id, posexplode(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,63}}', 0)) AS (pos, token) FROM {texts}) t0)"
_TOKENS_DUCK = "(SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,63}}') AS w FROM {documents})))"


def tokens_sql(name: str, text: str) -> None:
    book.sql(name, text.replace("<tokens>", _TOKENS), text.replace("<tokens>", _TOKENS_DUCK))


tokens_sql("a12_token_frequency", "SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM <tokens> t GROUP BY token")
tokens_sql("a13_token_entropy", "SELECT doc_id, abs(round(-sum(n / CAST(total AS DOUBLE) * ln(n / CAST(total AS DOUBLE)) / ln(2)), 6)) AS bits, abs(round(-sum(n / CAST(total AS DOUBLE) * ln(n / CAST(total AS DOUBLE))) / ln(greatest(2, count(*))), 6)) AS normalized, count(*) AS dictionary FROM (SELECT doc_id, token, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM <tokens> t GROUP BY doc_id, token) c GROUP BY doc_id")
tokens_sql("a14_top_shares", "SELECT doc_id, round(sum(CASE WHEN place = 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS top1, round(sum(CASE WHEN place <= 4 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS top4 FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS place FROM (SELECT doc_id, token, count(*) AS n FROM <tokens> t GROUP BY doc_id, token) c) p GROUP BY doc_id")
tokens_sql("a15_repeat_rate", "SELECT doc_id, round(sum(CASE WHEN token = before THEN 1.0 ELSE 0.0 END) / greatest(1, count(*) - 1), 9) AS repeat_rate FROM (SELECT doc_id, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM <tokens> t) r GROUP BY doc_id".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"))
_GAIN = "n * (length(token) - 2) - length(token) - 1"
tokens_sql("w11_dictionary_rank", f"SELECT doc_id, token, n, gain, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC, n DESC, token) AS place FROM (SELECT doc_id, token, count(*) AS n, {_GAIN.replace('n *', 'count(*) *')} AS gain FROM <tokens> t GROUP BY doc_id, token) c WHERE n >= 2 AND gain > 0) r WHERE place <= 254")
_LIMIT = "CASE WHEN <octets>(text) < 65536 THEN 16 WHEN substring(regexp_replace(substring(text, 1, 4096), '^[ \t\n\r]+', ''), 1, 1) IN ('{{', '[') THEN 128 ELSE 254 END"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC, n DESC, token) AS place FROM (SELECT doc_id, token, count(*) AS n, {_GAIN.replace('n *', 'count(*) *')} AS gain FROM <tokens> t GROUP BY doc_id, token) c WHERE n >= 2 AND gain > 0"
_LIMITED = f"SELECT r.doc_id, r.token, r.n, r.gain FROM ({_RANKED}) r JOIN (SELECT doc_id, {_LIMIT} AS most FROM <texts> WHERE text IS NOT NULL) l ON l.doc_id = r.doc_id AND r.place <= l.most"
for _name, _what in (("t10_dictionary_limit", "doc_id, count(*) AS entries"), ("r05_dictionary_savings", "doc_id, count(*) AS entries, CAST(sum(gain) AS BIGINT) AS saved, CAST(sum(n) AS BIGINT) AS replaced")):
    _text = f"SELECT {_what} FROM ({_LIMITED}) x GROUP BY doc_id".replace("<texts>", "{texts}")
    book.sql(_name, _text.replace("<tokens>", _TOKENS).replace("<octets>", "octet_length"), _text.replace("<tokens>", _TOKENS_DUCK).replace("<octets>", "strlen"))
tokens_sql("r06_code_sequence", "SELECT t.doc_id, t.pos, c.code FROM <tokens> t JOIN (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS code FROM (SELECT doc_id, token, count(*) AS n FROM <tokens> t1 GROUP BY doc_id, token) c0) c ON c.doc_id = t.doc_id AND c.token = t.token")
tokens_sql(
    "a32_feature_vector",
    """WITH w AS (SELECT doc_id, token, count(*) AS n FROM <tokens> t GROUP BY doc_id, token),
    k AS (SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS place, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS kinds FROM w),
    r AS (SELECT doc_id, count(*) AS tokens, count_if(token = before) AS repeats FROM (SELECT doc_id, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM <tokens> t2) l GROUP BY doc_id),
    f AS (SELECT doc_id, sum(CASE WHEN place = 1 THEN n ELSE 0 END) / CAST(max(total) AS DOUBLE) AS top1, sum(CASE WHEN place <= 4 THEN n ELSE 0 END) / CAST(max(total) AS DOUBLE) AS top4,
      -sum(n / CAST(total AS DOUBLE) * ln(n / CAST(total AS DOUBLE))) / ln(greatest(2, max(kinds))) AS entropy, sum((place - 1) * n) / CAST(max(total) AS DOUBLE) / greatest(1, max(kinds) - 1) AS mean_code, max(kinds) AS dictionary FROM k GROUP BY doc_id)
    SELECT f.doc_id, r.tokens, f.dictionary, round(f.top1, 6) AS top1_share, round(f.top4, 6) AS top4_share, abs(round(f.entropy, 6)) AS entropy, round(f.mean_code, 6) AS mean_code, round(r.repeats / CAST(greatest(1, r.tokens - 1) AS DOUBLE), 6) AS repeat_rate
    FROM f JOIN r ON r.doc_id = f.doc_id""",
)
tokens_sql("m04_seen_before", "SELECT doc_id, count(*) AS tokens, count_if(nth > 1) AS repeats FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS nth FROM <tokens> t) r GROUP BY doc_id")
tokens_sql("m14_quarter_repeats", "SELECT doc_id, quarter, count_if(nth > 1) AS repeats FROM (SELECT doc_id, ntile(4) OVER (PARTITION BY doc_id ORDER BY pos) AS quarter, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS nth FROM <tokens> t) r GROUP BY doc_id, quarter")
tokens_sql("o09_first_pair", "SELECT doc_id, min(pair) AS pair, max(n) AS n FROM (SELECT doc_id, pair, n, rank() OVER (PARTITION BY doc_id ORDER BY n DESC) AS place FROM (SELECT doc_id, concat(token, ' ', nxt) AS pair, count(*) AS n FROM (SELECT doc_id, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM <tokens> t) p WHERE nxt IS NOT NULL GROUP BY doc_id, concat(token, ' ', nxt)) c) r WHERE place = 1 GROUP BY doc_id")

# --- Bytes.
_BYTES = "(SELECT doc_id, pos, b FROM (SELECT doc_id, posexplode(regexp_extract_all(hex(encode(text, 'UTF-8')), '..', 0)) AS (pos, b) FROM {texts}) b0)"
_BYTES_DUCK = "(SELECT doc_id, i - 1 AS pos, w[i] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS w FROM {documents} WHERE text <> '')))"


def bytes_sql(name: str, text: str) -> None:
    book.sql(name, text.replace("<bytes>", _BYTES), text.replace("<bytes>", _BYTES_DUCK))


bytes_sql("a11_byte_histogram", "SELECT b, count(*) AS n FROM <bytes> t GROUP BY b")
bytes_sql("w12_prequential_order0", "SELECT doc_id, round(sum(-ln((nth - 1 + 0.5) / (pos + 128.0)) / ln(2)), 3) AS bits FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS nth FROM <bytes> t) r GROUP BY doc_id".replace("0.5)", "CAST(0.5 AS DOUBLE))").replace("128.0", "CAST(128 AS DOUBLE)"))
bytes_sql("w12_prequential_order1", "SELECT doc_id, round(sum(-ln((nth - 1 + CAST(0.5 AS DOUBLE)) / (seen - 1 + CAST(128 AS DOUBLE))) / ln(2)), 3) AS bits FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, before, b ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc_id, before ORDER BY pos) AS seen FROM (SELECT doc_id, pos, b, lag(b, 1, '') OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM <bytes> t) l) r GROUP BY doc_id")
bytes_sql(
    "w12_prequential_mixed",
    """SELECT doc_id, round(sum(-ln((CAST(0.25 AS DOUBLE) * (nth - 1 + CAST(0.5 AS DOUBLE)) / (pos + CAST(128 AS DOUBLE))) + (CAST(0.75 AS DOUBLE) * (cnth - 1 + CAST(0.5 AS DOUBLE)) / (cseen - 1 + CAST(128 AS DOUBLE)))) / ln(2)), 3) AS bits FROM
    (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc_id, class, b ORDER BY pos) AS cnth, row_number() OVER (PARTITION BY doc_id, class ORDER BY pos) AS cseen FROM
      (SELECT doc_id, pos, b, lag(CASE WHEN b BETWEEN '61' AND '7A' THEN 1 WHEN b BETWEEN '41' AND '5A' THEN 2 WHEN b BETWEEN '30' AND '39' THEN 3 WHEN b IN ('20', '09') THEN 4 WHEN b IN ('0A', '0D') THEN 5 WHEN b < '80' THEN 6 ELSE 7 END, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS class FROM <bytes> t) c) r GROUP BY doc_id""",
)
bytes_sql("m01_order3_loss", "SELECT doc_id, round(sum(-ln((nth - 1 + CAST(0.5 AS DOUBLE)) / (seen - 1 + CAST(128 AS DOUBLE))) / ln(2)), 3) AS bits FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, c3, b ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc_id, c3 ORDER BY pos) AS seen FROM (SELECT doc_id, pos, b, concat(lag(b, 3, '') OVER w, lag(b, 2, '') OVER w, lag(b, 1, '') OVER w) AS c3 FROM <bytes> t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) l) r GROUP BY doc_id")
bytes_sql("o10_dense_lane_cost", "SELECT doc_id, round(sum(-ln((nth - 1 + CAST(1 AS DOUBLE)) / (pos + CAST(256 AS DOUBLE))) / ln(2)), 3) AS bits FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS nth FROM <bytes> t) r GROUP BY doc_id")
bytes_sql("w16_hot_regions", "SELECT doc_id, region, n_digits FROM (SELECT doc_id, region, n_digits, row_number() OVER (PARTITION BY doc_id ORDER BY n_digits DESC, region) AS place FROM (SELECT doc_id, CAST(floor(pos / 64.0) AS BIGINT) AS region, count_if(b BETWEEN '30' AND '39') AS n_digits FROM <bytes> t GROUP BY doc_id, CAST(floor(pos / 64.0) AS BIGINT)) c) r WHERE place <= 3")
_HEX8_DUCK = "WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE strlen(text) >= 8), g AS (SELECT doc_id, p, substring(x, 2 * p + 1, 16) AS gram FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 7)) AS p FROM h) e), s AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id, gram ORDER BY p) AS distance FROM g)"


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.repeat_rows(docs(spark, sf_dir), "doc_id", "text")


@book.frame("j16_match_seeds", _HEX8_DUCK + " SELECT doc_id, count(*) AS positions, count_if(distance <= 65536) AS seeds FROM s GROUP BY doc_id")
def match_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir).select("doc_id", "positions", "seeds")


@book.frame("o05_repeat_overlay", _HEX8_DUCK + ", c AS (SELECT doc_id, p, least(8, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 8)) AS covers FROM s WHERE distance <= 65536) SELECT doc_id, CAST(sum(covers) AS BIGINT) AS covered_bytes FROM c GROUP BY doc_id")
def repeat_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir).filter("covered IS NOT NULL").select("doc_id", F.col("covered").alias("covered_bytes"))


@book.frame("m12_match_coverage", _HEX8_DUCK + " SELECT doc_id, round(count_if(distance <= 65536) / CAST(count(*) AS DOUBLE), 9) AS coverage FROM s GROUP BY doc_id")
def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir).select("doc_id", F.round(F.col("seeds") / F.col("positions"), 9).alias("coverage"))


book.sql("o02_digit_overlay", "SELECT doc_id, length(text) - length(regexp_replace(text, '[0-9]', '')) AS n_digits FROM {documents} WHERE text IS NOT NULL", "SELECT doc_id, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits FROM {documents} WHERE text IS NOT NULL")
_ISO = "[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?"
book.sql("o03_timestamp_overlay", "SELECT doc_id, length(text) - length(regexp_replace(text, '" + _ISO + "', '')) AS n_bytes FROM {documents} WHERE text IS NOT NULL", "SELECT doc_id, length(text) - length(regexp_replace(text, '" + _ISO + "', '', 'g')) AS n_bytes FROM {documents} WHERE text IS NOT NULL")
book.sql("o04_hex_overlay", "SELECT doc_id, size(filter(regexp_extract_all(text, '[0-9A-Fa-f]+', 0), x -> length(x) >= 16)) AS hex_runs FROM {documents} WHERE text IS NOT NULL", "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9A-Fa-f]+'), lambda x: length(x) >= 16)) AS hex_runs FROM {documents} WHERE text IS NOT NULL")

# A hex run lies inside one alphanumeric run, so the union of both marks is a sum over these.
_ID_BYTES = "CASE WHEN length(x) >= 20 AND regexp_like(x, '[0-9]') AND regexp_like(x, '[A-Za-z]') THEN length(x) ELSE length(x) - length(regexp_replace(x, '[0-9A-Fa-f]{{16,}}', '')) END"
book.sql(
    "o04_id_overlay",
    f"SELECT doc_id, aggregate(transform(regexp_extract_all(text, '[0-9A-Za-z]{{{{16,}}}}', 0), x -> {_ID_BYTES}), CAST(0 AS BIGINT), (a, b) -> a + b) AS n_bytes FROM {{documents}} WHERE text IS NOT NULL",
    f"SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9A-Za-z]{{{{16,}}}}'), lambda x: {_ID_BYTES.replace('regexp_like', 'regexp_matches').replace(', ' + repr('') + ')', ', ' + repr('') + ', ' + repr('g') + ')')})), 0) AS BIGINT) AS n_bytes FROM {{documents}} WHERE text IS NOT NULL",
)


# Strings with what follows them up to a colon, and the gaps between them, whose signs are classed one by one.
_CLASSES_DUCK = r"""WITH t AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '"(?:[^"\\]|\\[\s\S])*(?:"[ \t]*:?|\\?$)|[^"]+')) AS s FROM documents WHERE text <> ''),
p AS (SELECT doc_id, source, s, regexp_extract(s, '^"(?:[^"\\]|\\[\s\S])*(?:"|\\?$)') AS q FROM t),
g AS (SELECT doc_id, source, CASE WHEN q = '' THEN s ELSE substring(s, length(q) + 1) END AS gap FROM p),
n AS (SELECT doc_id, source, strlen(gap) AS whole, length(gap) - length(regexp_replace(gap, '[][{}:,]', '', 'g')) AS structural, length(gap) - length(regexp_replace(gap, '[ \t\r\n]', '', 'g')) AS whitespace,
  len(list_filter(range(1, length(gap) + 1), lambda i: regexp_matches(substring(gap, i, 1), '[0-9-]') OR (i > 1 AND regexp_matches(substring(gap, i - 1, 2), '^[0-9.eE][eE+.]$')))) AS number_value,
  len(list_filter(range(1, length(gap) + 1), lambda i: regexp_matches(substring(gap, i, 1), '[A-Za-z]') AND NOT (i > 1 AND regexp_matches(substring(gap, i - 1, 2), '^[0-9.eE][eE]$')))) AS literal_value FROM g),
c AS (SELECT doc_id, source, CASE WHEN contains(substring(s, length(q) + 1), ':') THEN 'field_name' ELSE 'string_value' END AS class, strlen(q) AS n FROM p WHERE q <> '' UNION ALL
  SELECT doc_id, source, unnest(['structural', 'whitespace', 'number_value', 'literal_value', 'unclassified']), unnest([structural, whitespace, number_value, literal_value, whole - structural - whitespace - number_value - literal_value]) FROM n),
k AS (SELECT doc_id, source, class, sum(n)::bigint AS n FROM c WHERE n > 0 GROUP BY ALL)"""


@book.frame("o01_byte_classes", _CLASSES_DUCK + " SELECT class, sum(n)::bigint AS n_bytes, count(*) AS n_docs FROM k GROUP BY class")
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.byte_class_counts(docs(spark, sf_dir), "doc_id", "text").groupBy("class").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))


@book.frame("a24_class_totals", _CLASSES_DUCK + " SELECT source, class, sum(n)::bigint AS n_bytes FROM k GROUP BY source, class")
def class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte classes by source; every byte is in exactly one class."""
    c = r.byte_class_counts(docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text"), "doc", "text")
    return c.groupBy(F.col("doc.source").alias("source"), "class").agg(F.sum("n_bytes").alias("n_bytes"))


# --- Lines.
_LINE_ROWS = "(SELECT doc_id, pos, line FROM (SELECT doc_id, posexplode(split(text, char(10), -1)) AS (pos, line) FROM {texts} WHERE text IS NOT NULL) l0)"
_LINE_ROWS_DUCK = "(SELECT doc_id, i - 1 AS pos, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {documents} WHERE text IS NOT NULL)))"


def lines_sql(name: str, text: str) -> None:
    book.sql(name, text.replace("<lines>", _LINE_ROWS).replace("<octets>", "octet_length"), text.replace("<lines>", _LINE_ROWS_DUCK).replace("<octets>", "strlen"))


lines_sql("m09_line_reuse", "SELECT doc_id, count(*) AS n_lines, count_if(nth > 1) AS reused FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM <lines> l WHERE line <> '') r GROUP BY doc_id")
lines_sql("o08_line_cache", "SELECT doc_id, count_if(nth > 1) AS hits FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM <lines> l WHERE <octets>(line) BETWEEN 1 AND 128) r GROUP BY doc_id")
lines_sql("j13_recent_slot", "SELECT doc_id, count(*) AS n_lines, count_if(<octets>(before) = <octets>(line)) AS referenced FROM (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id, <octets>(line) % 1024 ORDER BY pos) AS before FROM <lines> l WHERE <octets>(line) <= 32768) r GROUP BY doc_id")
lines_sql("j14_previous_record", "SELECT doc_id, count_if(line = before) AS repeated FROM (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM <lines> l) r GROUP BY doc_id")
lines_sql("u07_duplicate_lines", "SELECT line, count(*) AS n FROM <lines> l WHERE line <> '' GROUP BY line HAVING count(*) > 1")
lines_sql("m02_template_hits", "SELECT doc_id, count(*) AS n_lines, count(DISTINCT shape) AS templates FROM (SELECT doc_id, regexp_replace(line, '[0-9]+', '0') AS shape FROM <lines> l WHERE line <> '') r GROUP BY doc_id")
book.oracles["m02_template_hits"] = book.oracles["m02_template_hits"].replace("'[0-9]+', '0')", "'[0-9]+', '0', 'g')")
lines_sql("o06_template_slots", "SELECT doc_id, count(*) AS n_lines, count_if(shape = before) AS same_as_last, count_if(nth > 1) AS hits FROM (SELECT doc_id, shape, lag(shape) OVER (PARTITION BY doc_id ORDER BY pos) AS before, row_number() OVER (PARTITION BY doc_id, shape ORDER BY pos) AS nth FROM (SELECT doc_id, pos, regexp_replace(line, '[0-9]+', '0') AS shape FROM <lines> l WHERE line <> '') s) r GROUP BY doc_id")
book.oracles["o06_template_slots"] = book.oracles["o06_template_slots"].replace("'[0-9]+', '0')", "'[0-9]+', '0', 'g')")


# Common ends with the line before, byte by byte, and the sizes of the line and of what a splice leaves of it.
_VARINT_DUCK = "greatest(1, ceil(length(bin({})) / 7.0))"
_SPLICES_DUCK = f"""WITH l AS (SELECT doc_id, rec_no, hex(encode(line)) AS h, strlen(line) AS n, lag(hex(encode(line))) OVER (PARTITION BY doc_id ORDER BY rec_no) AS g FROM
  (SELECT doc_id, i AS rec_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+') AS l FROM documents WHERE text IS NOT NULL)))),
p AS (SELECT *, length(g) // 2 AS m, CASE WHEN g IS NULL THEN 0 ELSE least(n, length(g) // 2) END AS k FROM l),
q AS (SELECT *, coalesce(list_position(list_transform(range(k), lambda i: substring(h, 2 * i + 1, 2) = substring(g, 2 * i + 1, 2)), false) - 1, k) AS prefix FROM p),
r AS (SELECT *, coalesce(list_position(list_transform(range(k - prefix), lambda i: substring(h, 2 * (n - i) - 1, 2) = substring(g, 2 * (m - i) - 1, 2)), false) - 1, k - prefix) AS suffix FROM q),
v AS (SELECT *, n - prefix - suffix AS middle, 1 + {_VARINT_DUCK.format('n')} + n AS whole FROM r),
s AS (SELECT doc_id, rec_no, coalesce(prefix, 0) AS prefix, coalesce(suffix, 0) AS suffix, whole,
  CASE WHEN g IS NOT NULL THEN 1 + {' + '.join(_VARINT_DUCK.format(c) for c in ('prefix', 'suffix', 'middle'))} + middle END AS other FROM v)"""


@book.frame("w07_splice", _SPLICES_DUCK + " SELECT doc_id, count(*) AS n_records, count_if(other < whole) AS n_spliced, sum(prefix + suffix)::bigint AS shared, sum(CASE WHEN other < whole THEN other ELSE whole END)::bigint AS n_bytes FROM s GROUP BY doc_id")
def splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.splice_residuals(docs(spark, sf_dir), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_records"), F.count_if("spliced").alias("n_spliced"), F.sum(F.col("prefix") + F.col("suffix")).alias("shared"), F.sum("n_bytes").alias("n_bytes"))


book.oracles["r09_splice_counts"] = _SPLICES_DUCK + " SELECT count(*) AS n_records, count(*) FILTER (WHERE other < whole) AS n_spliced FROM s"
book.queries["r09_splice_counts"] = lambda spark, d: splice(spark, d).agg(F.sum("n_records").alias("n_records"), F.sum("n_spliced").alias("n_spliced"))


# Residuals as strings of zeros (z) and others (n): runs of two zeros or more are commands of up to 128, and so is the rest.
_ZEROS = "array_to_string(list_transform(range(n), lambda i: CASE WHEN substring(h, 2 * i + 1, 2) = substring(g, 2 * i + 1, 2) THEN 'z' ELSE 'n' END), '')"
_RESIDUAL = "len(regexp_extract_all(x, 'z{2,128}')) + list_sum(list_transform(regexp_split_to_array(x, 'z{2,128}'), lambda s: length(s) + (length(s) + 127) // 128))"
_HEX_LINES = f"l AS MATERIALIZED (SELECT doc_id, rec_no, strlen(line) AS n, hex(encode(line)) AS h FROM (SELECT doc_id, rec_no, p[rec_no] AS line FROM {_LINES_DUCK} WHERE rec_no < n OR p[rec_no] <> ''))"
_REFERENCES_DUCK = f"""WITH {_HEX_LINES}, c AS (SELECT doc_id, rec_no, n, h, unnest(list(h) OVER (PARTITION BY doc_id, n ORDER BY rec_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) AS g FROM l),
x AS (SELECT doc_id, rec_no, {_ZEROS} AS x FROM c), b AS (SELECT doc_id, rec_no, min({_RESIDUAL}) AS size FROM x GROUP BY ALL),
s AS (SELECT l.doc_id, l.rec_no, coalesce(size + 1 < n, false) AS referenced, CASE WHEN size + 1 < n THEN size ELSE 0 END AS residual_bytes FROM l LEFT JOIN b USING (doc_id, rec_no))"""
_SLOTS_DUCK = f"""WITH {_HEX_LINES}, c AS (SELECT doc_id, rec_no, n, h, CASE WHEN n <= 32768 THEN lag(h) OVER (PARTITION BY doc_id, n <= 32768, n % 1024 ORDER BY rec_no) END AS g FROM l),
x AS (SELECT doc_id, rec_no, n, CASE WHEN length(g) = 2 * n THEN {_ZEROS} ELSE '' END AS x FROM c), b AS (SELECT doc_id, rec_no, n, {_RESIDUAL} AS size FROM x),
s AS (SELECT doc_id, rec_no, size > 0 AND size < n AS referenced, CASE WHEN size > 0 AND size < n THEN size ELSE 0 END AS residual_bytes FROM b)"""
_COUNTED = " count(*) AS n_records, count(*) FILTER (WHERE referenced) AS n_referenced, sum(residual_bytes)::bigint AS residual_bytes FROM s"


@book.frame("j12_length_reference", _REFERENCES_DUCK + " SELECT doc_id," + _COUNTED + " GROUP BY doc_id")
def length_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.length_references(docs(spark, sf_dir), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_records"), F.count_if("referenced").alias("n_referenced"), F.sum("residual_bytes").alias("residual_bytes"))


book.oracles["r08_xor_residuals"] = _REFERENCES_DUCK + " SELECT" + _COUNTED
book.oracles["r08_slot_residuals"] = _SLOTS_DUCK + " SELECT" + _COUNTED
book.oracles["w08_zero_runs"] = _REFERENCES_DUCK + " SELECT referenced, count(*) AS n, sum(residual_bytes)::bigint AS n_bytes FROM s GROUP BY referenced"
book.queries["r08_xor_residuals"] = lambda spark, d: length_reference(spark, d).agg(F.sum("n_records").alias("n_records"), F.sum("n_referenced").alias("n_referenced"), F.sum("residual_bytes").alias("residual_bytes"))
book.queries["r08_slot_residuals"] = lambda spark, d: r.slot_references(docs(spark, d), "doc_id", "text").agg(F.count("*").alias("n_records"), F.count_if("referenced").alias("n_referenced"), F.sum("residual_bytes").alias("residual_bytes"))
book.queries["w08_zero_runs"] = lambda spark, d: r.length_references(docs(spark, d), "doc_id", "text").groupBy("referenced").agg(F.count("*").alias("n"), F.sum("residual_bytes").alias("n_bytes"))

# --- JSON.
_LOG_LINES_DUCK = "(SELECT doc_id, i AS rec_no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)) WHERE i < len(p) OR p[i] <> '')"


@book.frame("r01_json_channels", f"SELECT field, count(*) AS n_values FROM (SELECT unnest(json_keys(line)) AS field FROM (SELECT line FROM {_LOG_LINES_DUCK} WHERE json_valid(line)) WHERE json_type(line) = 'OBJECT') GROUP BY field")
def json_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = r.shred_json(docs(spark, sf_dir), "doc_id", "text").filter("field IS NOT NULL")
    return f.groupBy("field").agg(F.count("*").alias("n_values"))


@book.frame("r01_round_trip", "SELECT doc_id, strlen(text)::bigint AS n_bytes, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its skeletons and channels of raw values, lines that are no objects as they are."""
    d = docs(spark, sf_dir)
    channels = r.per_text(d, "doc_id", "text", "skeletons array<string>, fields array<struct<field:string,values:array<string>>>, ended boolean", lambda t: [r.json_channels(t)], spread=True)
    whole = r.rebuilt_json(channels, "doc_id")
    return whole.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"))


# Values as a JSON writer spells them.
_FIELDS_DUCK = f"""WITH l AS (SELECT doc_id, rec_no, p[rec_no] AS line FROM {_LINES_DUCK} WHERE rec_no < n OR p[rec_no] <> ''),
v AS (SELECT *, json_valid(line) AND coalesce(json_type(CASE WHEN json_valid(line) THEN line END), '') = 'OBJECT' AS ok FROM l),
e AS (SELECT v.doc_id, v.rec_no, j.key AS field, j.rowid AS place, CAST(j.value AS VARCHAR) AS raw_value FROM v, json_each(CASE WHEN v.ok THEN v.line ELSE '{{}}' END) j)
SELECT doc_id, rec_no::int AS rec_no, field, row_number() OVER (PARTITION BY doc_id, rec_no, field ORDER BY place)::int AS occurrence, raw_value FROM e UNION ALL SELECT doc_id, rec_no::int, NULL, 0, line FROM v WHERE NOT ok"""


@book.frame("x10_raw_fields")
def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.shred_json(docs(spark, sf_dir), "doc_id", "text")


@book.frame("x10_scalars", f"SELECT * FROM ({_FIELDS_DUCK}) WHERE field IS NULL OR raw_value[1] NOT IN ('{{', '[', chr(34))")
def scalar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw numbers, flags and nulls; SQL keeps neither the escapes of texts nor the white space of objects and arrays."""
    return raw_fields(spark, sf_dir).filter("field IS NULL OR left(raw_value, 1) NOT IN ('{', '[', char(34))")


# Objects of these lines hold arrays and objects of one level only, which SQL's patterns can span.
_VALUE_RE = r'("(?:[^"\\]|\\.)*"\s*:\s*)("(?:[^"\\]|\\.)*"|\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}|\[(?:[^\[\]"]|"(?:[^"\\]|\\.)*")*\]|[^,{}\[\]\s"]+)'


@book.frame("x11_skeletons", f"""WITH l AS (SELECT p[rec_no] AS line FROM {_LINES_DUCK} WHERE rec_no < n OR p[rec_no] <> ''),
v AS (SELECT CASE WHEN json_valid(line) AND coalesce(json_type(CASE WHEN json_valid(line) THEN line END), '') = 'OBJECT' THEN line END AS line FROM l),
k AS (SELECT regexp_replace(line, '{_VALUE_RE}', '\\1' || chr(0), 'g') AS s, CASE WHEN line IS NULL THEN 0 ELSE len(json_keys(line)) END AS n_values FROM v)
SELECT sha256(s) AS skeleton, n_values::int AS n_values, count(*) AS n_records FROM k GROUP BY ALL""")
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.json_skeletons(docs(spark, sf_dir), "doc_id", "text")
    return s.groupBy(F.sha2("skeleton", 256).alias("skeleton"), "n_values").agg(F.count("*").alias("n_records"))


@book.frame("r02_segment_modes")
def segment_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct or columnar for each text as one segment: the smaller of zlib over the text and over its columns."""
    import zlib

    def modes(t: str):
        data, columns, rest = t.encode(), {}, []
        for line in r.lines_of(t):
            fields = r.top_level_fields(line)
            rest.append(line if fields is None else r.skeleton(line))
            for k, a, b in fields or []:
                columns.setdefault(k, []).append(line[a:b])
        direct = len(zlib.compress(data, 6))
        columnar = sum(len(zlib.compress("\n".join(v).encode(), 6)) for v in [rest, *columns.values()])
        yield ("columnar" if columnar < direct else "direct"), direct, columnar

    s = r.per_text(docs(spark, sf_dir), "doc_id", "text", "mode string, direct int, columnar int", modes, spread=True)
    return s.groupBy("mode").agg(F.count("*").alias("n_segments"), F.sum(F.least("direct", "columnar")).alias("n_bytes"))


book.sql("r01_event_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM {events} GROUP BY event_type", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM {events} GROUP BY event_type")
@book.frame("m03_typed_deltas", "SELECT user_id, length(bin(abs(event_id - before)))::bigint AS delta_bits, count(*) AS n FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) l WHERE before IS NOT NULL GROUP BY ALL")
def typed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordered.with_previous(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], {"event_id": "before"})
    return e.filter("before IS NOT NULL").groupBy("user_id", F.length(F.bin(F.abs(F.col("event_id") - F.col("before")))).cast("bigint").alias("delta_bits")).agg(F.count("*").alias("n"))


@book.frame("o07_typed_lanes", "SELECT event_type, count_if(event_id > before) AS id_hits, count_if(event_id = before + 1) AS unit_steps, count_if(before IS NULL) AS armed FROM (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) l GROUP BY event_type")
def typed_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordered.with_previous(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], {"event_id": "before"})
    return e.groupBy("event_type").agg(F.count_if(F.col("event_id") > F.col("before")).alias("id_hits"), F.count_if(F.col("event_id") == F.col("before") + 1).alias("unit_steps"), F.count_if(F.col("before").isNull()).alias("armed"))


book.sql("m13_field_conditioned", "SELECT event_type, k, n, round(-ln(n / CAST(sum(n) OVER (PARTITION BY event_type) AS DOUBLE)) / ln(2), 6) AS bits FROM (SELECT event_type, get_json_object(props, '$.k') AS k, count(*) AS n FROM {events} GROUP BY event_type, get_json_object(props, '$.k')) c", "SELECT event_type, k, n, round(-ln(n / CAST(sum(n) OVER (PARTITION BY event_type) AS DOUBLE)) / ln(2), 6) AS bits FROM (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM {events} GROUP BY ALL) c")

# Lanes by template and slot: numbers of up to 18 digits and ISO times, each against the value before it in its lane.
_VALUE = "[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}|[0-9]+"
_LANE_VALUES = f"""WITH v AS (SELECT doc_id, pos, <replace>(line, '{_VALUE}', '0'<g>) AS shape, slot, v FROM (SELECT doc_id, pos, line, <each> FROM <lines> l) e WHERE slot < 64),
c AS (SELECT *, CASE WHEN length(v) = 19 AND v LIKE '%:%' THEN CASE WHEN TRY_CAST(replace(v, 'T', ' ') AS <stamp>) IS NOT NULL THEN 'time' ELSE 'other' END WHEN length(v) <= 18 THEN 'id' ELSE 'other' END AS class FROM v),
n AS (SELECT *, CASE class WHEN 'id' THEN CAST(v AS BIGINT) WHEN 'time' THEN <seconds> END AS num FROM c),
b AS (SELECT *, lag(class) OVER w AS before, num - lag(num) OVER w AS d FROM n WINDOW w AS (PARTITION BY doc_id, shape, slot ORDER BY pos))
SELECT class, count(*) AS n, count_if(before = class) AS hits, count_if(before IS NULL) AS armed, count_if(before <> class) AS re_armed,
  CAST(sum(CASE WHEN before = class AND d IS NOT NULL THEN greatest(1, ceil(length(bin(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END)) / CAST(7 AS DOUBLE))) ELSE 0 END) AS BIGINT) AS delta_bytes FROM b GROUP BY class"""


def _lane_sql(text: str, **parts: str) -> str:
    for name, part in parts.items():
        text = text.replace(f"<{name}>", part)
    return text


book.sql(
    "o07_template_lanes",
    _lane_sql(_LANE_VALUES, replace="regexp_replace", g="", lines=_LINE_ROWS, each=f"posexplode(regexp_extract_all(line, '{_VALUE}', 0)) AS (slot, v)", stamp="TIMESTAMP_NTZ", seconds="timestampdiff(SECOND, TIMESTAMP_NTZ '2000-01-01 00:00:00', TRY_CAST(replace(v, 'T', ' ') AS TIMESTAMP_NTZ))"),
    _lane_sql(_LANE_VALUES, replace="regexp_replace", g=", 'g'", lines=_LINE_ROWS_DUCK, each=f"unnest(range(len(regexp_extract_all(line, '{_VALUE}')))) AS slot, unnest(regexp_extract_all(line, '{_VALUE}')) AS v", stamp="TIMESTAMP", seconds="CAST(epoch(TRY_CAST(replace(v, 'T', ' ') AS TIMESTAMP)) - 946684800 AS BIGINT)"),
)
@book.frame("m13_field_order1", """WITH v AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events), c AS (SELECT event_type, unnest(range(1, length(k) + 1)) AS i, k FROM v),
  p AS (SELECT event_type, CASE WHEN i > 1 THEN k[i - 1] ELSE '' END AS before, k[i] AS ch, count(*) AS n FROM c GROUP BY ALL)
  SELECT event_type, sum(n)::bigint AS n, abs(round(sum(-n * ln(n / total) / ln(2)), 3)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY event_type, before)::double AS total FROM p) GROUP BY event_type""")
def field_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal bits of a field's characters after the one before, for each kind of record; counted before anything is ordered."""
    k = F.get_json_object("props", "$.k")
    chars = table(spark, sf_dir, "events").select("event_type", F.explode(F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.struct(F.when(i > 1, F.substring(k, i - 1, F.lit(1))).otherwise("").alias("before"), F.substring(k, i, F.lit(1)).alias("ch")))).alias("c"))
    p = chars.groupBy("event_type", "c.before", "c.ch").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("event_type", "before")).cast("double")
    return p.withColumn("bits", -F.col("n") * F.log2(F.col("n") / total)).groupBy("event_type").agg(F.sum("n").alias("n"), F.abs(F.round(F.sum("bits"), 3)).alias("bits"))


# --- Deltas and numeric codes.
_D32 = "SELECT l_suppkey, l_orderkey, l_linenumber, ((l_orderkey - lag(l_orderkey, 1, 0) OVER w) % 4294967296 + 4294967296) % 4294967296 AS delta FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of order keys along each supplier's lines modulo 2**32, the first against 0."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    run = ordered.with_previous(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"], {"l_orderkey": "before"})
    return run.select("l_suppkey", "l_orderkey", "l_linenumber", F.pmod(F.col("l_orderkey") - F.coalesce("before", F.lit(0)), F.lit(1 << 32)).alias("delta"))


@book.frame("w01_delta32", _D32)
def delta32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@book.frame("r10_byte_planes", "SELECT plane, b, count(*) AS n FROM (SELECT p.plane, CAST(floor(delta / p.unit) AS BIGINT) % 256 AS b FROM (" + _D32 + ") d CROSS JOIN (SELECT 0 AS plane, 1.0 AS unit UNION ALL SELECT 1, 256.0 UNION ALL SELECT 2, 65536.0 UNION ALL SELECT 3, 16777216.0) p) x GROUP BY plane, b")
def byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = F.inline(F.array(*[F.struct(F.lit(k).alias("plane"), F.call_function("shiftright", F.col("delta"), F.lit(8 * k)).bitwiseAND(F.lit(255)).alias("b")) for k in range(4)]))
    return _deltas(spark, sf_dir).select(planes).groupBy("plane", "b").agg(F.count("*").alias("n"))


@book.frame("w02_inverse_sums", "SELECT l_suppkey, l_orderkey, l_linenumber, l_orderkey % 4294967296 AS restored FROM lineitem")
def inverse_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of the deltas give the values back."""
    d = staged(_deltas(spark, sf_dir), "deltas")
    run = ordered.running_total(d, ["l_suppkey"], ["l_orderkey", "l_linenumber"], "delta", "upto")
    return run.select("l_suppkey", "l_orderkey", "l_linenumber", F.pmod("upto", F.lit(1 << 32)).alias("restored"))


@book.frame("w03_byte_delta", "SELECT l_suppkey, count(*) AS n, CAST(sum(((l_linenumber - before) % 256 + 256) % 256) AS BIGINT) AS delta_sum FROM (SELECT l_suppkey, l_linenumber, lag(l_linenumber, 1, 0) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS before FROM lineitem) l GROUP BY l_suppkey")
def byte_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    run = ordered.with_previous(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"], {"l_linenumber": "before"})
    return run.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.pmod(F.col("l_linenumber") - F.coalesce("before", F.lit(0)), F.lit(256))).cast("bigint").alias("delta_sum"))




def _bundle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("bundle_id", "path", "doc_id")
    return ordered.with_previous(d, ["bundle_id"], ["path", "doc_id"], {"path": "path_before", "doc_id": "id_before"})


@book.frame("w05_zigzag_deltas", "SELECT doc_id, bundle_id, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS code FROM (SELECT doc_id, bundle_id, doc_id - lag(doc_id, 1, CAST(0 AS BIGINT)) OVER (PARTITION BY bundle_id ORDER BY path, doc_id) AS d FROM documents) x")
def zigzag_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle_order(spark, sf_dir).select("doc_id", "bundle_id", x.zigzag(F.col("doc_id") - F.coalesce("id_before", F.lit(0))).alias("code"))


_FRONT = "SELECT bundle_id, path, before FROM (SELECT bundle_id, path, lag(path, 1, '') OVER (PARTITION BY bundle_id ORDER BY path, doc_id) AS before FROM documents)"


@book.frame("w06_front_coding", f"SELECT bundle_id, path, len(list_filter(range(1, least(length(path), length(before)) + 1), lambda i: substring(path, 1, i) = substring(before, 1, i)))::bigint AS prefix FROM ({_FRONT})")
def front_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle_order(spark, sf_dir).select("bundle_id", "path", x.common_prefix(F.col("path"), F.col("path_before")).cast("bigint").alias("prefix"))


_CODES = "(SELECT vec_id, label, pos, CAST(floor(CAST(e AS DOUBLE) * 16) AS BIGINT) AS code FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, e) FROM {embeddings}) e0)"
_CODES_DUCK = "(SELECT vec_id, label, i - 1 AS pos, CAST(floor(CAST(embedding[i] AS DOUBLE) * 16) AS BIGINT) AS code FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}))"


def codes_sql(name: str, text: str) -> None:
    book.sql(name, text.replace("<codes>", _CODES), text.replace("<codes>", _CODES_DUCK))


codes_sql("a19_context_counts", "SELECT pos, before, code, count(*) AS n FROM (SELECT vec_id, pos, code, lag(code, 1, CAST(-99 AS BIGINT)) OVER (PARTITION BY vec_id ORDER BY pos) AS before FROM <codes> c) l GROUP BY pos, before, code")
codes_sql("w20_cell_context", "SELECT before, code, count(*) AS n FROM (SELECT code, lag(code, 1, CAST(-99 AS BIGINT)) OVER (PARTITION BY vec_id ORDER BY pos) AS before FROM <codes> c) l GROUP BY before, code")
codes_sql("x18_transpose", "SELECT pos, vec_id, code FROM <codes> c")
codes_sql("r11_matrix_dictionary", "SELECT code, n, dense_rank() OVER (ORDER BY code) - 1 AS symbol FROM (SELECT code, count(*) AS n FROM <codes> c GROUP BY code) d")
codes_sql("r12_ideal_code_length", "SELECT pos, round(sum(-n * ln(n / CAST(total AS DOUBLE)) / ln(2)), 3) AS bits FROM (SELECT pos, before, code, count(*) AS n, sum(count(*)) OVER (PARTITION BY pos, before) AS total FROM (SELECT vec_id, pos, code, lag(code, 1, CAST(-99 AS BIGINT)) OVER (PARTITION BY vec_id ORDER BY pos) AS before FROM <codes> c) l GROUP BY pos, before, code) t GROUP BY pos")
codes_sql("t03_decimal_order", "SELECT code, row_number() OVER (ORDER BY code) AS place FROM (SELECT DISTINCT code FROM <codes> c) d")
codes_sql("f10_matrix_shape", "SELECT count(DISTINCT vec_id) AS n_rows, max(width) AS n_cols, min(width) = max(width) AS rectangular FROM (SELECT vec_id, count(*) AS width FROM <codes> c GROUP BY vec_id) w".replace("count(DISTINCT vec_id) AS n_rows", "count(*) AS n_rows"))
@book.frame("r13_lane_code_length", "SELECT pos, round(sum(-ln((nth - 1 + CAST(1 AS DOUBLE)) / (seen - 1 + CAST(64 AS DOUBLE))) / ln(2)), 3) AS bits FROM (SELECT pos, row_number() OVER (PARTITION BY pos, code ORDER BY vec_id) AS nth, row_number() OVER (PARTITION BY pos ORDER BY vec_id) AS seen FROM <codes> c) r GROUP BY pos".replace("<codes>", _CODES_DUCK).format(embeddings="embeddings"))
def lane_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive code length of each lane, from running counts of its symbols and of all."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select("vec_id", "pos", F.floor(F.col("e").cast("double") * 16).alias("code"))
    seen = ordered.running_total(c, ["pos"], ["vec_id"], F.lit(1), "seen")
    both = ordered.running_total(seen, ["pos", "code"], ["vec_id"], F.lit(1), "nth")
    return both.groupBy("pos").agg(F.round(F.sum(-F.log2((F.col("nth") - 1 + 1.0) / (F.col("seen") - 1 + 64.0))), 3).alias("bits"))




# The rank of a byte is the number of others since its last use; of a new one, of those used and of the unused that are less.
_MTF_DUCK = """WITH h AS (SELECT doc_id, list_transform(range(strlen(text)), lambda i: substring(hex(encode(text)), 2 * i + 1, 2)) AS w FROM documents WHERE text <> ''),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM h), q AS (SELECT doc_id, w, i, lag(i) OVER (PARTITION BY doc_id, w[i] ORDER BY i) AS before FROM p),
r AS (SELECT doc_id, CASE WHEN before IS NOT NULL THEN len(list_distinct(w[before + 1 : i - 1])) ELSE len(list_distinct(w[1 : i - 1])) + len(list_filter(list_distinct(w), lambda c: c < w[i] AND NOT list_contains(w[1 : i - 1], c))) END AS rank FROM q)
SELECT doc_id, count(*)::int AS n, sum(rank)::bigint AS rank_sum, count(*) FILTER (WHERE rank = 0)::int AS zeros FROM r GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, 0 FROM documents WHERE text = ''"""


@book.frame("w04_move_to_front", _MTF_DUCK)
def move_to_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.mtf_ranks(docs(spark, sf_dir), "doc_id", "text")


@book.frame("r07_side_channel_modes")
def side_channel_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of raw, delta and move-to-front for each text's bytes by zlib size."""
    import zlib

    def modes(t: str):
        data = t.encode()
        forms = {"raw": data, "delta": bytes((b - a) % 256 for a, b in zip(b"\0" + data, data)), "mtf": r.move_to_front(data).astype("u1").tobytes()}
        sizes = {k: len(zlib.compress(v, 6)) for k, v in forms.items()}
        best = min(sizes, key=lambda k: (sizes[k], k))
        yield best, sizes[best]

    return r.per_text(docs(spark, sf_dir), "doc_id", "text", "mode string, n_bytes int", modes, spread=True).groupBy("mode").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("text"))


@book.frame("w09_xor_windows")
def xor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.per_text(_vectors(spark, sf_dir), "vec_id", "text", "bits int", lambda t: [(r.gorilla_bits(json.loads(t)),)])


@book.frame("r15_numeric_block_modes")
def numeric_block_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest representation of each block of values: of embeddings by vector, of prices by 1024 per supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    run = ordered.running_total(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"], F.lit(1), "n")
    prices = run.select("l_suppkey", "l_extendedprice", F.expr("(n - 1) div 1024").alias("block"), "n")
    blocks = prices.groupBy(F.concat(F.lit("price-"), "l_suppkey", F.lit("-"), "block").alias("block_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_extendedprice"))), lambda s: s["l_extendedprice"])).alias("text"))
    both = blocks.unionByName(_vectors(spark, sf_dir).select(F.concat(F.lit("vector-"), "vec_id").alias("block_id"), "text"))
    modes = r.per_text(both, "block_id", "text", "mode string, n_bytes int", lambda t: [r.block_mode(json.loads(t))])
    return modes.groupBy(F.split("block_id", "-")[0].alias("kind"), "mode").agg(F.count("*").alias("n_blocks"), F.sum("n_bytes").alias("n_bytes"))


# --- Bundles, neighbourhoods, grammars and codecs.
def _lanes(rows: DataFrame, path: str, unique: str, more: dict) -> DataFrame:
    """By lane: how many paths, the bytes of their front coding in path order, and further sums over the rows."""
    run = ordered.with_previous(rows, ["lane"], [path, unique], {path: "before", unique: "id_before"})
    prefix = x.common_prefix(F.col(path), F.coalesce("before", F.lit("")))
    run = run.withColumn("prefix", prefix.cast("bigint")).withColumn("rest", F.octet_length(path) - F.octet_length(F.left(F.col(path), F.col("prefix").cast("int"))))
    coded = x.varint_size(F.octet_length(F.left(F.col(path), F.col("prefix").cast("int"))).cast("bigint")) + x.varint_size(F.col("rest").cast("bigint")) + F.col("rest")
    return run.groupBy("lane").agg(F.count("*").alias("files"), F.sum(coded).cast("bigint").alias("path_bytes"), *[F.sum(c).cast("bigint").alias(name) for name, c in more.items()])


_V = "greatest(1, ceil(length(bin({})) / 7.0))::bigint"
_FRONT_DUCK = "len(list_filter(range(1, least(length({p}), length(before)) + 1), lambda i: substring({p}, 1, i) = substring(before, 1, i)))"


@book.frame("r16_source_lanes", f"""SELECT lane, count(*) AS files, sum({_V.format('k')} + {_V.format('strlen(path) - k')} + strlen(path) - k)::bigint AS path_bytes, sum(size_bytes)::bigint AS n_bytes FROM
  (SELECT *, {_FRONT_DUCK.format(p='path')} AS k FROM (SELECT lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) AS lane, path, size_bytes, lag(path, 1, '') OVER (PARTITION BY lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) ORDER BY path, id) AS before FROM corpus_items)) GROUP BY lane""")
def source_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files dealt to a lane per extension, with front-coded paths."""
    lane = F.lower(F.regexp_extract("path", "[.]([A-Za-z0-9]+)$", 1)).alias("lane")
    return _lanes(table(spark, sf_dir, "corpus_items").select(lane, "path", "id", "size_bytes"), "path", "id", {"n_bytes": F.col("size_bytes")})


@book.frame("r17_page_lanes", f"""SELECT lane, count(*) AS files, sum({_V.format('k')} + {_V.format('strlen(path) - k')} + strlen(path) - k)::bigint AS path_bytes, sum({_V.format('CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END')})::bigint AS id_bytes, sum(n)::bigint AS n_bytes FROM
  (SELECT *, {_FRONT_DUCK.format(p='path')} AS k FROM (SELECT regexp_extract(path, '^([^/]+)/', 1) AS lane, path, coalesce(strlen(text), 0) AS n, lag(path, 1, '') OVER w AS before, doc_id - lag(doc_id, 1, CAST(0 AS BIGINT)) OVER w AS d FROM documents WINDOW w AS (PARTITION BY regexp_extract(path, '^([^/]+)/', 1) ORDER BY path, doc_id))) GROUP BY lane""")
def page_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt to a lane per kind, with front-coded titles and differences of their ids."""
    rows = docs(spark, sf_dir).select(F.regexp_extract("path", "^([^/]+)/", 1).alias("lane"), "path", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return _lanes(rows, "path", "doc_id", {"id_bytes": x.varint_size(x.zigzag(F.col("doc_id") - F.coalesce("id_before", F.lit(0)))), "n_bytes": F.col("n")})


book.sql("r16_extension_lanes", "SELECT regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) AS lane, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM {corpus_items} GROUP BY regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)")
book.sql("r17_wiki_lanes", "SELECT regexp_extract(path, '^([^/]+)/', 1) AS lane, count(*) AS pages, CAST(max(doc_id) - min(doc_id) AS BIGINT) AS id_span FROM {documents} GROUP BY regexp_extract(path, '^([^/]+)/', 1)")
# Windows of 48 bytes: at 0 for texts no longer than that, else evenly spaced, at most 16 of them.
_WIN = f"(SELECT doc_id, n_len, md5(substring(text, CAST(at AS INT) + 1, 48)) AS f FROM (SELECT doc_id, text, length(text) AS n_len, explode({_offsets('length(text)', 48, 16)}) AS at FROM {{texts}} WHERE length(text) >= 48) w0)"
_WIN_DUCK = "(SELECT doc_id, n AS n_len, md5(substring(text, CAST(i * (n - 48) // greatest(least(16, n // 48) - 1, 1) AS INT) + 1, 48)) AS f FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, least(16, length(text) // 48))) AS i FROM {documents} WHERE length(text) >= 48))"


def windows_sql(name: str, text: str) -> None:
    book.sql(name, text.replace("<windows>", _WIN), text.replace("<windows>", _WIN_DUCK))


windows_sql("a17_fingerprint_frequency", "SELECT f, count(DISTINCT doc_id) AS n_docs FROM <windows> w GROUP BY f")
windows_sql("f17_frequency_band", "SELECT f, n_docs FROM (SELECT f, count(DISTINCT doc_id) AS n_docs FROM <windows> w GROUP BY f) c WHERE n_docs BETWEEN 2 AND (SELECT greatest(2, ceil(count(*) / 100.0)) FROM {documents})")
windows_sql("a18_minhash", "SELECT doc_id, min(md5(concat('1', f))) AS h1, min(md5(concat('2', f))) AS h2, min(md5(concat('3', f))) AS h3, min(md5(concat('4', f))) AS h4 FROM <windows> w GROUP BY doc_id")
windows_sql(
    "t02_neighbour_order",
    """WITH w AS (SELECT DISTINCT doc_id, n_len, f FROM <windows> w0), c AS (SELECT f, count(*) AS n_docs FROM w GROUP BY f), n AS (SELECT greatest(2, ceil(count(*) / CAST(100 AS DOUBLE))) AS most FROM {documents}),
    m AS (SELECT w.doc_id, w.n_len, w.f, c.n_docs BETWEEN 2 AND n.most AS band, max(CASE WHEN c.n_docs BETWEEN 2 AND n.most THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id) AS any_band FROM w JOIN c ON c.f = w.f CROSS JOIN n)
    SELECT doc_id, min(md5(concat('1', f))) AS h1, min(md5(concat('2', f))) AS h2, min(md5(concat('3', f))) AS h3, min(md5(concat('4', f))) AS h4, length(bin(max(n_len))) AS size_class FROM m WHERE band OR any_band = 0 GROUP BY doc_id""",
)


@book.frame("r18_neighbourhoods", f"SELECT doc_id, row_number() OVER (ORDER BY h1, h2, h3, h4, size_class, doc_id) AS place FROM ({book.oracles['t02_neighbour_order']})")
def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's place in an order by minhashes, by range partitions."""
    h = book.queries["t02_neighbour_order"](spark, sf_dir)
    return ordered.running_total(h, [], ["h1", "h2", "h3", "h4", "size_class", "doc_id"], F.lit(1), "place").select("doc_id", "place")


@book.frame("r19_template_columns")
def template_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = r.wiki_template_rows(docs(spark, sf_dir).filter("contains(text, '{{')"), "doc_id", "text")
    return t.groupBy("template", "parameter").agg(F.count("*").alias("n_values"), F.sum(F.octet_length("value")).alias("n_bytes"), F.max("depth").alias("deepest"))


@book.frame("t06_schema_order")
def schema_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates and parameters by length, then spelling."""
    c = template_columns(spark, sf_dir).select("template", "parameter", F.length("template").alias("l1"), F.length("parameter").alias("l2"))
    return ordered.running_total(c, [], ["l1", "template", "l2", "parameter"], F.lit(1), "place").select("template", "parameter", "place")


_SOURCE_LISTS_DUCK = r"""(SELECT doc_id, regexp_extract_all(text, '[ \t\r\n\f]+|#[^\n]*|"[^"\n]*"|''[^''\n]*''|0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?|[\pL_][\pL\pN_]*|[\s\S]') AS l
  FROM documents WHERE regexp_matches(text, '(?m)^[ \t]*(def \w+\(|class \w+|import \w+|from \w+ import |return\b)'))"""
_SOURCE_TOKENS_DUCK = f"(SELECT unnest(l) AS w FROM {_SOURCE_LISTS_DUCK})"


@book.frame("r20_source_tokens", r"""SELECT kind, count(*) AS n, count(DISTINCT w) AS n_distinct FROM (SELECT w, CASE WHEN regexp_matches(w, '^[ \t\r\n\f]+$|^#') THEN 'trivia' WHEN length(w) > 1 AND (w[1] = '"' OR w[1] = '''') THEN 'string'
  WHEN regexp_matches(w, '^[0-9]') THEN 'number' WHEN regexp_matches(w, '^[\pL_]') THEN 'name' ELSE 'sign' END AS kind FROM """ + _SOURCE_TOKENS_DUCK + ") WHERE kind <> 'trivia' GROUP BY kind")
def source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = r.python_token_rows(_sources(spark, sf_dir), "doc_id", "text")
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("spelling").alias("n_distinct"))


@book.frame("r20_identifier_ranks", rf"""WITH t AS (SELECT doc_id, list_filter(l, lambda x: NOT regexp_matches(x, '^[ \t\r\n\f]+$|^#')) AS l FROM {_SOURCE_LISTS_DUCK}), p AS (SELECT doc_id, l, unnest(range(len(l))) AS position FROM t),
n AS (SELECT doc_id, position, l[position + 1] AS name FROM p WHERE regexp_matches(l[position + 1], '^[\pL_]') AND l[position + 1] NOT IN ({", ".join(repr(k) for k in keyword.kwlist)})),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS i, list(name) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM n),
q AS (SELECT *, lag(i) OVER (PARTITION BY doc_id, name ORDER BY i) AS before, min(i) OVER (PARTITION BY doc_id, name) AS first_i FROM w)
SELECT doc_id, position::int AS position, (dense_rank() OVER (PARTITION BY doc_id ORDER BY first_i) - 1)::int AS lexicon_id, before IS NULL AS first, CASE WHEN before IS NULL THEN -1 ELSE len(list_distinct(w[before + 1 : i - 1])) END::int AS rank FROM q""")
def identifier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon id and the move-to-front rank of every name, text by text."""
    t = _sources(spark, sf_dir)
    return r.per_text(t, "doc_id", "text", "position int, lexicon_id int, first boolean, rank int", r.identifier_ranks, spread=True)


_USES = "position int, name string, scope int, parent int, use string, distance int, rank int"


@book.frame("j15_scope_bindings")
def scope_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of every name, and how many scopes further out the nearest one is that binds it."""
    return r.per_text(_sources(spark, sf_dir), "doc_id", "text", _USES, scopes.scope_uses, spread=True)


@book.frame("r20_scoped_identifiers")
def scoped_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the names' occurrences by scopes: whether new, near or further out, and the rank in the table that has it."""
    u = scope_bindings(spark, sf_dir)
    size = 1 + F.when(F.col("rank") >= 0, x.varint_size(F.col("rank").cast("bigint"))).otherwise(1) + F.when(F.col("distance") > 0, x.varint_size(F.col("distance").cast("bigint"))).otherwise(0)
    return u.groupBy("doc_id").agg(F.count("*").alias("names"), F.countDistinct("scope").alias("scopes"), *[F.count_if(F.col("use") == k).alias(k) for k in ("binding", "resolved", "free")], F.sum(size).alias("n_bytes"))


@book.frame("r22_codec_sizes")
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.text_codec_sizes(docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text"), "doc", "text")
    return s.groupBy(F.col("doc.source").alias("source"), "codec").agg(F.count("*").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"))


@book.frame("r21_selectors")
def all_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the four general selectors keeps of each text, and why."""
    rows = r.per_text(docs(spark, sf_dir), "doc_id", "text", "selector string, recipe string, reason string, n_bytes bigint", lambda t: selectors.every_selector(t.encode()), spread=True)
    return rows.groupBy("selector", "recipe", "reason").agg(F.count("*").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"))


@book.frame("r21_word_columns")
def word_column_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for binary columns: order keys of suppliers as 32-bit words, in blocks of up to 4096."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    run = ordered.running_total(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"], F.lit(1), "n")
    blocks = run.groupBy("l_suppkey", F.expr("(n - 1) div 4096").alias("block")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_orderkey"))), lambda v: v["l_orderkey"])).alias("text"))
    words = lambda t: struct.pack(f"<{t.count(',') + 1}I", *(v & 0xFFFFFFFF for v in json.loads(t)))
    rows = r.per_text(blocks, "l_suppkey", "text", "selector string, recipe string, reason string, n_bytes bigint", lambda t: selectors.every_selector(words(t)), spread=True)
    return rows.groupBy("selector", "recipe", "reason").agg(F.count("*").alias("n_blocks"), F.sum("n_bytes").alias("n_bytes"))


@book.frame("r04_table_backend")
def table_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct, columns or store for each delimited table, with the reason and the level."""
    b = r.per_text(_tables(docs(spark, sf_dir)), "doc_id", "text", "backend string, level int, reason string, n_bytes bigint", lambda t: [r.table_backend(t.encode())], spread=True)
    return b.groupBy("backend", "level", "reason").agg(F.count("*").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"))


@book.frame("r14_matrix_backend")
def matrix_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of each block of 256 vectors as a matrix of 16 steps to the unit, and as one of signs."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 256").alias("block"), F.col("embedding").cast("array<double>").alias("e"))
    steps, signs = F.transform("e", lambda c: F.floor(c * 16).cast("string")), F.transform("e", lambda c: F.when(c < 0, "-").otherwise("+"))
    named = v.select("vec_id", "block", F.inline(F.array(F.struct(F.lit("steps").alias("matrix"), steps.alias("cells")), F.struct(F.lit("signs").alias("matrix"), signs.alias("cells")))))
    blocks = named.groupBy("matrix", "block").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "cells"))), lambda x: x["cells"])).alias("text"))
    rows = r.per_text(blocks, "matrix", "text", "backend string, reason string, n_bytes bigint", lambda t: [selectors.matrix_backend(json.loads(t))], spread=True)
    return rows.groupBy("matrix", "backend", "reason").agg(F.count("*").alias("n_blocks"), F.sum("n_bytes").alias("n_bytes"))


@book.frame("m11_pair_grammar")
def pair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = r.per_text(docs(spark, sf_dir), "doc_id", "text", "rules int, n_left int", lambda t: [r.repair_grammar(list(t.encode()))], spread=True)
    return g


tokens_sql("m05_token_dictionary", "SELECT doc_id, count_if(nth > 1) AS hits, CAST(sum(CASE WHEN nth = 1 THEN length(token) ELSE 0 END) AS BIGINT) AS literal_bytes FROM (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) AS nth FROM <tokens> t) r GROUP BY doc_id")
tokens_sql("w13_token_code_length", "SELECT doc_id, round(sum(-ln((nth - 1 + CAST(0.5 AS DOUBLE)) / (pos + CAST(0.5 AS DOUBLE) * kinds)) / ln(2)), 3) AS bits FROM (SELECT t.doc_id, t.pos, k.kinds, row_number() OVER (PARTITION BY t.doc_id, t.token ORDER BY t.pos) AS nth FROM <tokens> t JOIN (SELECT doc_id, count(DISTINCT token) AS kinds FROM <tokens> t2 GROUP BY doc_id) k ON k.doc_id = t.doc_id) r GROUP BY doc_id")
@book.frame("t04_bytewise_order", "SELECT token, row_number() OVER (PARTITION BY substring(token, 1, 1) ORDER BY token) AS place FROM (SELECT DISTINCT token FROM <tokens> t) d".replace("<tokens>", _TOKENS_DUCK.replace("{{", "{").replace("}}", "}").replace("{documents}", "documents")))
def bytewise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's place among those of its first letter."""
    found = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{2,63}"), 0)).alias("token")).distinct()
    return ordered.running_total(found.withColumn("first", F.substring("token", 1, 1)), ["first"], ["token"], F.lit(1), "place").select("token", "place")


_PACKED_DUCK = r"""WITH t AS (SELECT source, unnest(CASE WHEN source = 'wikitext-dump' THEN regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''\-]{2,63}') ELSE regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,63}') END) AS token FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
c AS (SELECT source, token, count(*) AS n, count(*) * (length(token) - 2) - length(token) - 1 AS gain, 0 AS forced FROM t GROUP BY source, token HAVING count(*) >= 4 AND gain > 0 UNION ALL
  SELECT 'wikitext-dump', unnest(['{{', '}}', '[[', ']]', '<!--', '-->', '<ref', '</ref>', '<br', '==', '&nbsp;']), 0, 0, 1)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY forced DESC, gain DESC, n DESC, token))::int AS place, token, n, gain FROM c"""  # no source of the test tables reaches a limit


@book.frame("t09_greedy_packing", _PACKED_DUCK)
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.source_dictionaries(docs(spark, sf_dir))


def _arms(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], weights: list[float] | None = None) -> DataFrame:
    """(source, arm, bits)."""
    rows = mixtures.arm_rows(docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text"), "doc", "text", kinds, weights)
    return rows.groupBy(F.col("doc.source").alias("source"), "arm").agg(F.round(F.sum("bits"), 3).alias("bits"))


@book.frame("m07_arms")
def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of every arm by source: the full mixture, fixed equal weights, leave-one-out arms and credits."""
    return _arms(spark, sf_dir, ("full", "frozen", "without", "credit"))


book.queries["m06_refined_mixture"] = lambda spark, d: _arms(spark, d, ("full", "refined"))
book.queries["m08_context_mixture"] = lambda spark, d: mixtures.arm_rows(docs(spark, d), "doc_id", "text", ("full",)).select("doc_id", F.round("bits", 3).alias("bits"))
book.queries["m15_expert_credit"] = lambda spark, d: _arms(spark, d, ("credit",))


@book.frame("m14_quarter_losses")
def quarter_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits by source and quarter of the texts under the adaptive mixture."""
    rows = mixtures.quarter_rows(docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text"), "doc", "text")
    return rows.groupBy(F.col("doc.source").alias("source"), "quarter").agg(F.sum("n_bytes").alias("n_bytes"), F.round(F.sum("bits"), 3).alias("bits"))


@book.frame("m14_quarter_bytes", "SELECT source, q AS quarter, sum(strlen(text) * q // 4 - strlen(text) * (q - 1) // 4)::bigint AS n_bytes FROM documents, (SELECT unnest([1, 2, 3, 4]) AS q) WHERE text <> '' GROUP BY ALL")
def quarter_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes behind the quarters' losses."""
    return quarter_losses(spark, sf_dir).select("source", "quarter", "n_bytes")


@book.frame("m10_frozen_weights")
def frozen_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits by source under weights that were trained on all texts and then stay, beside equal ones."""
    d = docs(spark, sf_dir)
    trained = _arms(spark, sf_dir, ("frozen",), mixtures.trained_weights(d, "doc_id", "text")).withColumn("arm", F.lit("trained"))
    return trained.unionByName(_arms(spark, sf_dir, ("frozen",)).withColumn("arm", F.lit("equal")))


# Equal weights over orders 0 to 2, whose counts SQL can follow.
_LAGS = "concat(lag(b, 2, '00') OVER w, lag(b, 1, '00') OVER w)"
_PLACE = "row_number() OVER (PARTITION BY doc_id, {} ORDER BY pos)"
_P = " + ".join(f"(CAST(n{o} AS DOUBLE) - CAST(0.5 AS DOUBLE)) / (s{o} + 127)" for o in range(3))
bytes_sql("m10_low_orders", f"""SELECT doc_id, round(sum(-ln(({_P}) / 3) / ln(2)), 3) AS bits FROM (SELECT doc_id, {", ".join(f"{_PLACE.format(c + 'b')} AS n{o}, {_PLACE.format(c + '0')} AS s{o}" for o, c in enumerate(("", "right(c, 2), ", "c, ")))}
    FROM (SELECT doc_id, pos, b, {_LAGS} AS c FROM <bytes> t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) l) r GROUP BY doc_id""".replace(", 0 ORDER", " ORDER"))


@book.frame("m16_loss_by_class")
def loss_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures.class_losses(docs(spark, sf_dir), "doc_id", "text", r.class_runs).groupBy("class").agg(F.sum("n_bytes").alias("n_bytes"), F.round(F.sum("bits"), 3).alias("bits"))


@book.frame("m17_loss_closure", "SELECT doc_id, CAST(NULL AS BIGINT) AS n_bytes FROM documents WHERE false")
def loss_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose classes don't add up to their bytes: none."""
    c = mixtures.class_losses(docs(spark, sf_dir), "doc_id", "text", r.class_runs).groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"))
    return docs(spark, sf_dir).filter("text <> ''").join(c, "doc_id", "left").filter("NOT octet_length(text) <=> n_bytes").select("doc_id", "n_bytes")


@book.frame("s22_frame_metadata")
def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the texts' frames by recipe, read along the frames' heads."""
    rows = r.per_text(docs(spark, sf_dir), "doc_id", "text", "recipe string, original bigint, payload bigint", lambda t: [x[1:4] for x in frames.inspect_frame(frames.pack_frame(t.encode(), 512)).segments], spread=True)
    return rows.groupBy("recipe").agg(F.count("*").alias("n_segments"), F.sum("original").alias("original"), F.sum("payload").alias("payload"))


@book.frame("s23_stream_metadata", "SELECT doc_id, 'adaptive' AS layout, 3 AS version, strlen(text)::bigint AS original, sha256(text) AS sha256, ceil(strlen(text) / 1024.0)::int AS n_segments FROM documents WHERE text IS NOT NULL")
def stream_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the head of each text's frame says."""
    schema = "layout string, version int, original bigint, sha256 string, n_segments int"
    return r.per_text(docs(spark, sf_dir), "doc_id", "text", schema, lambda t: [(x.layout, x.version, x.original, x.sha256, len(x.segments)) for x in [frames.inspect_frame(frames.pack_frame(t.encode(), 1024))]], spread=True)


@book.frame("k09_segmented_sink", "SELECT doc_id, sum(strlen(text))::bigint AS n_bytes, ceil(max(strlen(text)) / 512.0)::bigint AS n_segments, md5(max(text)) AS digest FROM documents WHERE text <> '' GROUP BY doc_id")
def segmented_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written as one row per segment, read back, decoded and put together."""
    path = own_path(spark, "sinks", "segments")
    frames.segment_rows(docs(spark, sf_dir), "doc_id", "text", 512).write.partitionBy("recipe").parquet(path)
    rows = spark.read.schema("doc_id bigint, " + frames.SEGMENT_ROWS).parquet(path)
    whole = frames.decoded_segments(rows).groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.array_sort(F.collect_list(F.struct("segment", "data"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.decode(x["data"], "ISO-8859-1")), "")
    return whole.select("doc_id", F.length(text).cast("bigint").alias("n_bytes"), "n_segments", F.md5(F.encode(text, "ISO-8859-1")).alias("digest"))


book.oracles["k09_segmented_frames"] = "SELECT true AS intact, count(*) AS n FROM documents WHERE text IS NOT NULL"
book.queries["k09_segmented_frames"] = lambda spark, d: r.per_text(docs(spark, d), "doc_id", "text", "intact boolean", lambda t: [(frames.unpack_frame(frames.pack_frame(t.encode(), 512)) == t.encode(),)], spread=True).groupBy("intact").agg(F.count("*").alias("n"))


@book.frame("a29_manifest_digest", "SELECT bundle_id, count(*) AS files, sum(('0x' || substr(md5(path || chr(10) || coalesce(text, '')), 1, 12))::bigint)::bigint AS digest FROM documents GROUP BY bundle_id")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free manifest digest per bundle, in place of a chained one, so no bundle is gathered."""
    bits = F.conv(F.substring(F.md5(F.concat("path", F.lit("\n"), F.coalesce("text", F.lit("")))), 1, 12), 16, 10).cast("bigint")
    return docs(spark, sf_dir).groupBy("bundle_id").agg(F.count("*").alias("files"), F.sum(bits).alias("digest"))


# --- Rules.
_RULE_ROWS = "(SELECT doc_id, length(text) AS size, source = 'service-log' AS wins FROM {documents} WHERE text IS NOT NULL AND source IS NOT NULL)"
_RULES = "(SELECT 100 * k AS line FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 8 UNION ALL SELECT 16) k0)"
book.sql("m19_rule_costs", f"SELECT line, count_if(wins AND size <= line) AS misses, count_if(NOT wins AND size > line) AS false_positives FROM {_RULE_ROWS} r CROSS JOIN {_RULES} t GROUP BY line")
book.sql("m19_best_rule", f"SELECT line, cost FROM (SELECT line, cost, row_number() OVER (ORDER BY cost, line) AS place FROM (SELECT line, count_if(wins AND size <= line) + count_if(NOT wins AND size > line) AS cost FROM {_RULE_ROWS} r CROSS JOIN {_RULES} t GROUP BY line) c) p WHERE place = 1")


@book.frame("m19_learned_rules")
def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rule of up to two predicates over all sources, and one for each source left out. Channels pay off on
    long items only: an item is the texts of a source with 4,096 consecutive ids, so no task holds a source."""
    texts = docs(spark, sf_dir).filter("source IS NOT NULL AND text IS NOT NULL").groupBy("source", F.floor(F.col("doc_id") / 4096).alias("item")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    return rules.learned_rules(rules.family_rows(texts.select("source", F.array_join("t.text", "\n").alias("text")), "source", "text"))


@book.frame("m20_held_out")
def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of frozen rules on the source that each of them has not seen, against what would have won."""
    return learned_rules(spark, sf_dir).filter("holdout IS NOT NULL").groupBy("wins", "decision").agg(F.count("*").alias("n_sources"))


book.sql("m20_frozen_rule", f"SELECT wins, size > 800 AS predicted, count(*) AS n FROM {_RULE_ROWS} r GROUP BY wins, size > 800")
book.sql("m18_projected_gain", "SELECT source, count(*) AS n, CAST(sum(octet_length(text)) AS BIGINT) AS n_bytes, round(avg(octet_length(text)), 6) AS mean, round(avg(octet_length(text)) + 2 * stddev_pop(octet_length(text)) / sqrt(count(text)), 3) AS upper_bound FROM {documents} WHERE text IS NOT NULL GROUP BY source", "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, round(avg(strlen(text)), 6) AS mean, round(avg(strlen(text)) + 2 * stddev_pop(strlen(text)) / sqrt(count(text)), 3) AS upper_bound FROM {documents} WHERE text IS NOT NULL GROUP BY source")


@book.frame("m18_predictor_ceiling")
def predictor_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected bytes and gains of the predictors P0, P1 and P2 by source."""
    d = docs(spark, sf_dir).select("doc_id", "source", "text")
    dictionaries = staged(r.source_dictionaries(d), "m18-dictionaries")
    weights = staged(r.byte_totals(d.filter("source IS NOT NULL"), "source", "text"), "m18-weights")
    return r.projected_gains(r.predictor_rows(d, dictionaries, weights), dictionaries, weights)


# --- Scalar functions.


@book.frame("x01_path_functions", "SELECT id, lower(regexp_extract(path, '(?:^|/)[^/]+([.][^./]+)$', 1)) AS extension, lower(regexp_replace(regexp_replace(dataset, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM corpus_items")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_items").select("id", x.extension(F.col("path")).alias("extension"), x.slug(F.col("dataset")).alias("slug"))


@book.frame("x13_integer_codes", "SELECT trial_id, CASE WHEN compressed_bytes - original_bytes >= 0 THEN 2 * (compressed_bytes - original_bytes) ELSE -2 * (compressed_bytes - original_bytes) - 1 END AS zigzag, greatest(1, ceil(length(bin(compressed_bytes)) / 7.0))::int AS varint_size FROM (SELECT DISTINCT trial_id, compressed_bytes, original_bytes FROM trials WHERE compressed_bytes > 0 AND original_bytes IS NOT NULL)")
def integer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "trials").filter("compressed_bytes > 0 AND original_bytes IS NOT NULL").select("trial_id", "compressed_bytes", "original_bytes").distinct()
    return t.select("trial_id", x.zigzag(F.col("compressed_bytes") - F.col("original_bytes")).alias("zigzag"), x.varint_size(F.col("compressed_bytes")).alias("varint_size"))


book.sql("x14_digests", "SELECT doc_id, sha2(text, 256) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM {documents} WHERE text IS NOT NULL", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM {documents} WHERE text IS NOT NULL")


@book.frame("x14_fnv1a", """SELECT id, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::bigint AS fnv1a FROM
  (SELECT id, list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(strlen(id)), lambda i: ascii(substring(id, i + 1, 1))::UBIGINT)), lambda h, b: (xor(h, b)::UHUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT) AS h FROM codecs)""")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udf_hashes(spark, sf_dir).select("id", "fnv1a")


@book.frame("x14_udf_hashes")
def udf_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "codecs")
    return c.select("id", x.fnv1a64(F.encode("id", "UTF-8")).alias("fnv1a"), x.blake2b64(F.encode("id", "UTF-8")).alias("blake2b"), F.crc32(F.encode("id", "UTF-8")).alias("crc32"))


book.sql("x17_timestamps", "SELECT trial_id, date_format(recorded_at, 'yyyy-MM-dd HH:mm:ss') AS stamp FROM {trials}", "SELECT trial_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS stamp FROM {trials}")
book.sql("x20_map_get", "SELECT id, coalesce(provenance['generator'], '') AS generator, cardinality(provenance) AS n_keys FROM {corpus_items}", "SELECT id, coalesce(provenance['generator'], '') AS generator, cardinality(provenance) AS n_keys FROM {corpus_items}")
book.sql("u06_missing_fields", "SELECT id FROM {corpus_items} WHERE sha256 IS NULL OR content IS NULL OR split IS NULL")


@book.frame("x04_common_edges", _SPLICES_DUCK + " SELECT prefix::int AS prefix, suffix::int AS suffix, count(*) AS n FROM s GROUP BY ALL")
def common_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.splice_residuals(docs(spark, sf_dir), "doc_id", "text")
    return s.groupBy("prefix", "suffix").agg(F.count("*").alias("n"))


@book.frame("x05_sizes", "SELECT text, CASE text WHEN '16MiB' THEN 16777216 WHEN '512k' THEN 524288 WHEN '7' THEN 7 END AS n_bytes FROM (SELECT unnest(['16MiB', '512k', '7', 'unlimited']) AS text)")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("16MiB",), ("512k",), ("7",), ("unlimited",)], "text string")
    return t.select("text", x.size_bytes(F.col("text")).alias("n_bytes"))


book.sql("x03_namespaces", "SELECT doc_id, lower(trim(regexp_extract(text, '^([^:\n]{{1,64}}):', 1))) AS namespace FROM {documents} WHERE text IS NOT NULL")
book.sql("x08_case_collisions", "SELECT lower(codec) AS folded, count(DISTINCT codec) AS spellings FROM {codec_census} GROUP BY lower(codec) HAVING count(DISTINCT codec) > 1")
tokens_sql("x09_identifiers", "SELECT doc_id, count(*) AS n, min(token) AS first_token, max(length(token)) AS longest FROM <tokens> t GROUP BY doc_id")
book.sql("x15_integer_math", "SELECT trial_id, length(bin(original_bytes)) AS bits, CAST(floor(sqrt(CAST(original_bytes AS DOUBLE))) AS BIGINT) AS root, least(greatest(repetition, 0), 5) AS clamped FROM (SELECT DISTINCT trial_id, original_bytes, repetition FROM {trials} WHERE original_bytes > 0) t")


@book.frame("x16_exact_decimals", "SELECT p_partkey, (list_position([" + ", ".join(f"format('{{:.{k}f}}', p_retailprice)::double = p_retailprice" for k in range(18)) + "], true) - 1)::int AS digits FROM part")
def exact_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many digits after the point give each price back bit by bit."""
    def digits(t: str):
        v = json.loads(t)
        yield (next((d for d in range(18) if float(f"{v:.{d}f}") == v), None),)

    p = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_retailprice").alias("v"))).alias("j")).select("p_partkey", F.get_json_object("j", "$.v").alias("text"))
    return r.per_text(p, "p_partkey", "text", "digits int", digits)


@book.frame("x19_merged_ranges", "WITH r AS (SELECT doc_id, unnest([0, CAST(floor(length(text) / 2.0::double) AS BIGINT) - 60, length(text) - 120]) AS a FROM documents WHERE length(text) > 120), o AS (SELECT doc_id, greatest(a, 0) AS a, greatest(a, 0) + 120 AS b FROM r), g AS (SELECT doc_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o), i AS (SELECT doc_id, a, b, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT doc_id, island::bigint AS island, min(a)::bigint AS first_at, max(b)::bigint AS end_at FROM i GROUP BY doc_id, island")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last sample of each text, overlapping ones merged."""
    n = F.length("text")
    d = docs(spark, sf_dir).filter(n > 120).select("doc_id", F.explode(F.array(F.lit(0).cast("bigint"), F.floor(n / 2) - 60, (n - 120).cast("bigint"))).alias("a"))
    o = d.select("doc_id", F.greatest("a", F.lit(0)).alias("a")).withColumn("b", F.col("a") + 120)
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    g = o.withColumn("fresh", F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    i = g.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("doc_id", "island").agg(F.min("a").alias("first_at"), F.max("b").alias("end_at"))


# --- Generators.


def _splitmix_duck(i: str) -> str:
    """The generator's value at an index, in integers of 128 bits."""
    z = f"(({i} + 1)::UHUGEINT * 11400714819323198485 % 18446744073709551616)::UBIGINT"
    for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
        z = f"(xor({z}, {z} >> {shift})::UHUGEINT * {factor} % 18446744073709551616)::UBIGINT" if shift == 30 else f"(xor(z1, z1 >> {shift})::UHUGEINT * {factor} % 18446744073709551616)::UBIGINT"
        if shift == 30:
            first = z
    return f"(SELECT id, xor(z2, z2 >> 31) AS u FROM (SELECT id, {z} AS z2 FROM (SELECT id, {first} AS z1 FROM (SELECT unnest(range(2000)) AS id))))".replace(i, "id")


_KINDS = ["logs", "records", "table", "ramp", "text", "noise", "sparse", "mixed"]


@book.frame("s18_smoke_corpus", f"""SELECT id, kind, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::bigint AS seed, left(repeat(kind || ' ' || id, 256), 256) AS content
  FROM (SELECT id, u, {_KINDS}[id % 8 + 1] AS kind FROM {_splitmix_duck('id')} WHERE id < 64)""")
def smoke_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic items of eight categories from their numbers alone."""
    i = spark.range(0, 64).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("id") % 8 + 1).cast("int")))
    return i.select("id", "kind", x.splitmix64(F.col("id")).alias("seed"), x.repeat_to(F.concat_ws(" ", "kind", F.col("id").cast("string")), 256).alias("content"))


# Residues of the signed value, as it is taken from a signed column.
_SIGNED = "((CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END) % {0} + {0}) % {0}"


@book.frame("s19_synthetic_ndjson", f"""SELECT id, '{{"template":' || {_SIGNED.format(8)} || ',"session":' || {_SIGNED.format(31)} || ',"value":' || {_SIGNED.format(997)} || ',"ts":' || id * 10 || '}}' AS record FROM {_splitmix_duck('id')}""")
def synthetic_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.range(0, 2000).withColumn("r", x.splitmix64(F.col("id")))
    return i.select("id", F.to_json(F.struct(F.pmod("r", F.lit(8)).alias("template"), F.pmod("r", F.lit(31)).alias("session"), F.pmod("r", F.lit(997)).alias("value"), (F.col("id") * 10).alias("ts"))).alias("record"))


@book.frame("s20_incompressible", "SELECT id, " + " || ".join(f"sha256('{k}:' || id)" for k in range(8)) + " AS block FROM (SELECT unnest(range(256)) AS id)")
def incompressible_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.range(0, 256)
    return i.select("id", F.concat(*[F.sha2(F.concat_ws(":", F.lit(str(k)), F.col("id").cast("string")), 256) for k in range(8)]).alias("block"))


QUERIES, ORACLES = book.queries, book.oracles
