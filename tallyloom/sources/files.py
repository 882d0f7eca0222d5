"""File sources: whole files, manifests, archives of records and wiki dumps."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, n_bytes, sha256) of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """The items of a JSON manifest with schema_version 1 or 2; other versions raise when read."""
    items = spark.read.option("multiLine", "true").json(path)
    checked = items.withColumn("_ok", F.assert_true(F.col("schema_version").isin(1, 2))).filter("_ok IS NULL")
    rows = checked.select(F.inline("items"))
    return rows.filter(F.col("split").isin(splits)) if splits else rows


def verify_manifest(items: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(id, problem) of items whose file is missing or has another size or digest; no rows for an intact corpus.

    Items and files meet by the path relative to ``root``, the folder of the manifest, so equal names in two folders
    stay apart; './' and doubled slashes in a manifest make no difference."""
    whole = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:(//)?(?=/)", ""), r"/(\./|/)+", "/")
    f = files.select(whole(F.col("path")).alias("name"), "n_bytes", F.col("sha256").alias("found"))
    met = items.join(f, whole(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(items["path"], r"^(\./)+", ""))) == f["name"], "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("n_bytes") != F.col("size_bytes"), "size").when(F.col("found") != F.lower("sha256"), "digest")
    return met.select("id", problem.alias("problem")).filter("problem IS NOT NULL")


def archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of archive files, one row each."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _members(files: DataFrame, read: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """(archive, member, content) of every member, archive by archive and member by member next to the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, data in read(content):
                    yield pa.RecordBatch.from_arrays([pa.array([archive], pa.string()), pa.array([name], pa.string()), pa.array([data], pa.binary())], ["archive", "member", "content"])

    return files.mapInArrow(run, "archive string, member string, content binary")


def tar_members(files: DataFrame) -> DataFrame:
    """(archive, member, content) of the regular files in tar archives (path, content), compressed or not."""

    def read(content: bytes) -> Iterator[tuple[str, bytes]]:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()

    return _members(files, read)


def zip_members(files: DataFrame, pattern: str = "") -> DataFrame:
    """(archive, member, content) of the files in zip archives (path, content) whose name matches; members that are gzip
    files themselves are decompressed and lose the '.gz'."""
    wanted = re.compile(pattern)

    def read(content: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir() and wanted.search(m.filename):
                    data = z.read(m)
                    zipped = m.filename.endswith(".gz")
                    yield m.filename.removesuffix(".gz"), gzip.decompress(data) if zipped else data

    return _members(files, read)


def safe_members(members: DataFrame, extensions: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Members with a safe relative path: no leading '/', backslash, or part that is empty, '.' or '..'; with an allowed
    extension and without an excluded part where these are given; and none whose path differs only in case from another
    in its archive, as both can't be kept everywhere."""
    parts = F.split("member", "/")
    safe = members.filter(~F.contains("member", F.lit("\\")) & (F.size(F.filter(parts, lambda p: p.isin("", ".", ".."))) == 0))
    if extensions is not None:
        safe = safe.filter(F.regexp_extract("member", "[.]([^./]+)$", 1).isin(extensions))
    if excluded:
        safe = safe.filter(~F.arrays_overlap(parts, F.array(*[F.lit(e) for e in excluded])))
    folded = safe.groupBy("archive", F.lower("member").alias("_folded")).agg(F.countDistinct("member").alias("_n")).filter("_n > 1")
    return safe.withColumn("_folded", F.lower("member")).join(folded.select("archive", "_folded"), ["archive", "_folded"], "left_anti").drop("_folded")


def utf8(content: Column) -> Column:
    """The bytes as text; null where they are no UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def packed_archives(members: DataFrame, kind: str) -> DataFrame:
    """(path, content) of one archive per ``archive``: its members (archive, member, content) in order of their names, as
    'tar', 'zip', or 'zip+gzip' with every member a gzip file. An archive is made in one task, so keep it to a file's size."""

    def pack(rows: pa.Table) -> pa.Table:
        out, found = io.BytesIO(), sorted(zip(rows.column("member").to_pylist(), rows.column("content").to_pylist()))
        if kind == "tar":
            with tarfile.open(fileobj=out, mode="w") as t:
                for name, data in found:
                    info = tarfile.TarInfo(name)
                    info.size = len(data or b"")
                    t.addfile(info, io.BytesIO(data or b""))
        else:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in found:
                    packed = kind == "zip+gzip"
                    z.writestr(name + ".gz" * packed, gzip.compress(data or b"", mtime=0) if packed else data or b"")
        return pa.Table.from_arrays([pa.array([rows.column("archive")[0].as_py()], pa.string()), pa.array([out.getvalue()], pa.binary())], ["path", "content"])

    return members.select("archive", "member", "content").groupBy("archive").applyInArrow(pack, "path string, content binary")


PAGE = "title string, ns int, id bigint, redirect struct<_title:string>, revision array<struct<id:bigint,text:string>>"


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, revision_id, text) of the last revisions of the articles of a MediaWiki XML dump (plain or bz2):
    namespace 0, no redirects, non-empty text."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    last = F.element_at("revision", -1)
    found = pages.filter("ns = 0 AND redirect IS NULL").select(F.col("id").alias("page_id"), "title", last["id"].alias("revision_id"), last["text"].alias("text"))
    return found.filter("text <> ''")
