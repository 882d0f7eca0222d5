"""Sessions, table loading and staged intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings trials trials_mirror codecs "
    "corpus_items estimator_sources codec_census run_files receipts mix_targets"
).split()


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALLYLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own on a local master, and
    an error on any other, whose executors would each write to a disk of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), f"tallyloom-{os.getuid()}")
    return place.rstrip("/")


_KEPT: dict[str, SparkSession] = {}  # folders written and not yet removed


def own_path(spark: SparkSession, kind: str, label: str) -> str:
    """A new path in the shared folder, removed by ``release`` or when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}/{label}-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and lets several consumers read one result; the files outlive any executor. They are removed when the
    ``staging`` block around ends, or with the driver.
    """
    spark = df.sparkSession
    path = own_path(spark, "staged", label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(paths: Iterable[str] | None = None) -> None:
    """Removes the given folders of ours, or all; tables that read them can't be read any more."""
    for path in list(_KEPT if paths is None else paths):
        spark = _KEPT.pop(path, None)
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may already be gone
            pass


@contextmanager
def staging() -> Iterator[None]:
    """Removes at its end what was written to the shared folder inside: read or write a query's result within."""
    before = set(_KEPT)
    try:
        yield
    finally:
        release([p for p in _KEPT if p not in before])


atexit.register(release)
