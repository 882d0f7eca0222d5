"""Incremental forms over file streams; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_path


def _places(spark: SparkSession, label: str) -> tuple[str, str]:
    base = own_path(spark, "streams", label)
    return f"{base}/out", f"{base}/state"


def file_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of Parquet files with the schema of what is there; ``path`` is a folder or a single file."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern that matches the path only: a stream may then start at a file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all files there are and gives its result table. Output and state are in the shared folder;
    a restart from the same state writes nothing twice."""
    spark = stream.sparkSession
    out, state = _places(spark, label)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_accounts(events: DataFrame) -> DataFrame:
    """Counts and bytes per event type, kept up as files arrive."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("n_bytes"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


SEGMENT = "user_id bigint, event_id bigint, segment bigint"


def segments(events: DataFrame, target: int = 256) -> DataFrame:
    """(user_id, event_id, segment): each user's events cut into segments of about ``target`` bytes of props, ending at
    records. State is one running size per user; within a batch events go by event_id."""

    def cut(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        size = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("event_id")
        sizes = rows["props"].fillna("").map(lambda s: len(s.encode())).cumsum() + size
        state.update((int(sizes.iloc[-1]),))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "segment": (sizes - rows["props"].fillna("").map(lambda s: len(s.encode()))) // target})

    return events.select("user_id", "event_id", "props").groupBy("user_id").applyInPandasWithState(cut, SEGMENT, "size bigint", "append", "NoTimeout")


def first_sights(events: DataFrame) -> DataFrame:
    """(user_id, event_id, reused): whether a user had the same props before. State is one flag per user and digest of
    props, so it grows by what is new and no batch reads what a user had before; within a batch events go by event_id."""

    def look(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        reused = [True] * len(rows)
        reused[0] = state.exists
        state.update((True,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "reused": reused})

    digest = F.xxhash64(F.coalesce("props", F.lit(""))).alias("digest")
    keyed = events.select("user_id", "event_id", digest).groupBy("user_id", "digest")
    return keyed.applyInPandasWithState(look, "user_id bigint, event_id bigint, reused boolean", "seen boolean", "append", "NoTimeout")
