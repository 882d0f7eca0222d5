"""Queries written once as SQL and run by both engines; {table} names a table."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import trials as t
from ..session import TABLES, table

_CURRENT = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY recorded_at DESC) AS rn FROM trials) WHERE rn = 1)"
_MEDIANS = "(SELECT item_id, codec_id, count(*) AS repetitions, " + ", ".join(f"floor(median({m}))::bigint AS {m}" for m in t.MEASURES) + f" FROM {_CURRENT} WHERE roundtrip_ok AND repetition > 0 GROUP BY item_id, codec_id)"
_SUMMARY = f"""(SELECT *, round(CASE WHEN original_bytes <> 0 THEN 100.0::double * compressed_bytes / original_bytes ELSE 0 END, 6) AS compressed_percent,
  round(CASE WHEN compression_ns > 0 THEN (original_bytes / 1e6) / (compression_ns / 1e9) ELSE 0 END, 6) AS compression_mbps,
  round(CASE WHEN decompression_ns > 0 THEN (original_bytes / 1e6) / (decompression_ns / 1e9) ELSE 0 END, 6) AS decompression_mbps
  FROM (SELECT codec_id, count(*) AS items, sum(original_bytes)::bigint AS original_bytes, sum(compressed_bytes)::bigint AS compressed_bytes, sum(compression_ns)::bigint AS compression_ns,
    sum(decompression_ns)::bigint AS decompression_ns, max(compression_peak_rss_bytes) AS max_rss_bytes, count(*) FILTER (WHERE compressed_bytes > original_bytes) AS expanded_items, round(CASE WHEN sum(compression_ns) <> 0 THEN 100.0::double * coalesce(sum(selector_ns), 0) / sum(compression_ns) ELSE 0 END, 6) AS selector_time_percent FROM {_MEDIANS} GROUP BY codec_id))"""


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.current_trials(table(spark, sf_dir, "trials"))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.trial_medians(current(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.codec_summary(medians(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt to all tasks by doc_id: what is later cut out of a text stays in its task, so windows and
    aggregates by doc_id (and anything finer) need no shuffle of the many small rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


# Relations that queries name like tables: the operator that makes them, and their SQL.
DERIVED = {"current": (current, _CURRENT), "medians": (medians, _MEDIANS), "summary": (summary, _SUMMARY), "texts": (texts, "documents")}


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, other: str | None = None) -> None:
        """The same text for both engines, or ``other`` for DuckDB where their dialects differ."""
        named = set(re.findall(r"(?<!\{)\{([a-z_]\w*)\}(?!\})", text))
        makers = {n: DERIVED[n][0] if n in DERIVED else partial(table, name=n) for n in named}
        self.queries[name] = lambda spark, sf_dir: spark.sql(text, **{n: f(spark, sf_dir) for n, f in makers.items()})
        self.oracles[name] = (other or text).format(**{x: x for x in TABLES}, **{n: q for n, (_, q) in DERIVED.items()}).replace("count_if(", "count(*) FILTER (WHERE ")

    def frame(self, name: str, oracle: str | None = None):
        """Decorator for a DataFrame query with its SQL equivalent, if there is one."""

        def keep(f):
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle.replace("count_if(", "count(*) FILTER (WHERE ")
            return f

        return keep
