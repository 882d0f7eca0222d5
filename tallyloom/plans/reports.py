"""Rendered tables and charts as numbered lines; nothing is collected, so a report may have any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered

# The marker of each kind of outcome.
MARKERS = {"candidate": "—", "win": "✅", "loss": "❌", "mixed": "⚠️", "pass": "✅", "fail": "❌"}
BAR, WIDTH, LABEL = 20, 600, 180  # pixels of a chart's bars and labels


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def outcome(c: Column) -> Column:
    """The outcome behind its marker; its kind is what stands before a colon."""
    kind = F.lower(F.trim(F.substring_index(c, ":", 1)))
    marker = F.lit("—")
    for k, m in MARKERS.items():
        marker = F.when(kind == k, F.lit(m)).otherwise(marker)
    return F.concat(marker, F.lit(" "), escape(c))


def _two_digits(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c.cast("double"))).otherwise("")


def cell(df: DataFrame, name: str) -> Column:
    """A column's values as they stand in a table: two digits for fractions, nothing for null."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return _two_digits(F.col(name))
    return F.coalesce(escape(F.col(name).cast("string")), F.lit(""))


def _numbered(df: DataFrame, order: list[str], lines: Column, before: list[str], after: list[str] = ()) -> DataFrame:
    """(line_no, line): fixed lines around one line per row in ascending ``order``, which must be unique."""
    spark = df.sparkSession
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], lines.alias("line"))
    placed = ordered.running_total(rows, [], [f"_o{i}" for i in range(len(order))], F.lit(1), "line_no")
    body = placed.select((F.col("line_no") + len(before)).alias("line_no"), "line")
    head = spark.createDataFrame(list(enumerate(before, 1)), "line_no bigint, line string")
    if not after:
        return head.unionByName(body)
    tail = spark.createDataFrame(list(enumerate(after, 1)), "line_no bigint, line string").crossJoin(df.agg(F.count("*").alias("n")))
    return head.unionByName(body).unionByName(tail.select((F.col("line_no") + len(before) + F.col("n")).alias("line_no"), "line"))


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line) of a Markdown table of all rows."""
    shown = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(df, c) for c in df.columns]), F.lit(" |"))
    return _numbered(df, order, shown, ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)])


def gate_lines(checks: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line): a verdict and the checks behind it, the boolean column ``passed`` among them; no checks are a
    failure, and so is a null."""
    verdict = checks.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("ok"))
    first = verdict.select(F.lit(1).cast("bigint").alias("line_no"), F.when(F.col("ok"), "**PASS**").otherwise("**FAIL**").alias("line"))
    blank = checks.sparkSession.createDataFrame([(2, "")], "line_no bigint, line string")
    shown = checks.withColumn("passed", outcome(F.when(F.col("passed"), "pass").otherwise("fail")))
    return first.unionByName(blank).unionByName(markdown_lines(shown, order).withColumn("line_no", F.col("line_no") + 2))


def svg_lines(df: DataFrame, label: str, value: str, order: list[str], title: str) -> DataFrame:
    """(line_no, line) of an SVG bar chart with a bar per row, as long as its value against the greatest; a null or
    negative value has none. Bars stand in order of their lines."""
    greatest = df.agg(F.greatest(F.max(value), F.lit(0.0)).alias("_greatest"), F.count("*").alias("_n"))
    rows = ordered.running_total(df.select(*dict.fromkeys([*order, label, value])), [], order, F.lit(1), "_at").crossJoin(greatest)
    text = F.coalesce(F.col(label).cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    top = (F.col("_at") * BAR).cast("bigint")
    long = F.when((F.col(value) > 0) & (F.col("_greatest") > 0), F.round(F.col(value) / F.col("_greatest") * WIDTH, 2)).otherwise(F.lit(0.0))
    bar = F.format_string(f'<g><text x="0" y="%d">%s</text><rect x="{LABEL}" y="%d" width="%.2f" height="{BAR - 4}"/><text x="%.2f" y="%d">%s</text></g>', top + BAR - 6, text, top, long, long + LABEL + 4, top + BAR - 6, _two_digits(F.col(value)))
    lines = rows.withColumn("_bar", bar)
    head = greatest.select(F.lit(1).cast("bigint").alias("line_no"), F.format_string(f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH + LABEL + 80}" height="%d"><title>{title}</title>', (F.col("_n") + 2) * BAR).alias("line"))
    tail = greatest.select((F.col("_n") + 2).alias("line_no"), F.lit("</svg>").alias("line"))
    return head.unionByName(lines.select((F.col("_at") + 1).alias("line_no"), F.col("_bar").alias("line"))).unionByName(tail)
