"""Row and field differences between two copies of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed spellings of flags.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "off"]


def outer_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_value(c: Column) -> Column:
    """Text where null and the empty string are the same value."""
    return F.coalesce(c, F.lit(""))


def flag_value(c: Column) -> Column:
    """'true' or 'false' for any spelling of a flag; other words stay as they are, null and blank are null."""
    w = F.lower(outer_trim(c.cast("string")))
    return F.when(w.isin(TRUE_WORDS), F.lit("true")).when(w.isin(FALSE_WORDS), F.lit("false")).when(w == "", F.lit(None)).otherwise(w)


def digest_text(c: Column) -> Column:
    """A digest in lower case without outer white space and without a leading algorithm label."""
    return F.regexp_replace(F.lower(outer_trim(c)), r"^(sha-?256|sha-?1|md5)\s*[:=-]\s*", "")


def digest_value(c: Column) -> Column:
    """A digest as bytes: 32 bytes for 64 hexadecimal digits, else the text behind a zero byte; null is empty text."""
    d = F.coalesce(digest_text(c), F.lit(""))
    return F.when(d.rlike("^[0-9a-f]{64}$"), F.unhex(d)).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(d, "UTF-8")))


def digest_shown(c: Column) -> Column:
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, 2, (1 << 31) - 1), "UTF-8"))


def compare_copies(left: DataFrame, right: DataFrame, key: str, fields: list[str], missing_left: str, missing_right: str, digests: tuple[str, ...] = ()) -> DataFrame:
    """Merge two keyed copies and report what differs: (key, issue, left_value, right_value).

    Both sides hold at most one row per key (see ``current_rows``) and equally typed ``fields``. The union of the two
    sides crosses one range exchange, so both copies share the same split points; each partition is sorted by key and
    side, and the merge walks that run once, the row and its neighbour being the two pointers. No side is broadcast or
    held in memory, and the range boundaries are sampled, so key skew and data order don't matter.

    ``issue`` is ``missing_left``/``missing_right`` or the name of a differing field. Null equals null and nothing
    else. Null keys match each other. An empty side makes every row of the other a missing one.
    """
    side = lambda df, n: df.select(F.col(key).alias("_k"), F.lit(n).cast("tinyint").alias("_side"), F.struct(*[F.col(f) for f in fields]).alias("_r"))
    run = side(left, 0).unionByName(side(right, 1)).repartitionByRange("_k").sortWithinPartitions("_k", "_side")
    w = Window.partitionBy("_k").orderBy("_side")
    walked = run.select("_k", "_side", "_r", F.lead("_r").over(w).alias("_next"), F.lag("_side").over(w).alias("_before"))

    def shown(c: Column, f: str) -> Column:
        return digest_shown(c) if f in digests else c.cast("string")

    def issue(name: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(name).alias("issue"), a.alias("left_value"), b.alias("right_value"))

    nothing = F.lit(None).cast("string")
    unequal = [F.when(~F.col(f"_r.{f}").eqNullSafe(F.col(f"_next.{f}")), issue(f, shown(F.col(f"_r.{f}"), f), shown(F.col(f"_next.{f}"), f))) for f in fields]
    found = (
        F.when((F.col("_side") == 0) & F.col("_next").isNull(), F.array(issue(missing_right, nothing, nothing)))
        .when(F.col("_side") == 0, F.filter(F.array(*unequal), lambda x: x.isNotNull()))
        .when(F.col("_before").isNull(), F.array(issue(missing_left, nothing, nothing)))
    )
    return walked.select(F.col("_k").alias(key), F.inline(found))
