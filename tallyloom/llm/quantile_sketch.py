"""Percentiles of large numeric columns by dyadic Count-sketches.

A value is encoded as an integer that keeps its order: sign, binary exponent and the leading ``MANTISSA`` bits. Whole
numbers have codes of their own, fewer than those of doubles. For
each binary resolution of the codes there is one signed sketch; a coarse resolution with no more nodes than a sketch
row is wide keeps its counts exactly. Sketches are tables of counters, so they merge by addition, over partitions,
days or runs, and a row is deleted by adding it with weight -1. Ranks are inverted by descending the resolutions.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.versions import current_rows
from ..session import table

MANTISSA = 9  # leading bits after the first: values of one code differ by less than one part in 512
WHOLE_BITS, DOUBLE_BITS = 17, 22  # codes of a bigint and of a double are below 2 ** these
EXPONENTS = {WHOLE_BITS: (0, 63), DOUBLE_BITS: (-1022, 1024)}  # least exponent, and that above the greatest
WIDTH = 512
DEPTH = 5
SEED = 20_260_101


def _zero(bits: int) -> int:
    """The code of zero: all codes of negative numbers lie below."""
    least, above = EXPONENTS[bits]
    return 1 + (above - least << MANTISSA)


def encode(v: Column) -> Column:
    """The code of a bigint: increasing in the value; null for null."""
    a = F.abs(v)
    near = F.floor(F.log2(F.greatest(a, F.lit(1)).cast("double"))).cast("int")
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), e)
    e = F.when(near > 62, 62).when(bit(F.least(near, F.lit(62))) > a, near - 1).otherwise(near)
    lead = F.when(e >= MANTISSA, F.call_function("shiftright", a, e - MANTISSA)).otherwise(F.call_function("shiftleft", a, F.lit(MANTISSA) - e))
    u = F.when(a == 0, F.lit(0)).otherwise(1 + e.cast("bigint") * (1 << MANTISSA) + lead.bitwiseAND(F.lit((1 << MANTISSA) - 1)))
    zero = _zero(WHOLE_BITS)
    return F.when(v.isNotNull(), F.when(v >= 0, zero + u).otherwise(zero - u)).cast("bigint")


def encode_double(v: Column) -> Column:
    """The code of a double: increasing in the value; null for null and NaN. Numbers below 2 ** -1022 in size are zero,
    infinities are the greatest in size."""
    least, above = EXPONENTS[DOUBLE_BITS]
    a = F.abs(v)
    near = F.floor(F.log2(F.greatest(F.least(a, F.lit(1.7976931348623157e308)), F.lit(2.0**least)))).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(power(near) > a, near - 1).when((near < above - 1) & (power(near + 1) <= a), near + 1).otherwise(near)
    lead = F.floor((F.least(a, F.lit(1.7976931348623157e308)) / power(e) - 1) * (1 << MANTISSA))
    u = F.when(a < 2.0**least, F.lit(0).cast("bigint")).otherwise(1 + (e.cast("bigint") - least) * (1 << MANTISSA) + F.least(F.greatest(lead, F.lit(0)), F.lit((1 << MANTISSA) - 1)))
    zero = _zero(DOUBLE_BITS)
    return F.when(v.isNotNull() & ~F.isnan(v), F.when(v >= 0, zero + u).otherwise(zero - u)).cast("bigint")


def decode(code: int, bits: int = WHOLE_BITS) -> float:
    """The middle of the values of a code."""
    u = abs(code - _zero(bits)) - 1
    if u < 0:
        return 0.0
    e, m = (u >> MANTISSA) + EXPONENTS[bits][0], u & ((1 << MANTISSA) - 1)
    low, width = 2.0**e * (1 + m / (1 << MANTISSA)), 2.0**e / (1 << MANTISSA)
    if bits == WHOLE_BITS:
        width = max(width, 1.0) - 1
    return (low + width / 2) * (1 if code > _zero(bits) else -1)


def build_sketch(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, level, line, slot, amount): the dyadic Count-sketch of ``value`` per key, a whole number or, in a column of
    doubles, floats or decimals, a double.

    Rows are counted by key and code first, next to the scan; a key has at most 2**bits codes however many rows it
    has, so hot keys cost no more and only those counts fan out over resolutions and hash lines. Null values are left
    out; the smallest bigint must not occur; null keys form one key. With ``weight`` a row counts that often, and a
    negative weight deletes. Equal sketches come from any order or partitioning of the same rows.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    bits, code = (WHOLE_BITS, encode(F.col(value).cast("bigint"))) if whole else (DOUBLE_BITS, encode_double(F.col(value).cast("double")))
    coded = df.select(*keys, code.alias("_code"), w.alias("_w")).filter("_code IS NOT NULL")
    counted = coded.groupBy(*keys, "_code").agg(F.sum("_w").alias("_w")).filter("_w <> 0")
    exact_from = bits - (WIDTH.bit_length() - 1)
    cells = [F.struct(F.lit(level).alias("level"), F.lit(line).alias("line")) for level in range(bits + 1) for line in range(DEPTH if level < exact_from else 1)]
    fanned = counted.select(*keys, "_code", "_w", F.inline(F.array(*cells))).withColumn("_node", F.call_function("shiftright", F.col("_code"), F.col("level")))
    h = F.xxhash64(F.lit(SEED), F.col("level"), F.col("line"), F.col("_node"))
    hashed = F.col("level") < exact_from
    slot = F.when(hashed, h.bitwiseAND(F.lit(WIDTH - 1))).otherwise(F.col("_node")).cast("int")
    sign = F.when(hashed & (F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(1)) == 1), -1).otherwise(1)
    return fanned.groupBy(*keys, "level", "line", slot.alias("slot")).agg(F.sum(F.col("_w") * sign).alias("amount"))


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys (partitions, days, runs) added up to ``keys``."""
    return sketch.groupBy(*keys, "level", "line", "slot").agg(F.sum("amount").alias("amount"))


def _line_hashes(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of nodes in each line; the same hash as build_sketch's."""
    slots, signs = np.empty((DEPTH, len(nodes)), np.int64), np.empty((DEPTH, len(nodes)), np.int64)
    for line in range(DEPTH):
        for i, node in enumerate(nodes):
            h = _spark_xxhash64([(SEED, 4), (level, 4), (line, 4), (int(node), 8)])
            slots[line, i] = h & (WIDTH - 1)
            signs[line, i] = -1 if (h >> 40) & 1 else 1
    return slots, signs


def _spark_xxhash64(values: list[tuple[int, int]], seed: int = 42) -> int:
    """Spark's xxhash64 of integers given with their widths: each value's hash seeds the next."""
    import xxhash

    for v, width in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(width, "little", signed=True), seed)
    return seed


def quantiles(sketch: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """(keys, n, p50, ...): the values at the given ranks, one column per probability (p99_5 for 0.995), and the number of
    values.

    The cells of one key are bounded by the sketch's size, whatever the rows behind them, so each key is inverted in
    one small group. The error has two parts: less than 1/512 of the value by the encoding, and in rank about
    sqrt(sum of squared counts of a resolution / WIDTH) for each descended resolution. Keys whose rows were all
    deleted are left out.
    """
    names = [f"p{p * 100:.10g}".replace(".", "_") for p in probabilities]
    fields = [f for f in sketch.schema.fields if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n bigint"] + [f"{x} double" for x in names])

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        level, line, slot, amount = (pdf[c].to_numpy() for c in ("level", "line", "slot", "amount"))
        bits = int(level.max())
        exact_from = bits - (WIDTH.bit_length() - 1)
        n = int(amount[level == bits].sum())
        if n <= 0:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in fields} | {x: pd.Series(dtype=float) for x in ["n", *names]})
        exact = {at: dict(zip(slot[level == at], amount[level == at])) for at in range(exact_from, bits + 1)}
        signed = np.zeros((exact_from, DEPTH, WIDTH), np.int64)
        low = level < exact_from
        signed[level[low], line[low], slot[low]] = amount[low]

        def estimate(at: int, node: int) -> float:
            if at >= exact_from:
                return exact[at].get(node, 0)
            slots, signs = _line_hashes(at, np.array([node]))
            return float(np.median(signed[at, np.arange(DEPTH), slots[:, 0]] * signs[:, 0]))

        row = {f.name: pdf[f.name].iloc[0] for f in fields} | {"n": n}
        for p, name in zip(probabilities, names):
            rest, node, mass = p * n, 0, float(n)
            for at in range(bits - 1, -1, -1):
                left = min(max(estimate(at, 2 * node), 0.0), mass)
                right = min(max(estimate(at, 2 * node + 1), 0.0), mass)
                left = left * mass / (left + right) if left + right > 0 else mass / 2  # the two halves hold the parent's mass
                go_right = rest > left
                rest, mass, node = (rest - left, mass - left, 2 * node + 1) if go_right else (rest, left, 2 * node)
            row[name] = decode(node, bits)
        return pd.DataFrame([row])

    return sketch.groupBy(*keys).applyInPandas(invert, schema)


MEASURES = ["compression_ns", "decompression_ns", "compression_peak_rss_bytes"]


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(codec_id, day, measure, value) of current measured trials."""
    trials = table(spark, sf_dir, "trials")
    current = current_rows(trials, "trial_id", ["recorded_at"], ["codec_id", "roundtrip_ok", "repetition", *MEASURES, F.to_date("started_at").alias("day")])
    rows = current.filter("roundtrip_ok AND repetition > 0")
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    return rows.select("codec_id", "day", each).filter("value > 0")


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(build_sketch(measured(spark, sf_dir), ["codec_id", "measure"], "value"), ["codec_id", "measure"], [0.5, 0.9, 0.99])


def p7_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from one sketch per day, merged."""
    days = build_sketch(measured(spark, sf_dir), ["codec_id", "measure", "day"], "value")
    return quantiles(merge_sketches(days, ["codec_id", "measure"]), ["codec_id", "measure"], [0.5, 0.9, 0.99])


def p7_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact ranks of the sketch's percentiles are within 0.02 of those asked for, for values within 1/256."""
    rows = measured(spark, sf_dir).select("codec_id", "measure", "value")
    sketched = quantiles(build_sketch(rows, ["codec_id", "measure"], "value"), ["codec_id", "measure"], [0.5, 0.9, 0.99])
    met = rows.join(sketched, ["codec_id", "measure"])
    near = []
    for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        below, upto = (F.count_if(F.col("value") < F.col(name) * (1 - 1 / 256)), F.count_if(F.col("value") <= F.col(name) * (1 + 1 / 256)))
        near.append((below <= (p + 0.02) * F.count("*")) & (upto >= (p - 0.02) * F.count("*")))
    return met.groupBy("codec_id", "measure").agg(F.count("*").alias("n"), (near[0] & near[1] & near[2]).alias("within"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_percentiles(spark, sf_dir).filter("p90 >= 5 * p50").select("codec_id", "measure")


QUERIES = {"p7_found": p7_found, "p7_percentiles": p7_percentiles, "p7_merged_days": p7_merged_days, "p7_verified": p7_verified}
_SQL = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY recorded_at DESC) AS rn FROM trials) WHERE rn = 1 AND roundtrip_ok AND repetition > 0),
v AS (SELECT codec_id, unnest(['compression_ns', 'decompression_ns', 'compression_peak_rss_bytes']) AS measure, unnest([compression_ns, decompression_ns, compression_peak_rss_bytes]) AS value FROM c)
SELECT codec_id, measure{} FROM v WHERE value > 0 GROUP BY codec_id, measure{}"""
ORACLES = {
    "p7_found": _SQL.format("", " HAVING quantile_cont(value, 0.9) >= 5 * quantile_cont(value, 0.5)"),
    "p7_verified": _SQL.format(", count(*) AS n, true AS within", ""),
}
