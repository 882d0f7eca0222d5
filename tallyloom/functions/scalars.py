"""Scalar column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slug(c: Column) -> Column:
    """Runs of characters outside a-z, A-Z, 0-9, '.', '_' and '-' become one '-'; outer '-' go; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""))


def extension(path: Column) -> Column:
    """The extension of the last path part with its dot in lower case; empty for none, for a name that only starts with
    a dot and for one that ends in it."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+([.][^./]+)$", 1))


def namespace(title: Column) -> Column:
    """What stands before the first ':' if it has 1 to 64 characters, in lower case; else empty."""
    return F.lower(F.regexp_extract(title, "^([^:]{1,64}):", 1))


def size_bytes(text: Column) -> Column:
    """Bytes of a size such as '16MiB' or '4096'; null for 'unlimited' and for anything else."""
    n = F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMGkmg]?)i?[Bb]?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMGkmg]?)i?[Bb]?\s*$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return n.try_cast("bigint") * factor


def repeat_to(text: Column, n: int) -> Column:
    """The text repeated and cut to exactly ``n`` characters; empty stays empty."""
    times = F.ceil(F.lit(n) / F.greatest(F.length(text), F.lit(1))).cast("int")
    return F.substring(F.call_function("repeat", text, times), 1, n)


def floor_div(a: Column, b: Column) -> Column:
    """Integer division towards minus infinity."""
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a, b)


def bit_length(n: Column) -> Column:
    """Bits of a non-negative integer; 0 has none."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def varint_size(n: Column) -> Column:
    """Bytes of a non-negative integer at 7 bits a byte."""
    return F.greatest(F.lit(1), F.ceil(bit_length(n) / 7).cast("int"))


def zigzag(n: Column) -> Column:
    """Small magnitudes of either sign as small non-negative integers."""
    return F.call_function("shiftleft", n, F.lit(1)).bitwiseXOR(F.call_function("shiftright", n, F.lit(63)))


def unzigzag(n: Column) -> Column:
    return F.call_function("shiftrightunsigned", n, F.lit(1)).bitwiseXOR(-n.bitwiseAND(F.lit(1)))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters of the longest common prefix; 0 where either is null. Meant for short texts such as paths."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.coalesce(F.size(same), F.lit(0))


def mix64(values: np.ndarray) -> np.ndarray:
    """A published 64-bit finalizer over unsigned integers, wrapping around."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@F.pandas_udf(T.LongType())
def splitmix64(index: pd.Series) -> pd.Series:
    """The SplitMix64 value at each index of the stream that starts at 0, as a signed integer."""
    with np.errstate(over="ignore"):
        state = (index.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return pd.Series(mix64(state).astype(np.int64))


@F.pandas_udf(T.LongType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a of binary values, as a signed integer; null stays null."""

    def one(b) -> int | None:
        if b is None:
            return None
        h = 0xCBF29CE484222325
        for x in bytes(b):
            h = ((h ^ x) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >= 1 << 63 else h

    return data.map(one).astype("Int64")


@F.pandas_udf(T.StringType())
def blake2b64(data: pd.Series) -> pd.Series:
    """64-bit BLAKE2b of binary values in hexadecimal."""
    import hashlib

    return data.map(lambda b: None if b is None else hashlib.blake2b(bytes(b), digest_size=8).hexdigest())
