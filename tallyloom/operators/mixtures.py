"""Mixtures of byte models with contexts of several kinds: losses, credits and leave-one-out arms of texts.

Each expert counts what followed its context in the text so far, with a prior of a half. What it counted before a byte is
the byte's place among the equal (context, byte) pairs, so all counts of many texts come from sorts of whole arrays; only
the weights run in order, and they do so for all texts of a batch at once, byte by byte. A text takes about 200 bytes of
memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ORDERS = (0, 1, 2, 3, 4, 6, 8)
EXPERTS = (*(f"order-{o}" for o in ORDERS), "sparse", "word")
AT_ONCE = 1 << 19  # bytes of the texts that are counted together
SHARE = 0.02  # of the weight that is dealt equally after each byte
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def _earlier(keys: np.ndarray) -> np.ndarray:
    """How many equal keys come before each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.arange(len(keys)) - np.repeat(fresh, np.diff(np.append(fresh, len(keys))))
    out = np.empty(len(keys), np.int64)
    out[order] = rank
    return out


def contexts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The contexts of all bytes of the texts, one array per expert; those of different texts differ."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.zeros(len(data), np.uint64)  # the eight bytes before, the nearest lowest
    for j in range(1, 9):
        near = np.zeros(len(data), np.uint64)
        near[j:] = data[:-j] if j < len(data) else 0
        last |= np.where(place >= j, near, 0).astype(np.uint64) << np.uint64(8 * (j - 1))
    own = _scramble(text.astype(np.uint64) + np.uint64(1))
    for n, order in enumerate(ORDERS):
        seen = last & np.uint64((1 << 8 * order) - 1)
        yield _scramble(seen + np.uint64(n)) ^ own
    yield _scramble((last & np.uint64(0xFFFF00)) + np.uint64(100)) ^ own
    # The word so far: a sum of its letters times powers of an odd number, shifted to where the word starts.
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128) | (data == 95)
    power = np.cumprod(np.full(len(data), 0x2545F4914F6CDD1D | 1, np.uint64))
    inverse = np.cumprod(np.full(len(data), pow(0x2545F4914F6CDD1D | 1, -1, 1 << 64), np.uint64))
    upto = np.concatenate(([np.uint64(0)], np.cumsum((data + np.uint64(1)) * inverse, dtype=np.uint64)))
    at = np.arange(len(data))
    start = np.maximum.accumulate(np.where(~letter, at + 1, 0)) if len(data) else at
    before = np.concatenate(([0], start[:-1]))[: len(data)]
    begin = np.maximum(np.minimum(before, at), at - place)  # words don't reach into the text before
    yield _scramble((upto[at] - upto[begin]) * power + (at - begin).astype(np.uint64) + np.uint64(200)) ^ own


def probabilities(texts: list[bytes]) -> np.ndarray:
    """(expert, byte): what each expert gave each byte that came."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    rows = [(_earlier(_scramble(c + data)) + 0.5) / (_earlier(c) + 128) for c in contexts(texts)]
    return np.array(rows).reshape(len(EXPERTS), len(data))


def mix(p: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bits of every byte, share of each expert in it) with weights that follow the experts' success in each text."""
    k, n = p.shape
    start = np.cumsum(sizes) - sizes
    by_size = np.argsort(-np.array(sizes), kind="stable")
    first, longest = start[by_size], np.array(sizes)[by_size]
    weights = np.full((k, len(sizes)), 1 / k)
    total, shares = np.empty(n), np.empty((k, n))
    for t in range(int(longest[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-longest, -t))  # texts longer than t
        at = first[:live] + t
        w = weights[:, :live] * p[:, at]
        s = w.sum(axis=0)
        w /= s
        total[at], shares[:, at] = s, w
        weights[:, :live] = (1 - SHARE) * w + SHARE / k
    return -np.log2(total), shares


def fixed_mix(p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bits of every byte under weights that stay."""
    return -np.log2(weights @ p)


KINDS = ("full", "refined", "frozen", "without", "credit")


def arms(texts: list[bytes], kinds: tuple[str, ...] = KINDS, weights: np.ndarray | None = None) -> list[list[tuple[str, float]]]:
    """Of each text (arm, bits) of the given kinds: the whole mixture; a second stage that mixes it with the fixed one in
    the same way; the fixed weights (equal if not given); each expert left out; and of each expert its credit, the bits
    that its share of the probabilities stands for. Credits add up to the whole mixture."""
    sizes = [len(t) for t in texts]
    ends = np.cumsum([0, *sizes])
    p = probabilities(texts)
    found = {}
    if {"full", "refined", "credit"} & set(kinds):
        found["full"], shares = mix(p, sizes)
    if {"frozen", "refined"} & set(kinds):
        found["frozen"] = fixed_mix(p, np.full(len(EXPERTS), 1 / len(EXPERTS)) if weights is None else weights)
    if "refined" in kinds:
        found["refined"] = mix(np.exp2(-np.array([found["full"], found["frozen"]])), sizes)[0]
    for i, name in enumerate(EXPERTS):
        if "without" in kinds:
            found[f"without-{name}"] = mix(np.delete(p, i, axis=0), sizes)[0]
        if "credit" in kinds:
            found[f"credit-{name}"] = found["full"] * shares[i]
    sums = {name: np.concatenate(([0.0], np.cumsum(v))) for name, v in found.items() if name.partition("-")[0] in kinds}
    return [[(name, float(v[b] - v[a])) for name, v in sums.items()] for a, b in zip(ends, ends[1:])]


def per_texts(df: DataFrame, key: str, text: str, schema: str, rows_of: Callable[[list[bytes]], list[list[tuple]]]) -> DataFrame:
    """``key`` and the rows that ``rows_of`` gives for each of a list of texts; null and empty texts have none. The texts
    are dealt to all tasks by key and taken AT_ONCE bytes at a time."""
    kept = df.filter(F.octet_length(text) > 0).select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kept = kept.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    full = T.StructType([T.StructField(key, kept.schema["_key"].dataType), *T._parse_datatype_string(schema).fields])
    types = [to_arrow_type(f.dataType) for f in full.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            done = 0
            while done < len(texts):
                size, stop = 0, done
                while stop < len(texts) and (stop == done or size + len(texts[stop]) <= AT_ONCE):
                    size, stop = size + len(texts[stop]), stop + 1
                found = rows_of(texts[done:stop])
                keys = np.repeat(np.arange(done, stop), [len(rows) for rows in found])
                flat = [row for rows in found for row in rows]
                columns = [pa.array([row[i] for row in flat], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), *columns], full.names)
                done = stop

    return kept.mapInArrow(run, full)


def arm_rows(df: DataFrame, key: str, text: str, kinds: tuple[str, ...] = KINDS, weights: list[float] | None = None) -> DataFrame:
    """(key, arm, bits) of every text."""
    fixed = None if weights is None else np.array(weights)
    return per_texts(df, key, text, "arm string, bits double", lambda texts: arms(texts, kinds, fixed))


def quarter_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, quarter, n_bytes, bits): the loss of each quarter of a text, as the experts and weights come to know it."""

    def rows(texts: list[bytes]) -> list[list[tuple[int, int, float]]]:
        sizes = [len(t) for t in texts]
        bits = np.concatenate(([0.0], np.cumsum(mix(probabilities(texts), sizes)[0])))
        out = []
        for n, start in zip(sizes, np.cumsum(sizes) - sizes):
            cuts = [start + n * k // 4 for k in range(5)]
            out.append([(k, int(b - a), float(bits[b] - bits[a])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1)])
        return out

    return per_texts(df, key, text, "quarter int, n_bytes bigint, bits double", rows)


def trained_weights(df: DataFrame, key: str, text: str) -> list[float]:
    """The mean share of each expert over all bytes of all texts: as many numbers as experts come to the driver."""

    def rows(texts: list[bytes]) -> list[list[tuple[int, float, int]]]:
        _, shares = mix(probabilities(texts), [len(t) for t in texts])
        whole = [(i, float(s), shares.shape[1]) for i, s in enumerate(shares.sum(axis=1))]
        return [whole, *[[]] * (len(texts) - 1)]

    sums = per_texts(df, key, text, "expert int, share double, n bigint", rows).groupBy("expert").agg((F.sum("share") / F.sum("n")).alias("w")).collect()
    found = {r["expert"]: r["w"] for r in sums}
    return [found.get(i, 1 / len(EXPERTS)) for i in range(len(EXPERTS))]


def class_losses(df: DataFrame, key: str, text: str, class_runs: Callable) -> DataFrame:
    """(key, class, n_bytes, bits): mixture loss by class of the byte; the classes add up to the whole."""

    def rows(texts: list[bytes]) -> list[list[tuple[str, int, float]]]:
        sizes = [len(t) for t in texts]
        bits = np.concatenate(([0.0], np.cumsum(mix(probabilities(texts), sizes)[0])))
        out = []
        for t, start in zip(texts, np.cumsum(sizes) - sizes):
            total: dict[str, tuple[int, float]] = {}
            for kind, i, j in class_runs(t):
                n, sum_bits = total.get(kind, (0, 0.0))
                total[kind] = (n + j - i, sum_bits + float(bits[start + j] - bits[start + i]))
            out.append([(kind, n, b) for kind, (n, b) in total.items()])
        return out

    return per_texts(df, key, text, "class string, n_bytes bigint, bits double", rows)
