"""Decision rules learned from one row per family: when is a token channel worth its attempt?

The rules are never, always, one predicate or two joined by AND; predicates compare a feature with the midpoint of two
consecutive distinct values. All of them are tried: the hits of every predicate are a row of a 0/1 matrix P, and the costs
of all pairs are one product P diag(w) P'. Families are few; whatever grows with the texts is summed up before.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import pack_dictionary, per_text

FEATURES = ("side_density", "dictionary_utilization", "mean_code", "entropy", "top1_share", "top4_share", "repeat_rate")
PENALTY = 0.0005
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,63}")
_MARKER, _ESCAPED = 0, 255


def token_channels(text: str) -> tuple:
    """(bytes with codes in place, bytes with codes apart, the features): both forms under zlib, of a text whose tokens
    of most gain are codes of one byte."""
    words = [t for t, _ in pack_dictionary(text, 1 << 62)[:254]]
    code = {t: i for i, t in enumerate(words)}
    inline, literals, side, at = bytearray(), bytearray(), bytearray(), 0

    def literal(part: str) -> None:
        for i, piece in enumerate(part.encode().split(b"\0")):
            if i:
                mark(_ESCAPED)
            inline.extend(piece)
            literals.extend(piece)

    def mark(c: int) -> None:
        inline.extend((_MARKER, c))
        literals.append(_MARKER)
        side.append(c)

    for m in _WORD.finditer(text):
        if m.group() in code:
            literal(text[at : m.start()])
            mark(code[m.group()])
            at = m.end()
    literal(text[at:])
    names = "\n".join(words).encode()
    sizes = 4 + len(zlib.compress(names + inline, 6)), 8 + len(zlib.compress(names + literals, 6)) + len(zlib.compress(bytes(side), 6))
    codes = [c for c in side if c != _ESCAPED]
    if not codes:
        return *sizes, *[0.0] * len(FEATURES)
    n, counts = len(codes), Counter(codes)
    top = sorted(counts.values(), reverse=True)
    entropy = abs(sum(c / n * log2(c / n) for c in top)) / log2(max(2, len(words)))
    repeats = sum(a == b for a, b in zip(codes, codes[1:]))
    return *sizes, len(side) / (len(names) + len(inline)), len(counts) / len(words), sum(codes) / n / max(1, len(words) - 1), entropy, top[0] / n, sum(top[:4]) / n, repeats / max(1, n - 1)


def family_rows(df: DataFrame, family: str, text: str) -> DataFrame:
    """(family, inline_bytes, channel_bytes, the means of the features): one row per family."""
    schema = "inline_bytes bigint, channel_bytes bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = per_text(df, family, text, schema, lambda t: [token_channels(t)])
    # rounded, so that the order of addition decides no threshold
    means = [F.round(F.avg(f), 9).alias(f) for f in FEATURES]
    return rows.groupBy(F.col(family).alias("family")).agg(F.sum("inline_bytes").alias("inline_bytes"), F.sum("channel_bytes").alias("channel_bytes"), *means)


def accepts(rule: list[tuple[int, str, float]] | None, features: list[float]) -> bool:
    return rule is not None and all(features[f] < t if op == "lt" else features[f] > t for f, op, t in rule)


def fit(rows: list[tuple[int, int, list[float]]]) -> tuple[float, list[tuple[int, str, float]] | None]:
    """(cost, rule) of the cheapest rule over (inline bytes, channel bytes, features); None is never, [] always. A missed
    win costs its savings, a needless attempt the bytes it adds, each predicate a share of all bytes. Among equals fewer
    predicates win, never before always, then the order of features, lt before gt, and thresholds."""
    weight = np.array([float(a - b) for a, b, _ in rows])  # of an attempt: savings, or the bytes added
    missed, fee = float(weight[weight > 0].sum()), PENALTY * sum(a for a, _, _ in rows)
    x = np.array([f for _, _, f in rows], dtype=float).reshape(len(rows), len(FEATURES))
    predicates, hits = [], []
    for f in range(len(FEATURES)):
        v = np.unique(x[:, f])
        mid = (v[:-1] + v[1:]) / 2
        for op in ("lt", "gt"):
            predicates += [(f, op, float(t)) for t in mid]
            hits += [x[:, f] < t if op == "lt" else x[:, f] > t for t in mid]
    found = [(missed, None), (missed - float(weight.sum()), [])]
    if predicates:
        p = np.array(hits, dtype=float)
        one = missed - p @ weight + fee
        found.append((float(one.min()), [predicates[int(one.argmin())]]))
        of = np.array([q[0] for q in predicates])
        two = np.where(of[:, None] < of[None, :], missed - (p * weight) @ p.T + 2 * fee, np.inf)
        i, j = divmod(int(two.argmin()), len(predicates))
        if np.isfinite(two[i, j]):
            found.append((float(two[i, j]), [predicates[i], predicates[j]]))
    return min(found, key=lambda c: c[0])


RULES = "holdout string, wins boolean, decision boolean, mode string, feature1 string, op1 string, threshold1 double, feature2 string, op2 string, threshold2 double, cost double"


def learned_rules(families: DataFrame) -> DataFrame:
    """The rule fitted to all families (holdout null) and, for each family, the one fitted to all others with its
    decision on the family. One fold per row, side by side; a fold holds the rows of all families."""
    row = F.struct("family", "inline_bytes", "channel_bytes", F.array(*FEATURES).alias("features"))
    all_rows = families.agg(F.sort_array(F.collect_list(row)).alias("rows")).filter(F.size("rows") > 0)
    folds = all_rows.select("rows", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.size("rows") - 1))).alias("fold")).repartition("fold")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows, fold in zip(*(c.to_pylist() for c in b.columns)):
                plain = [(r["inline_bytes"], r["channel_bytes"], r["features"]) for r in rows]
                cost, rule = fit([r for i, r in enumerate(plain) if i != fold])
                held = plain[fold] if fold >= 0 else None
                parts = [(FEATURES[f], op, t) for f, op, t in rule or []] + [(None, None, None)] * 2
                mode = "never" if rule is None else "and" if rule else "always"
                out.append((rows[fold]["family"] if held else None, held[1] < held[0] if held else None, accepts(rule, held[2]) if held else None, mode, *parts[0], *parts[1], round(cost, 6)))
            types = [pa.string(), pa.bool_(), pa.bool_(), pa.string(), *[pa.string(), pa.string(), pa.float64()] * 2, pa.float64()]
            names = [c.split()[0] for c in RULES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return folds.mapInArrow(learn, RULES)
