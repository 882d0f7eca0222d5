"""Record streams: exact JSON field spans, references to earlier records, move-to-front, byte classes, codec sizes.

Every operator here that needs ordered state keeps it inside one row's value (a text, an array) and runs next to the
scan in Arrow batches; nothing is shuffled and no group is gathered.
"""

from __future__ import annotations

import bz2
import functools
import gzip
import heapq
import json
import lzma
import math
import re
import struct
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()
_SPACE = " \t\r\n"


def _skip(s: str, i: int) -> int:
    while i < len(s) and s[i] in _SPACE:
        i += 1
    return i


def top_level_fields(record: str) -> list[tuple[str, int, int]] | None:
    """(key, start, end) of the raw value of every top-level field in order, duplicates included; None if the record is
    no JSON object or has anything but white space after it."""
    i = _skip(record, 0)
    if record[i : i + 1] != "{":
        return None
    i, out = _skip(record, i + 1), []
    if record[i : i + 1] == "}":
        return out if _skip(record, i + 1) == len(record) else None
    try:
        while True:
            if record[i : i + 1] != '"':
                return None
            key, i = scanstring(record, i + 1, True)
            i = _skip(record, i)
            if record[i : i + 1] != ":":
                return None
            start = _skip(record, i + 1)
            _, end = _DECODER.raw_decode(record, start)
            if record[start:end].lstrip("-")[:1] in ("N", "I"):  # not JSON, but taken by the decoder
                return None
            out.append((key, start, end))
            i = _skip(record, end)
            if record[i : i + 1] == "}":
                return out if _skip(record, i + 1) == len(record) else None
            if record[i : i + 1] != ",":
                return None
            i = _skip(record, i + 1)
    except (ValueError, RecursionError):
        return None


def per_text(df: DataFrame, key: str, text: str, schema: str, rows_of: Callable[[str], Iterator[tuple]], spread: bool = False) -> DataFrame:
    """``key`` and the rows that ``rows_of`` makes of each non-null text, in Arrow batches next to the scan.

    With ``spread`` the texts are first dealt to all tasks by key: for work of many CPU seconds a megabyte, which would
    otherwise run in as few tasks as the table has splits."""
    kept = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    if spread:
        kept = kept.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    empty = df.sparkSession.createDataFrame([], schema).schema
    out = kept.schema["_key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql import types as T

    full = T.StructType([T.StructField(key, out), *empty.fields])
    types = [to_arrow_type(f.dataType) for f in full.fields]
    names = full.names

    def run(batches):
        for b in batches:
            columns = [[] for _ in names]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                for row in rows_of(t):
                    columns[0].append(k)
                    for c, v in zip(columns[1:], row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return kept.mapInArrow(run, full)


def lines_of(text: str) -> list[str]:
    parts = text.split("\n")
    return parts[:-1] if parts and parts[-1] == "" else parts


def shred_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rec_no, field, occurrence, raw_value): raw top-level values of the text's lines. A line that is no JSON
    object gives one row with a null field and itself as the value, so the text can be put together again."""

    def rows(t: str):
        for no, line in enumerate(lines_of(t), 1):
            fields = top_level_fields(line)
            if fields is None:
                yield no, None, 0, line
                continue
            seen: dict[str, int] = {}
            for k, a, b in fields:
                seen[k] = seen.get(k, 0) + 1
                yield no, k, seen[k], line[a:b]

    return per_text(df, key, text, "rec_no int, field string, occurrence int, raw_value string", rows)


def skeleton(record: str) -> str | None:
    """The record with every top-level value replaced by a zero character; None where ``top_level_fields`` has none."""
    fields = top_level_fields(record)
    if fields is None:
        return None
    out, at = [], 0
    for _, a, b in fields:
        out += [record[at:a], "\x00"]
        at = b
    return "".join(out) + record[at:]


def json_skeletons(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rec_no, skeleton, n_values)."""

    def rows(t: str):
        for no, line in enumerate(lines_of(t), 1):
            s = skeleton(line)
            yield no, s, 0 if s is None else s.count("\x00")

    return per_text(df, key, text, "rec_no int, skeleton string, n_values int", rows)


def json_channels(text: str) -> tuple[list[str], list[dict], bool]:
    """(skeletons, fields, ended): a text of JSON lines as the skeletons of its lines, and of each field, by its name, the
    raw values in order. A line that is no object is a skeleton with two zero characters before it; lines that hold zero
    characters themselves are taken as such."""
    skeletons, values = [], {}
    ended = text.endswith("\n")
    for line in (text[:-1] if ended else text).split("\n"):
        fields = None if "\x00" in line else top_level_fields(line)
        skeletons.append("\x00\x00" + line if fields is None else skeleton(line))
        for name, a, b in fields or []:
            values.setdefault(name, []).append(line[a:b])
    return skeletons, [{"field": k, "values": v} for k, v in values.items()], ended


def text_of_channels(skeletons: list[str], fields: list[dict], ended: bool) -> str:
    """The inverse of ``json_channels``: each value stands behind its field's name, so the skeleton says whose it is."""
    at = {f["field"]: iter(f["values"]) for f in fields}
    lines = []
    for s in skeletons:
        if s.startswith("\x00\x00"):
            lines.append(s[2:])
            continue
        out, here = [], 0
        while (hole := s.find("\x00", here)) >= 0:
            start = _key_before(s, hole)
            name, _ = scanstring(s, start + 1, True)
            out += [s[here:hole], next(at[name])]
            here = hole + 1
        lines.append("".join(out) + s[here:])
    return "\n".join(lines) + ("\n" if ended else "")


def _key_before(s: str, hole: int) -> int:
    """Where the string of the key starts whose value is the hole."""
    end = s.rindex(":", 0, hole)
    while s[end] != '"':
        end -= 1
    start = end - 1
    while s[start] != '"' or (len(s[:start]) - len(s[:start].rstrip("\\"))) % 2:
        start -= 1
    return start


def rebuilt_json(channels: DataFrame, key: str) -> DataFrame:
    """(key, text) of the rows of ``json_channels``."""
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of_channels(*x) for x in rows], pa.string())], [key, "text"])

    return channels.mapInArrow(run, T.StructType([channels.schema[key], T.StructField("text", T.StringType())]))


def varint_size(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


_ZERO_COMMANDS = re.compile(rb"\0{2,128}")  # of a longer run, one zero may be left over to the next literal


def residual_size(residual: bytes) -> int:
    """Bytes of a residual in commands of at most 128 bytes: one for a run of two zeros or more, one and itself for
    anything else."""
    literals = _ZERO_COMMANDS.split(residual)
    return len(literals) - 1 + sum(len(x) + -(-len(x) // 128) for x in literals)


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def length_references(df: DataFrame, key: str, text: str, window: int = 8) -> DataFrame:
    """(key, rec_no, referenced, n_bytes, residual_bytes): each line against the last ``window`` lines of its byte
    length, the best by the size of their XOR; raw where that with its mode is no smaller."""

    def rows(t: str):
        last: dict[int, list[bytes]] = {}
        for no, line in enumerate(lines_of(t), 1):
            data = line.encode()
            known = last.setdefault(len(data), [])
            best = min((residual_size(_xor(data, k)) for k in known), default=None)
            referenced = best is not None and best + 1 < len(data)
            yield no, referenced, len(data), best if referenced else 0
            known.insert(0, data)
            del known[window:]

    return per_text(df, key, text, "rec_no int, referenced boolean, n_bytes int, residual_bytes int", rows)


SLOTS, LARGEST = 1024, 32 * 1024


def slot_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """As ``length_references``, against the one line last kept in the slot of its length modulo SLOTS; a line of
    another length in the slot is no reference but takes its place, and lines above LARGEST neither look nor stay."""

    def rows(t: str):
        slots: dict[int, bytes] = {}
        for no, line in enumerate(lines_of(t), 1):
            data = line.encode()
            kept = slots.get(len(data) % SLOTS) if len(data) <= LARGEST else None
            size = residual_size(_xor(data, kept)) if kept is not None and len(kept) == len(data) else 0
            referenced = 0 < size < len(data)
            yield no, referenced, len(data), size if referenced else 0
            if len(data) <= LARGEST:
                slots[len(data) % SLOTS] = data

    return per_text(df, key, text, "rec_no int, referenced boolean, n_bytes int, residual_bytes int", rows)


def shared_edges(a: bytes, b: bytes) -> tuple[int, int]:
    """Bytes of the common prefix and, behind it, of the common suffix."""
    n = min(len(a), len(b))
    prefix = next((i for i in range(n) if a[i] != b[i]), n)
    return prefix, next((i for i in range(n - prefix) if a[-1 - i] != b[-1 - i]), n - prefix)


def splice_residuals(df: DataFrame, key: str, text: str, largest: int = 1 << 20) -> DataFrame:
    """(key, rec_no, prefix, suffix, spliced, n_bytes): what each line, with its end of any kind, shares with the one
    before it; spliced where the middle with its three counts is smaller than the line with its one."""

    def rows(t: str):
        before = None
        for no, data in enumerate(t.encode().splitlines(keepends=True), 1):
            size, p, s, spliced = 1 + varint_size(len(data)) + len(data), 0, 0, False
            if before is not None and max(len(before), len(data)) <= largest:
                p, s = shared_edges(before, data)
                middle = len(data) - p - s
                other = 1 + varint_size(p) + varint_size(s) + varint_size(middle) + middle
                spliced, size = other < size, min(other, size)
            yield no, p, s, spliced, size
            before = data

    return per_text(df, key, text, "rec_no int, prefix int, suffix int, spliced boolean, n_bytes int", rows)


def move_to_front(codes: bytes) -> np.ndarray:
    """The rank of each byte by how recently it was used; unused ones are in their own order behind those used.

    A byte used before has as many others before it as were used since; all places are counted at once, value by value."""
    data = np.frombuffer(codes, np.uint8)
    known, first = np.unique(data, return_index=True)
    place = np.arange(len(data))
    before = np.empty(len(data), np.int64)  # where the same byte was last, or -1
    last: dict[int, np.ndarray] = {}
    for v in known.tolist():
        upto = np.maximum.accumulate(np.where(data == v, place, -1))
        last[v] = np.concatenate(([-1], upto[:-1]))
        here = data == v
        before[here] = last[v][here]
    ranks = np.zeros(len(data), np.int64)
    for upto in last.values():
        ranks += upto > before
    for v, at in zip(known.tolist(), first.tolist()):  # first uses: behind all used ones, and the unused that are less
        ranks[at] += int(((first >= at) & (known < v)).sum())
    return ranks


def mtf_ranks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, rank_sum, zeros): move-to-front of the text's bytes."""

    def rows(t: str):
        ranks = move_to_front(t.encode())
        yield len(ranks), int(ranks.sum()), int((ranks == 0).sum())

    return per_text(df, key, text, "n int, rank_sum bigint, zeros int", rows, spread=True)


GRAM, REACH = 8, 1 << 16


def repeats(data: bytes) -> tuple[int, int, int | None]:
    """(positions, seeds, covered) of the grams of GRAM bytes: how many there are, how many occurred up to REACH bytes
    before, and how many bytes these cover; None without any."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return 0, 0, None
    grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), GRAM).copy().view(np.uint64).ravel()
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero((grams[order][1:] == grams[order][:-1]) & (np.diff(order) <= REACH)) + 1
    seeds = np.sort(order[again])
    return n, len(seeds), int(np.minimum(np.diff(seeds), GRAM).sum()) + GRAM if len(seeds) else None


def repeat_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, positions, seeds, covered) of every text that has a gram."""
    return per_text(df, key, text, "positions bigint, seeds bigint, covered bigint", lambda t: [x for x in [repeats(t.encode())] if x[0]], spread=True)


CLASSES = ("structural", "field_name", "string_value", "number_value", "literal_value", "whitespace", "unclassified")


def class_runs(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(class, start, end) of the JSON classes of all bytes in order. A string is a field name if the next sign after it
    is a colon. Outside strings the state starts anew at every line feed; inside an open string a line feed belongs to
    the string."""
    i = 0
    while i < len(data):
        c, j = data[i : i + 1], i + 1
        if c == b'"':
            while j < len(data) and data[j : j + 1] != b'"':
                j += 2 if data[j : j + 1] == b"\\" else 1
            j = min(j + 1, len(data))
            k = j
            while k < len(data) and data[k : k + 1] in (b" ", b"\t"):
                k += 1
            kind = "field_name" if data[k : k + 1] == b":" else "string_value"
        elif c in (b"{", b"}", b"[", b"]", b":", b","):
            kind = "structural"
        elif c in (b" ", b"\t", b"\r", b"\n"):
            kind = "whitespace"
        elif c in b"0123456789+-.eE" and (c not in b"eE+." or (i and data[i - 1 : i] in b"0123456789.eE")):
            kind = "number_value"
        else:
            kind = "literal_value" if c.isalpha() and c.isascii() else "unclassified"
        yield kind, i, j
        i = j


def byte_classes(text: str) -> dict[str, int]:
    """Bytes of each JSON class."""
    counts = dict.fromkeys(CLASSES, 0)
    for kind, i, j in class_runs(text.encode()):
        counts[kind] += j - i
    return counts


def pack_dictionary(text: str, cap: int) -> list[tuple[str, int]]:
    """(token, gain) taken greedily by gain while their bytes fit the cap; a token that doesn't fit is passed over."""
    from collections import Counter

    counts = Counter(re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,63}", text))
    gains = {t: n * (len(t) - 2) - len(t) - 1 for t, n in counts.items() if n >= 2}
    out, used = [], 0
    for t in sorted(gains, key=lambda t: (-gains[t], -counts[t], t)):
        if gains[t] > 0 and used + len(t) + 1 <= cap:
            out.append((t, gains[t]))
            used += len(t) + 1
    return out


def byte_class_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class, n_bytes) for each class that occurs."""
    return per_text(df, key, text, "class string, n_bytes bigint", lambda t: [(k, n) for k, n in byte_classes(t).items() if n], spread=True)


LZMA_WINDOWS = {0: 1 << 18, 6: 1 << 23, 9: 1 << 26}  # fixed values: the window of each preset


def _lzma(data: bytes, preset: int) -> int:
    """Bytes at a preset. The window is no larger than the data, which changes no size but saves clearing a large one."""
    window = min(LZMA_WINDOWS[preset], max(4096, 1 << max(0, len(data) - 1).bit_length()))
    return len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": window}]))


def codec_sizes(data: bytes) -> dict[str, int]:
    """Complete bytes by each codec."""
    out = {"store": len(data)}
    out |= {f"gzip-{level}": len(gzip.compress(data, level, mtime=0)) for level in (1, 6, 9)}
    out |= {f"bz2-{level}": len(bz2.compress(data, level)) for level in (1, 9)}
    out |= {f"lzma-{preset}": _lzma(data, preset) for preset in LZMA_WINDOWS}
    out |= {f"zstd-{level}": _zstd(data, level) for level in (1, 3, 9, 19)}
    out |= {f"brotli-{level}": len(pa.Codec("brotli", compression_level=level).compress(data, asbytes=True)) for level in (1, 9)}
    return out | {"lz4-1": len(pa.Codec("lz4").compress(data, asbytes=True))}


def text_codec_sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, codec, n_bytes) of each text by each codec."""
    return per_text(df, key, text, "codec string, n_bytes bigint", lambda t: codec_sizes(t.encode()).items(), spread=True)


def incompressible(data: bytes, ratio: float = 0.97) -> bool:
    """Whether a first, middle and last sample of 4 KiB each hardly compress."""
    third = 4096
    sample = data if len(data) <= 3 * third else data[:third] + data[len(data) // 2 - third // 2 : len(data) // 2 + third // 2] + data[-third:]
    return len(sample) > 0 and len(gzip.compress(sample, 1, mtime=0)) >= ratio * len(sample)


def gorilla_bits(values: list[float]) -> int:
    """Bits of a series of doubles by XOR with the value before, reusing the last window of leading and trailing zeros."""
    bits, before, window = 0, 0, None
    for i, v in enumerate(values):
        word = struct.unpack(">Q", struct.pack(">d", v))[0]
        if i == 0:
            bits += 64
        else:
            x = word ^ before
            if x == 0:
                bits += 1
            else:
                lead, trail = min(64 - x.bit_length(), 31), (x & -x).bit_length() - 1
                if window and lead >= window[0] and trail >= window[1]:
                    bits += 2 + 64 - window[0] - window[1]
                else:
                    window = (lead, trail)
                    bits += 2 + 5 + 6 + 64 - lead - trail
        before = word
    return bits


def block_mode(values: list[float]) -> tuple[str, int]:
    """(mode, bytes) of a block of doubles: the smallest of store, xor, byte planes under zlib and exact decimals."""
    import zlib

    raw = struct.pack(f"<{len(values)}d", *values)
    sizes = {"store": len(raw), "xor": (gorilla_bits(values) + 7) // 8, "planes": len(zlib.compress(b"".join(raw[i::8] for i in range(8)), 6))}
    for digits in range(0, 10):
        scaled = [round(v * 10**digits) if v == v and abs(v) < 1e15 else None for v in values]
        if all(s is not None and struct.pack("<d", s / 10**digits) == struct.pack("<d", v) for s, v in zip(scaled, values)):
            deltas = [b - a for a, b in zip([0, *scaled], scaled)]
            sizes["decimal"] = 1 + sum(max(1, -(-(max(2 * d, -2 * d - 1)).bit_length() // 7)) for d in deltas)
            break
    best = min(sizes, key=lambda k: (sizes[k], k))
    return best, sizes[best]


RULE_BUDGET = 32768


def repair_grammar(symbols: list[int], rules: int = RULE_BUDGET) -> tuple[int, int]:
    """(rules made, symbols left): replace the most frequent adjacent pair (least pair among equals), left to right
    without overlaps, until none occurs twice or the rules are used up.

    Pairs are counted once and kept up to date over a linked list. The heap holds at least one entry of each pair with
    no less than its count; an entry that is too high is put back with the count of now.
    """
    n, made, fresh = len(symbols), 0, max(symbols, default=0) + 1
    width = (fresh + rules).bit_length()
    both, low = 2 * width, (1 << width) - 1
    pairs = (1 << both) - 1
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[int, list[int]] = {}
    for i in range(n - 1):
        places.setdefault(sym[i] << width | sym[i + 1], []).append(i)
    counts = {p: len(at) for p, at in places.items()}
    heap = [p - (c << both) for p, c in counts.items() if c > 1]
    heapq.heapify(heap)
    left = n
    while heap and made < rules:
        top = heapq.heappop(heap)
        pair = top & pairs
        count = counts[pair]
        if count != -(top >> both):
            if count > 1:
                heapq.heappush(heap, pair - (count << both))
            continue
        a, b, grown = pair >> width, pair & low, set()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            h, k = before[i], after[j]
            counts[pair] -= 1
            if h >= 0:
                counts[sym[h] << width | a] -= 1
                new = sym[h] << width | fresh
                counts[new] = counts.get(new, 0) + 1
                places.setdefault(new, []).append(h)
                grown.add(new)
            if k < n:
                counts[b << width | sym[k]] -= 1
                new = fresh << width | sym[k]
                counts[new] = counts.get(new, 0) + 1
                places.setdefault(new, []).append(i)
                grown.add(new)
                before[k] = i
            sym[i], sym[j], after[i] = fresh, -1, k
            left -= 1
        for p in grown:
            if counts[p] > 1:
                heapq.heappush(heap, p - (counts[p] << both))
        fresh, made = fresh + 1, made + 1
    return made, left


def wiki_templates(text: str) -> list[tuple[int, int, int, str, str, int, str]]:
    """(node, parent, depth, template, parameter, ordinal, value) of all template parameters, outer templates first."""
    out: list[tuple] = []
    stack: list[list] = []  # [node, parent, depth, parts, part start, link depth]
    nodes, i = 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "{{":
            stack.append([nodes, stack[-1][0] if stack else -1, len(stack), [], i + 2, 0])
            nodes, i = nodes + 1, i + 2
        elif two == "}}" and stack:
            node, parent, depth, parts, start, _ = stack.pop()
            parts.append(text[start:i])
            name = parts[0].strip()
            for n, part in enumerate(parts[1:], 1):
                key, eq, value = part.partition("=")
                named = eq and "{{" not in key and "[[" not in key
                out.append((node, parent, depth, name, key.strip() if named else str(n), n, value if named else part))
            if len(parts) == 1:
                out.append((node, parent, depth, name, "", 0, ""))
            i += 2
        elif stack and two in ("[[", "]]"):
            stack[-1][5] = max(0, stack[-1][5] + (1 if two == "[[" else -1))
            i += 2
        elif stack and text[i] == "|" and stack[-1][5] == 0:
            stack[-1][3].append(text[stack[-1][4] : i])
            stack[-1][4] = i + 1
            i += 1
        else:
            i += 1
    return sorted(out)


def wiki_template_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return per_text(df, key, text, "node int, parent int, depth int, template string, parameter string, ordinal int, value string", wiki_templates)


def python_tokens(text: str) -> list[tuple[int, str, str]]:
    """(position, kind, spelling) of the names, numbers, strings and signs of source text; comments and space are trivia."""
    pattern = re.compile(r"(?P<trivia>[ \t\r\n\f]+|#[^\n]*)|(?P<string>\"[^\"\n]*\"|'[^'\n]*')|(?P<number>0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?)|(?P<name>[^\W\d]\w*)|(?P<sign>.)", re.S)
    return [(n, m.lastgroup, m.group()) for n, m in enumerate(m for m in pattern.finditer(text) if m.lastgroup != "trivia")]


def python_token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return per_text(df, key, text, "position int, kind string, spelling string", python_tokens)


MAX_ENTRIES, MAX_BYTES, LEAST_COUNT = 8192, 524288, 4
WIKI_MARKUP = ("{{", "}}", "[[", "]]", "<!--", "-->", "<ref", "</ref>", "<br", "==", "&nbsp;")


def pack_entries(entries: list[tuple[str, int]], base: int, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> list[str]:
    """The tokens of (token, bytes) in order that fit both limits, the count of entries included; one that doesn't fit
    is passed over."""
    out, used = [], 0
    for token, size in entries:
        if len(out) < max_entries and base + len(_varint(len(out) + 1)) + used + size <= max_bytes:
            out.append(token)
            used += size
    return out


def byte_totals(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, value, n): how often each byte occurs, summed in every task before the shuffle."""
    def count(batches):
        totals: dict = {}
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                totals[g] = totals.get(g, 0) + np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)
        rows = [(g, v, int(n)) for g, c in totals.items() for v, n in enumerate(c)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], [group, "value", "n"])

    return df.filter(F.col(text).isNotNull()).select(group, text).mapInArrow(count, f"{group} string, value int, n bigint").groupBy(group, "value").agg(F.sum("n").alias("n"))


@functools.cache
def _raw_class(value: int, wiki: bool) -> int:
    """The class of a byte that is coded raw; 0 is the start and 1 a token, 2 a token of markup. Low lines are letters
    in sources and signs in wiki texts."""
    if (value == 95 and not wiki) or 65 <= value <= 90 or 97 <= value <= 122:
        return 3
    if 48 <= value <= 57:
        return 4
    if value in (9, 32):
        return 5
    if value in (10, 13):
        return 6
    return 7 if 33 <= value <= 47 or 58 <= value <= 64 or 91 <= value <= 96 or 123 <= value <= 126 else 8


def predictor_bits(symbols: list[tuple[int, int]], prior: dict[int, int], alphabet: int) -> tuple[float, float]:
    """Bits of (symbol, class) by all counts so far alone, and by them and those after the class before, at 1 to 3.
    ``prior`` are counts to start with; every symbol has half a count besides."""
    counts: dict[int, int] = {}
    inside: dict[tuple[int, int], int] = {}
    totals = [0] * 9
    total, half, before, alone, mixed = sum(prior.values()), alphabet / 2, 0, 0.0, 0.0
    for symbol, kind in symbols:
        n, m = counts.get(symbol, 0), inside.get((before, symbol), 0)
        p = (prior.get(symbol, 0) + n + 0.5) / (total + half)
        alone -= math.log2(p)
        mixed -= math.log2(0.25 * p + 0.75 * (m + 0.5) / (totals[before] + half))
        counts[symbol], inside[before, symbol] = n + 1, m + 1
        total += 1
        totals[before] += 1
        before = kind
    return alone, mixed


def mixed_symbols(data: bytes, ids: dict[bytes, int], scanner: re.Pattern, wiki: bool) -> list[tuple[int, int]]:
    """(symbol, class): the tokens of a dictionary as one symbol each, everything else byte by byte."""
    out, at = [], 0
    for m in scanner.finditer(data):
        if m.group() in ids:
            out += [(v, _raw_class(v, wiki)) for v in data[at : m.start()]]
            out.append((256 + ids[m.group()], 2 if m.group().decode() in WIKI_MARKUP else 1))
            at = m.end()
    return out + [(v, _raw_class(v, wiki)) for v in data[at:]]


def predictor_rows(df: DataFrame, dictionaries: DataFrame, weights: DataFrame, wiki: str = "wikitext-dump") -> DataFrame:
    """(source, n_bytes, p0, p1, p2): bits per byte of each text by bytes (P0), by bytes and classes (P1) and by the
    tokens of its source's dictionary, bytes and classes (P2).

    The dictionaries, at most ``MAX_BYTES`` for each source, and the byte weights come to the driver and go to all tasks."""
    ids: dict[str, dict[bytes, int]] = {}
    prior: dict[str, dict[int, int]] = {}
    for x in weights.collect():
        prior.setdefault(x["source"], {})[x["value"]] = 1 + math.isqrt(x["n"])
    for x in dictionaries.collect():
        ids.setdefault(x["source"], {})[x["token"].encode()] = x["place"] - 1
        prior[x["source"]][255 + x["place"]] = 1 + math.isqrt(x["n"])
    source_words = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{2,63}")
    markup = b"|".join(re.escape(m.encode()) for m in sorted(WIKI_MARKUP, key=lambda m: (-len(m), m)))
    wiki_words = re.compile(b"(?:" + markup + rb"|[A-Za-z][A-Za-z0-9_'\-]{2,63})")

    def run(batches):
        for b in batches:
            out = []
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = text.encode()
                p0, p1 = predictor_bits([(v, _raw_class(v, source == wiki)) for v in data], {}, 256)
                known = ids.get(source, {})
                _, p2 = predictor_bits(mixed_symbols(data, known, wiki_words if source == wiki else source_words, source == wiki), prior[source], 256 + len(known))
                out.append((source, len(data), *(p / len(data) for p in (p0, p1, p2))))
            types = [pa.string(), pa.int64(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["source", "n_bytes", "p0", "p1", "p2"])

    texts = df.filter("source IS NOT NULL AND text <> ''")
    dealt = texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("source", "text")
    return dealt.mapInArrow(run, "source string, n_bytes bigint, p0 double, p1 double, p2 double")


def projected_gains(rows: DataFrame, dictionaries: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, variant, n_texts, n_bytes, mean_bpb, upper_bpb, projected_bytes, gain): the bytes of each source by the
    mean plus two standard errors, with 65,536 bytes to start and the dictionary of P2, and the gain over P0."""
    size = F.length("token") + _varint_size(F.length("token")) + _varint_size(_root(F.col("n")))
    entries = dictionaries.groupBy("source").agg(F.sum(size).alias("entries"), F.count("*").alias("k"))
    base = weights.groupBy("source").agg(F.sum(_varint_size(_root(F.col("n")))).alias("base"))
    held = base.join(entries, "source", "left").select("source", (6 + F.col("base") + F.coalesce("entries", F.lit(0)) + _varint_size(F.coalesce("k", F.lit(0)))).alias("dictionary"))
    long = rows.select("source", "n_bytes", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("P0", "P1", "P2"))), F.array("p0", "p1", "p2"))).alias("variant", "bpb"))
    found = long.groupBy("source", "variant").agg(F.count("*").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"), F.avg("bpb").alias("mean"), F.stddev_pop("bpb").alias("sd"))
    found = found.join(held, "source").withColumn("upper", F.col("mean") + 2 * F.col("sd") / F.sqrt("n_texts"))
    projected = F.ceil(F.round(F.col("upper") * F.col("n_bytes") / 8, 6)) + 65536 + F.when(F.col("variant") == "P2", F.col("dictionary")).otherwise(0)
    found = found.withColumn("projected_bytes", projected)
    first = found.filter("variant = 'P0'").select("source", F.col("projected_bytes").alias("p0_bytes"))
    return found.join(first, "source").select("source", "variant", "n_texts", "n_bytes", F.round("mean", 6).alias("mean_bpb"), F.round("upper", 6).alias("upper_bpb"), "projected_bytes", (F.col("p0_bytes") - F.col("projected_bytes")).alias("gain"))


def _varint_size(v):
    return F.ceil(F.greatest(F.lit(1), F.length(F.bin(v))) / 7).cast("int")


def _root(n):
    """1 + the integer square root."""
    return 1 + F.floor(F.sqrt(n.cast("double"))).cast("bigint")


def source_dictionaries(df: DataFrame, wiki: str = "wikitext-dump") -> DataFrame:
    """(source, place, token, n, gain): one dictionary per source, packed greedily by gain under the limits of entries and
    serialized bytes, from the token counts of all its texts.

    Entries of one size are taken from the front, as an entry is passed over when it doesn't fit and the room only shrinks.
    So no more than the first ``MAX_ENTRIES`` of each source and size can be taken, and a task packs these."""
    from pyspark.sql import Window

    is_wiki = F.col("source") == wiki
    words = F.when(is_wiki, F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_'\-]{2,63}"), 0)).otherwise(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{2,63}"), 0))
    texts = df.filter("source IS NOT NULL AND text IS NOT NULL").select("source", "text")
    counts = texts.select("source", F.explode(words).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    length = F.length("token")
    learned = counts.filter(F.col("n") >= LEAST_COUNT).withColumn("gain", F.col("n") * (length - 2) - length - _varint_size(length)).filter("gain > 0").withColumn("forced", F.lit(0))
    markup = texts.filter(is_wiki).select("source").distinct().select("source", F.explode(F.array(*map(F.lit, WIKI_MARKUP))).alias("token"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("gain"), F.lit(1).alias("forced"))
    size = _varint_size(length) + length + _varint_size(_root(F.col("n")))
    order = [F.desc("forced"), F.desc("gain"), F.desc("n"), F.asc("token")]
    candidates = learned.select("source", "token", "n", "gain", "forced").unionByName(markup).withColumn("size", size)
    candidates = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size").orderBy(*order))).filter(F.col("nth") <= MAX_ENTRIES)
    base = byte_totals(texts, "source", "text").groupBy("source").agg(F.sum(_varint_size(_root(F.col("n")))).alias("base"))

    def pack(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda x: (-x["forced"], -x["gain"], -x["n"], x["token"]))
        known = {x["token"]: x for x in rows}
        kept = pack_entries([(x["token"], x["size"]) for x in rows], 6 + rows[0]["base"])
        columns = [[rows[0]["source"]] * len(kept), range(1, len(kept) + 1), kept, [known[k]["n"] for k in kept], [known[k]["gain"] for k in kept]]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["source", "place", "token", "n", "gain"])

    return candidates.join(base, "source").groupBy("source").applyInArrow(pack, "source string, place int, token string, n bigint, gain bigint")


def _zstd(data: bytes, level: int) -> int:
    return len(pa.Codec("zstd", compression_level=level).compress(data, asbytes=True))


def _varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out) + bytes([v])


def columns_of(data: bytes, delimiter: bytes) -> bytes:
    """The fields of the records column by column: counts of fields, then of each column the lengths and the bytes."""
    rows = [line.split(delimiter) for line in data.split(b"\n")]
    out = [_varint(len(rows)), *(_varint(len(x)) for x in rows)]
    for j in range(max(map(len, rows))):
        column = [x[j] for x in rows if j < len(x)]
        out += [*(_varint(len(v)) for v in column), *column]
    return b"".join(out)


def rows_of_columns(form: bytes, delimiter: bytes) -> bytes:
    """The inverse of ``columns_of``."""
    at = 0

    def number() -> int:
        nonlocal at
        v = shift = 0
        while True:
            v |= (form[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if form[at - 1] < 128:
                return v

    widths = [number() for _ in range(number())]
    rows: list[list[bytes]] = [[] for _ in widths]
    for j in range(max(widths)):
        here = [x for x, w in zip(rows, widths) if j < w]
        for x, n in zip(here, [number() for _ in here]):
            x.append(form[at : at + n])
            at += n
    return b"\n".join(delimiter.join(x) for x in rows)


SAMPLE_BYTES = 1 << 20


def table_backend(data: bytes) -> tuple[str, int, str, int]:
    """(backend, level, reason, bytes) of a delimited table: columns where they win clearly on a sample and also beat the
    direct form of the whole; a higher level for very dense columns; store where nothing helps."""
    third = SAMPLE_BYTES // 3
    sample = data if len(data) <= SAMPLE_BYTES else data[:third] + data[len(data) // 2 - third // 2 :][:third] + data[-third:]
    delimiter = max((b",", b";", b"\t", b"|"), key=sample.count)
    direct, column = _zstd(sample, 3), _zstd(columns_of(sample, delimiter), 3)
    reason, backend, level, size = "direct or ambiguous", "direct", 9, None
    if column < direct * 0.98:
        level, reason = (16, "extreme column ratio") if column / max(1, len(sample)) < 0.05 else (9, "ordinary column ratio")
        backend, size = "column", _zstd(columns_of(data, delimiter), level)
        whole = min(_zstd(data, 3), len(data))
        if size >= whole:
            backend, level, reason, size = "direct", 3, "full direct fallback", whole
    else:
        size = _zstd(data, 9)
    return (backend, level, reason, size) if backend == "column" or size < len(data) else ("store", 0, reason, len(data))


def identifier_ranks(text: str) -> list[tuple[int, int, bool, int]]:
    """(position, lexicon id, first, rank) of the names of source text: ids in order of first use, and the place of each
    later use in a move-to-front list; a first use goes to the front and has rank -1."""
    import keyword

    lexicon: dict[str, int] = {}
    recent: list[int] = []
    out = []
    for position, kind, name in python_tokens(text):
        if kind != "name" or keyword.iskeyword(name):
            continue
        first = name not in lexicon
        i = lexicon.setdefault(name, len(lexicon))
        rank = -1 if first else recent.index(i)
        if not first:
            recent.pop(rank)
        recent.insert(0, i)
        out.append((position, i, first, rank))
    return out
