"""Token ids of a whole corpus by a public byte-level BPE, with content-defined chunk reuse.

Texts are cut by a rolling hash of their bytes, so texts that share a passage share its chunks. Each distinct chunk is
encoded once; its ids are joined back to every text that holds it, and the joins between neighbouring chunks are
repaired: where a join isn't a place at which the tokenizer always breaks, the text between the nearest such places on
both sides is encoded again, which agrees exactly with an encoding of the whole text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged, table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern that splits text before the merges of the 50k byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 16  # bytes of the rolling hash
MEAN_MASK = 255  # a cut after every 256 bytes on average
LEAST, MOST, SNAP = 64, 2048, 64  # bytes of a chunk, and how far a cut may move to a place where the tokenizer breaks
HOT_SHARE = 1_000  # a chunk with more than one in so many of all occurrences is hot; there are fewer than so many
CACHED = 1 << 16  # chunks that a Python worker remembers where they are reused next to the scan
GEAR = np.random.default_rng(20_260_102).integers(0, 1 << 32, 256, dtype=np.uint32)
LETTER, NUMBER, SPACE, SIGN, QUOTE = 1, 2, 3, 4, 5


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every character of the first plane, 0 where it isn't certain, and whether two classes in a row are a
    place where the pattern always breaks, whatever stands around.

    No piece has white space after another character, goes on from letters into numbers or signs, from numbers into
    letters or signs, or from signs into numbers or letters, but for a quote before letters; and no alternative looks
    back beyond such a place, or ahead beyond white space. Only characters whose category is the same in the oldest and
    the newest character table at hand count as known, so that engines of any age agree on them."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE, "P": SIGN, "S": SIGN}
    table = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        old, new = unicodedata.ucd_3_2_0.category(chr(i))[0], unicodedata.category(chr(i))[0]
        table[i] = kinds.get(old, 0) if old == new else 0
    table[[9, 10, 11, 12, 13]] = SPACE
    table[0x27] = QUOTE
    breaks = np.zeros((6, 6), bool)
    breaks[[LETTER, NUMBER, SIGN, QUOTE], SPACE] = True
    breaks[LETTER, [NUMBER, SIGN, QUOTE]] = breaks[NUMBER, [LETTER, SIGN, QUOTE]] = True
    breaks[SIGN, [LETTER, NUMBER]] = breaks[QUOTE, NUMBER] = True
    return table, breaks


def safe_places(data: np.ndarray) -> np.ndarray:
    """The byte places inside UTF-8 ``data`` at which the tokenizer always breaks, ascending."""
    table, breaks = _classes()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = np.where(points < 1 << 16, table[np.minimum(points, (1 << 16) - 1)], 0)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return at[1:][breaks[kind[:-1], kind[1:]]]


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over the last WINDOW bytes b[i-j] of GEAR[b] << j, modulo 2**32, by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h, width = h + shifted, width * 2
    return h


def cut_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, joint) of the chunks of a string column, as byte places in its value buffer; joint says whether
    the tokenizer always breaks where the chunk starts. Nulls and empty texts have none. Cuts never split a character."""
    column = column.cast(pa.large_string())
    none = np.empty(0, np.int64)
    if len(column) == 0 or column.buffers()[2] is None:
        return none, none, none, none.astype(bool)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]]
    safe = safe_places(data)
    # Every mark of the rolling hash with the place that a cut there moves to, and whether that is a safe one.
    marks = np.flatnonzero((rolling_hashes(data) >> np.uint32(24)) & np.uint32(MEAN_MASK) == 0) + 1

    def moved(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.append(safe, 1 << 62)[np.searchsorted(safe, at)]
        lead = at.copy()
        for _ in range(3):
            inside = lead < len(data)
            lead[inside] += (data[lead[inside]] & 0xC0) == 0x80
        near = after - at <= SNAP
        return np.where(near, after, lead), near

    cut_at, cut_safe = (a.tolist() for a in moved(marks))
    marks = marks.tolist()
    rows, starts, ends, joints = [], [], [], []
    present = np.asarray(column.is_valid()) & (offsets[1:] > offsets[:-1])
    for row in np.flatnonzero(present).tolist():
        at, stop, joint = int(offsets[row]), int(offsets[row + 1]), True
        while at < stop:
            i = bisect_left(marks, at + LEAST) if stop - at > LEAST else len(marks)
            if i < len(marks) and marks[i] <= at + MOST:
                cut, fine = cut_at[i], cut_safe[i]
            elif stop - at > MOST:
                cut, fine = (a.item() for a in moved(np.array([at + MOST])))
            else:
                cut, fine = stop, True
            cut = min(cut, stop)
            rows.append(row)
            starts.append(at)
            ends.append(cut)
            joints.append(joint)
            at, joint = cut, fine
    return np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), np.array(joints, bool)


def _digests(text: pa.Array, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    data = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
    return [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist())]


def _pieces(text: pa.Array, start: np.ndarray, end: np.ndarray) -> list[str]:
    data = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
    return [str(data[s:e], "utf-8") for s, e in zip(start.tolist(), end.tolist())]


def chunks(rows: DataFrame) -> DataFrame:
    """(row, at, joint, digest, chunk) for every chunk of ``rows`` (row, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).cast(pa.large_string())
            row, start, end, joint = cut_texts(text)
            at = np.arange(len(row)) - np.searchsorted(row, row)
            columns = [pc.take(b.column(0), pa.array(row)), pa.array(at, pa.int32()), pa.array(joint), pa.array(_digests(text, start, end), pa.binary()), pa.array(_pieces(text, start, end), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "at", "joint", "digest", "chunk"])

    schema = T.StructType([rows.schema["row"]]).add("at", T.IntegerType()).add("joint", T.BooleanType()).add("digest", T.BinaryType()).add("chunk", T.StringType())
    return rows.mapInArrow(cut, schema)


_ENCODERS: dict = {}


class Encoder:
    """A byte-level BPE from a rank file, with the bytes of each id. Packed ids are two bytes each where all fit."""

    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([len(t) for t in self.bytes_of], np.int64)
        self.packed = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        self.known: dict[bytes, np.ndarray] = {}

    @classmethod
    def of(cls, ranks_file: bytes) -> Encoder:
        """The encoder of this Python worker, made once."""
        key = hashlib.blake2b(ranks_file).digest()
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(ranks_file)
        return _ENCODERS[key]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), self.packed)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def _split(self, ids: np.ndarray) -> tuple[int, int] | None:
        """How many of a chunk's ids come before the first and before the last safe place inside it."""
        places = safe_places(np.frombuffer(self.decode(ids), np.uint8))
        if len(places) == 0:
            return None
        upto = np.cumsum(self.sizes[ids])
        first, last = np.searchsorted(upto, places[[0, -1]])
        if upto[first] != places[0] or upto[last] != places[-1]:
            raise AssertionError("a break of the tokenizer lies inside a token")
        return int(first) + 1, int(last) + 1

    def join(self, parts: list[np.ndarray], joint: list[bool]) -> np.ndarray:
        """The ids of the whole text from those of its chunks in order; ``joint``: the tokenizer breaks before a chunk.

        Text between the last safe place before a doubtful join and the first one after it waits until the latter is
        met and is then encoded again, so each byte is encoded twice at most."""
        out: list[np.ndarray] = []
        waiting: list[bytes] = []

        def repair() -> None:
            if waiting:
                out.append(self.ids(b"".join(waiting).decode("utf-8")))
                waiting.clear()

        for i, ids in enumerate(parts):
            sound_start, sound_end = i == 0 or joint[i], i + 1 == len(parts) or joint[i + 1]
            if sound_start:
                repair()
            if sound_start and sound_end:
                out.append(ids)
                continue
            inner = self._split(ids)
            if inner is None:
                waiting.append(self.decode(ids))
                continue
            first, last = 0 if sound_start else inner[0], len(ids) if sound_end else inner[1]
            if not sound_start:
                waiting.append(self.decode(ids[:first]))
                repair()
            out.append(ids[first:last])
            if not sound_end:
                waiting.append(self.decode(ids[last:]))
        repair()
        return np.concatenate(out) if out else np.empty(0, self.packed)

    def encode_chunks(self, digests: list[bytes], pieces: list[str]) -> list[np.ndarray]:
        """The ids of chunks, each encoded once while it is remembered."""
        out = []
        for d, piece in zip(digests, pieces):
            ids = self.known.get(d)
            if ids is None:
                if len(self.known) >= CACHED:
                    self.known.clear()
                ids = self.known[d] = self.ids(piece)
            out.append(ids)
        return out


def ranks_bytes(name: str, tokenizers: str) -> bytes:
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        return f.read()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens; their strings are ordinary text.

    Null and empty texts give an empty list; blank texts are encoded. Rows with equal keys stay apart. The vocabulary
    is read on the driver and broadcast (under 1 MB, fixed). Texts are cut once, into a staged table; shuffled are each
    distinct chunk once per map task, the 16-byte digests of all occurrences, and packed ids. No text is shuffled to its
    row, as ids give back the bytes that a repair needs. Occurrences of a hot chunk meet its ids by a broadcast of fewer
    than HOT_SHARE chunks of at most MOST + SNAP bytes; other chunks by a shuffle in which no key is hot. The time is in
    proportion to the bytes, whatever the script; only a run of one class of characters without any break (say letters
    without end) is a single piece, which the tokenizer itself takes as a whole. Texts may be of any length below 2 GB.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(ranks_bytes(tokenizer, tokenizers))
    rows = df.select(F.struct(F.monotonically_increasing_id().alias("no"), F.col(key).alias("key")).alias("row"), F.col(text).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value)
        for b in batches:
            ids = pa.array([encoder.ids(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, b.column(2)], ["digest", "ids", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value)
        for b in batches:
            parts = b.column(1)
            flat = parts.flatten()
            joint = flat.field("joint").to_numpy(zero_copy_only=False)
            packed = flat.field("ids").cast(pa.large_binary())
            at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // encoder.packed.itemsize
            ids = np.frombuffer(packed.buffers()[2], encoder.packed) if len(packed) else np.empty(0, encoder.packed)
            bounds = np.cumsum([0, *pc.list_value_length(parts).to_pylist()]).tolist()
            out = []
            for lo, hi in zip(bounds, bounds[1:]):
                if joint[lo:hi].all():  # the ids of neighbouring parts lie side by side
                    out.append(ids[at[lo] : at[hi]])
                else:
                    out.append(encoder.join([ids[at[i] : at[i + 1]] for i in range(lo, hi)], joint[lo:hi].tolist()))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], ["row", "ids"])

    held = staged(chunks(rows), "chunks")
    distinct = held.groupBy("digest").agg(F.any_value("chunk").alias("chunk"), F.count("*").alias("n"))
    encoded = staged(distinct.mapInArrow(encode, "digest binary, ids binary, n bigint"), "encoded-chunks")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(encoded.filter(F.col("n") * HOT_SHARE > total).select("digest", "ids"))
    places = held.select("row", "at", "joint", "digest")
    with_ids = places.join(hot, "digest").unionByName(places.join(hot.select("digest"), "digest", "left_anti").join(encoded.select("digest", "ids"), "digest"))
    parts = with_ids.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "joint", "ids"))).alias("parts"))
    schema = T.StructType([parts.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = parts.mapInArrow(join, schema).select(F.col("row.key").alias(key), "ids")
    empty = df.filter(F.coalesce(F.col(text).cast("string"), F.lit("")) == "").select(key, F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(empty)


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, tokens): the number of ids of every row's text, 0 for null and empty texts.

    The same chunks and repairs as ``encode_corpus``, but next to the scan: a Python worker remembers the last CACHED
    chunks it met, so a chunk is encoded once per worker rather than once at all, and nothing is shuffled."""
    ranks = df.sparkSession.sparkContext.broadcast(ranks_bytes(tokenizer, tokenizers))
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks.value)
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            row, start, end, joint = cut_texts(texts)
            ids = encoder.encode_chunks(_digests(texts, start, end), _pieces(texts, start, end))
            sizes = np.array([len(x) for x in ids], np.int64)
            tokens = np.bincount(row, sizes, len(b)).astype(np.int64)
            first, last = np.searchsorted(row, np.arange(len(b))), np.searchsorted(row, np.arange(len(b)), side="right")
            for i in np.unique(row[~joint]).tolist():
                lo, hi = int(first[i]), int(last[i])
                tokens[i] = len(encoder.join(ids[lo:hi], joint[lo:hi].tolist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64())], [key, "tokens"])

    schema = T.StructType([T.StructField(key, rows.schema["_key"].dataType), T.StructField("tokens", T.LongType())])
    return rows.mapInArrow(count, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per source and language as spelled."""
    docs = table(spark, sf_dir, "documents").select(F.struct("source", "lang").alias("of"), "text")
    return count_tokens(docs, "of", "text").groupBy(F.col("of.source").alias("source"), F.col("of.lang").alias("lang")).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_token_counts": p8_token_counts}
ORACLES: dict[str, str] = {}
