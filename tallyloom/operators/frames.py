"""Compressed frames and streams of segments: their metadata without decoding, and a writer of one row per segment."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import selectors

# The layouts. Fields of a head and of a segment's head are big-endian; a 'skip' is reserved.
RECIPES = {0: "store", 1: "zstd-3", 2: "delta-transpose+zstd-3", 3: "structured-text+zstd-3", 4: "structured-text-channel+zstd-3"}
LEGACY, SEGMENTED = (1, 2), 3


@dataclass(frozen=True)
class Layout:
    name: str
    versions: tuple[int, ...]
    head: tuple[tuple[str, str], ...]
    segment: tuple[tuple[str, str], ...]

    @staticmethod
    def _struct(fields: tuple[tuple[str, str], ...]) -> struct.Struct:
        return struct.Struct(">" + "".join(code for code, _ in fields))

    def read(self, part: str, data: bytes, at: int) -> tuple[dict, int]:
        """The fields of a 'head' or 'segment' and where it ends; ValueError if the data ends before."""
        fields = getattr(self, part)
        form = self._struct(fields)
        if at + form.size > len(data):
            raise ValueError(f"{part} ends early")
        return dict(zip((name for _, name in fields), form.unpack_from(data, at))), at + form.size

    def write(self, part: str, **values) -> bytes:
        fields = getattr(self, part)
        return self._struct(fields).pack(*(values.get(name, 0) for _, name in fields))


LAYOUTS = {
    b"CLAB": Layout("adaptive", (1, 2, 3), (("4s", "magic"), ("B", "version"), ("B", "backend"), ("Q", "original"), ("32s", "sha256")), (("B", "recipe"), ("I", "original"), ("I", "payload"), ("I", "checksum"))),
    b"JLS2": Layout("json-log", (1,), (("4s", "magic"), ("B", "version"), ("B", "skip1"), ("H", "skip2"), ("Q", "original"), ("32s", "sha256"), ("32s", "payload_sha256"), ("I", "count")), (("Q", "original"), ("Q", "payload"))),
    b"TBS1": Layout("table", (1,), (("4s", "magic"), ("B", "version"), ("B", "flags"), ("H", "skip"), ("Q", "segment_size"), ("Q", "record_slack"), ("Q", "original"), ("Q", "payload"), ("32s", "sha256"), ("32s", "payload_sha256"), ("I", "count")), (("Q", "original"), ("Q", "payload"))),
}
BACKEND = 6  # of a segmented adaptive frame
ADAPTIVE = LAYOUTS[b"CLAB"]


@dataclass(frozen=True)
class Frame:
    layout: str
    version: int
    original: int
    encoded: int
    sha256: str
    segments: tuple[tuple[int, str, int, int, int | None, int], ...]  # number, recipe, original, payload, checksum, offset


def inspect_frame(frame: bytes) -> Frame:
    """The metadata of a frame of any known layout, read along its heads; ValueError if it is damaged or unknown.

    Adaptive frames before version 3 have no segments, and their backend stands for the recipe; streams hold frames of
    their own as segments, whose magic is the recipe."""
    layout = LAYOUTS.get(bytes(frame[:4]))
    if layout is None:
        raise ValueError("no known frame")
    head, at = layout.read("head", frame, 0)
    if head["version"] not in layout.versions or any(head[k] for k in head if k.startswith("skip")):
        raise ValueError(f"unknown version of {layout.name} frames")
    original, found = head["original"], []
    if layout is ADAPTIVE and head["version"] in LEGACY:
        if original:
            found.append((0, f"legacy-backend-{head['backend']}", original, len(frame) - at, None, at))
        return Frame(layout.name, head["version"], original, len(frame), head["sha256"].hex(), tuple(found))
    if layout is ADAPTIVE:
        if head["backend"] != BACKEND or at + 4 > len(frame):
            raise ValueError("no segments")
        count, at = struct.unpack_from(">I", frame, at)[0], at + 4
    else:
        count = head["count"]
        if hashlib.sha256(frame[at:]).digest() != head["payload_sha256"]:
            raise ValueError("payload has another digest")
    if (count == 0) != (original == 0) or count > original:
        raise ValueError("impossible number of segments")
    for n in range(count):
        s, at = layout.read("segment", frame, at)
        if s["original"] == 0 or at + s["payload"] > len(frame):
            raise ValueError("damaged segment")
        recipe = RECIPES.get(s["recipe"]) if "recipe" in s else frame[at : at + 4].decode("latin-1")
        if recipe is None:
            raise ValueError("unknown recipe")
        found.append((n, recipe, s["original"], s["payload"], s.get("checksum"), at))
        at += s["payload"]
    if at != len(frame) or sum(s[2] for s in found) != original:
        raise ValueError("sizes don't add up")
    return Frame(layout.name, head["version"], original, len(frame), head["sha256"].hex(), tuple(found))


def encode_segment(data: bytes) -> tuple[int, bytes]:
    """(recipe, payload) of one segment: planes where a sample favours them, else zstd-3, or store where that isn't smaller."""
    pack = lambda d: pa.Codec("zstd", compression_level=3).compress(d, asbytes=True)
    sample = selectors.sample_of(data, selectors.SECOND_SAMPLE)
    planes = len(pack(selectors.delta_planes(sample))) < selectors.CONFIRMED * len(pack(sample))
    payload = pack(selectors.delta_planes(data) if planes else data)
    return (2 if planes else 1, payload) if len(payload) < len(data) else (0, data)


def decode_segment(recipe: str, payload: bytes, original: int, checksum: int | None) -> bytes:
    """The inverse; ValueError for another size or checksum, or a recipe that isn't written here."""
    if recipe not in (RECIPES[0], RECIPES[1], RECIPES[2]):
        raise ValueError(f"can't decode {recipe}")
    data = payload if recipe == "store" else pa.Codec("zstd").decompress(payload, original, asbytes=True)
    data = selectors.words_of_planes(data) if recipe == RECIPES[2] else data
    if len(data) != original or (checksum is not None and zlib.crc32(data) != checksum):
        raise ValueError("segment has another size or checksum")
    return data


def segments_of(data: bytes, size: int = selectors.SEGMENT) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(number, recipe, original, payload, checksum)."""
    for n, i in enumerate(range(0, len(data), size)):
        part = data[i : i + size]
        yield n, *(lambda r: (r[0], len(part), r[1]))(encode_segment(part)), zlib.crc32(part)


def pack_frame(data: bytes, size: int = selectors.SEGMENT) -> bytes:
    """A segmented adaptive frame."""
    parts = list(segments_of(data, size))
    body = [ADAPTIVE.write("segment", recipe=r, original=n, payload=len(p), checksum=c) + p for _, r, n, p, c in parts]
    head = ADAPTIVE.write("head", magic=b"CLAB", version=SEGMENTED, backend=BACKEND, original=len(data), sha256=hashlib.sha256(data).digest())
    return b"".join([head, struct.pack(">I", len(parts)), *body])


def unpack_frame(frame: bytes) -> bytes:
    info = inspect_frame(frame)
    data = b"".join(decode_segment(recipe, frame[at : at + n], size, check) for _, recipe, size, n, check, at in info.segments)
    if hashlib.sha256(data).hexdigest() != info.sha256:
        raise ValueError("frame has another digest")
    return data


SEGMENT_ROWS = "segment int, recipe int, original bigint, payload binary, checksum bigint"


def segment_rows(df: DataFrame, key: str, text: str, size: int = selectors.SEGMENT) -> DataFrame:
    """(key, segment, recipe, original, payload, checksum): one row per segment of each non-null text."""
    kept = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_data"))
    schema = T.StructType([T.StructField(key, kept.schema["_key"].dataType), *T._parse_datatype_string(SEGMENT_ROWS).fields])
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1).to_pylist()):
                rows = list(segments_of(data, size))
                columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(rows), pa.int32())), *columns], schema.names)

    return kept.mapInArrow(run, schema)


def decoded_segments(rows: DataFrame) -> DataFrame:
    """The rows of ``segment_rows`` with ``data`` in place of recipe, payload and checksum; a damaged one is an error."""
    kept = [c for c in rows.columns if c not in ("recipe", "original", "payload", "checksum")]
    packed = rows.select(*kept, F.struct("recipe", "original", "payload", "checksum").alias("_s"))
    schema = T.StructType([*[packed.schema[c] for c in kept], T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [decode_segment(RECIPES[s["recipe"]], s["payload"], s["original"], s["checksum"]) for s in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(data, pa.binary())], schema.names)

    return packed.mapInArrow(run, schema)
