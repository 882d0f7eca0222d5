import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators import frames as f

RAMP = struct.pack("<4000I", *range(0, 12_000, 3))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=600) | st.just(RAMP), st.integers(1, 300))
def test_frames_round_trip(data, segment):
    frame = f.pack_frame(data, segment)
    info = f.inspect_frame(frame)
    assert f.unpack_frame(frame) == data and sum(s[2] for s in info.segments) == len(data) == info.original
    assert info.sha256 == hashlib.sha256(data).hexdigest() and (info.layout, info.version, info.encoded) == ("adaptive", 3, len(frame))


def test_recipes():
    assert [s[1] for s in f.inspect_frame(f.pack_frame(RAMP)).segments] == ["delta-transpose+zstd-3"]
    assert [s[1] for s in f.inspect_frame(f.pack_frame(b"words " * 200)).segments] == ["zstd-3"]
    assert [s[1] for s in f.inspect_frame(f.pack_frame(b"xyz")).segments] == ["store"] and f.inspect_frame(f.pack_frame(b"")).segments == ()


def test_damaged_frames_are_refused():
    frame = f.pack_frame(b"some bytes" * 50, 64)
    for cut in range(len(frame)):
        with pytest.raises(ValueError):
            f.inspect_frame(frame[:cut])
    with pytest.raises(ValueError):
        f.inspect_frame(frame + b"x")
    broken = bytearray(f.pack_frame(b"abcdef"))
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        f.unpack_frame(bytes(broken))


def stream(magic, version, parts, **more):
    layout = f.LAYOUTS[magic]
    body = b"".join(layout.write("segment", original=n, payload=len(p)) + p for n, p in parts)
    return layout.write("head", magic=magic, version=version, original=sum(n for n, _ in parts), payload=len(body), sha256=b"s" * 32, payload_sha256=hashlib.sha256(body).digest(), count=len(parts), **more) + body


def test_streams_and_older_frames():
    info = f.inspect_frame(stream(b"JLS2", 1, [(100, b"JLF2" + b"x" * 20), (7, b"JLF2")]))
    assert (info.layout, info.original, [s[1:4] for s in info.segments]) == ("json-log", 107, [("JLF2", 100, 24), ("JLF2", 7, 4)])
    info = f.inspect_frame(stream(b"TBS1", 1, [(5, b"TBL1abc")], segment_size=1 << 20))
    assert info.layout == "table" and info.segments[0][1:4] == ("TBL1", 5, 7)
    whole = stream(b"JLS2", 1, [(100, b"JLF2")])
    for broken in (whole[:-1], whole[:-1] + b"?", stream(b"JLS2", 9, []), b"NOPE" + whole[4:]):
        with pytest.raises(ValueError):
            f.inspect_frame(broken)
    old = f.ADAPTIVE.write("head", magic=b"CLAB", version=1, backend=1, original=9, sha256=b"s" * 32) + b"payload"
    assert f.inspect_frame(old).segments == ((0, "legacy-backend-1", 9, 7, None, len(old) - 7),)


def test_rows_of_segments(spark):
    df = spark.createDataFrame([(1, "abc" * 1000), (2, ""), (3, None), (4, "é")], "doc_id long, text string")
    rows = f.segment_rows(df, "doc_id", "text", 1000)
    assert {(r.doc_id, r.segment, r.original) for r in rows.collect()} == {(1, 0, 1000), (1, 1, 1000), (1, 2, 1000), (4, 0, 2)}
    data = {(r.doc_id, r.segment): bytes(r.data) for r in f.decoded_segments(rows).collect()}
    assert b"".join(data[1, i] for i in range(3)) == b"abc" * 1000 and data[4, 0] == "é".encode()
    with pytest.raises(Exception, match="checksum"):
        f.decoded_segments(rows.withColumn("checksum", rows.checksum + 1)).collect()
