import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import corpus_encoding as c

pytestmark = pytest.mark.skipif(not os.path.exists(c.TOKENIZERS), reason="no tokenizers here")
ENCODER = c.Encoder.of(c.ranks_bytes("byte_bpe_50k", c.TOKENIZERS)) if os.path.exists(c.TOKENIZERS) else None
PIECES = st.sampled_from(["word", " ", "\n", "  \n ", "'", "re", "'ll", "日本語", "प्रत", "👩‍🔬", "<|endoftext|>", "12.5", " ", " ", "é", "_x", "   x"])
TEXTS = st.lists(PIECES | st.text(max_size=4), max_size=40).map("".join)


def joined(parts):
    """The parts' ids joined, with what is known of their joins."""
    ends = [sum(len(p.encode()) for p in parts[:i]) for i in range(len(parts))]
    safe = set(c.safe_places(np.frombuffer("".join(parts).encode(), np.uint8)).tolist())
    return ENCODER.join([ENCODER.ids(p) for p in parts], [e in safe for e in ends]).tolist()


@settings(max_examples=500, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 200), max_size=12))
def test_joins_agree_with_the_whole_text(text, cuts):
    at = sorted({min(x, len(text)) for x in cuts} | {0, len(text)})
    parts = [text[a:b] for a, b in zip(at, at[1:]) if a < b]
    assert joined(parts) == ENCODER.encode(text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=6), st.text(max_size=6))
def test_safe_places_are_breaks_in_any_surrounding(left, right):
    """Encodings on both sides of a safe place add up to that of the whole."""
    text = left + right
    for at in c.safe_places(np.frombuffer(text.encode(), np.uint8)).tolist():
        a, b = text.encode()[:at].decode(), text.encode()[at:].decode()
        assert ENCODER.encode(a) + ENCODER.encode(b) == ENCODER.encode(text)


@pytest.mark.parametrize("text", ["x's y'll 'tis it'S ''s", "a1b2,c'3'd", "，。你好，世界。\n再见", "naïve—café№5", "\u200b\u00a0x\u3000y\ufeff", "12'll 3's"])
def test_every_cut_of_tricky_texts(text):
    for i in range(len(text)):
        for j in range(i, len(text)):
            assert joined([p for p in (text[:i], text[i:j], text[j:]) if p]) == ENCODER.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | TEXTS.map(lambda t: t * 9), max_size=5))
def test_chunks_cover_the_texts(texts):
    column = pa.array(texts, pa.string())
    row, start, end, joint = c.cut_texts(column)
    large = column.cast(pa.large_string())
    data = large.buffers()[2].to_pybytes() if large.buffers()[2] is not None else b""
    for i, t in enumerate(texts):
        assert b"".join(data[s:e] for r, s, e in zip(row, start, end) if r == i) == (t or "").encode()
    for s, e in zip(start, end):
        data[s:e].decode()


def test_the_time_grows_with_the_bytes():
    """Chinese without a visible ASCII sign: four times the text takes about four times as long."""
    import time

    line = "研究表明，压缩率与速度之间存在明显的权衡。\n实验在不同语言的文本上重复进行。\n"

    def took(n):
        column = pa.array(["".join(f"{chr(0x4E00 + i * 37 % 9000)}{line}" for i in range(n))])
        began = time.process_time()
        row, start, end, joint = c.cut_texts(column)
        text = column.cast(pa.large_string())
        ids = ENCODER.join([ENCODER.ids(p) for p in c._pieces(text, start, end)], joint.tolist())
        spent = time.process_time() - began
        assert ids.tolist() == ENCODER.encode(column[0].as_py())
        return spent

    took(2000)
    assert took(20_000) < 10 * took(4_000)


def test_shared_passages_share_chunks():
    import random

    rng = random.Random(8)
    passage = " ".join(str(rng.random()) for _ in range(400))
    column = pa.array(["short start " + passage, "another and much longer start of the text " * 3 + passage])
    row, start, end, _ = c.cut_texts(column)
    data = column.cast(pa.large_string()).buffers()[2].to_pybytes()
    sets = [{data[s:e] for r, s, e in zip(row, start, end) if r == i} for i in (0, 1)]
    assert len(sets[0] & sets[1]) > 0.8 * len(sets[0])


def test_corpus(spark):
    hot = "The same text in very many rows, as copies are. " * 40
    texts = [None, "", " ", "a", "日本語のとても長い文章" * 900, "x" * 30_000, " " * 5_000, "<|endoftext|> is text", *[hot] * 200, *[hot + str(i) for i in range(50)]]
    rows = [(i % 200, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in c.encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted((k, ENCODER.encode(t) if t else []) for k, t, _ in rows)
    counts = sorted(tuple(r) for r in c.count_tokens(df, "doc_id", "text").collect())
    assert counts == sorted((k, len(ids)) for k, ids in got)
    assert c.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
