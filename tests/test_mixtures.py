import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators import mixtures as m
from tallyloom.operators import records as r


def context(name, data, i):
    before = bytes(8) + data[:i]
    if name == "sparse":
        return before[-3:-1]
    if name == "word":
        j = i
        while j > 0 and (97 <= data[j - 1] | 32 <= 122 or data[j - 1] >= 128 or data[j - 1] == 95):
            j -= 1
        return data[j:i]
    order = int(name.removeprefix("order-"))
    return before[-order:] if order else b""


def one_by_one(data):
    counts = {name: {} for name in m.EXPERTS}
    weights, bits = dict.fromkeys(m.EXPERTS, 1 / len(m.EXPERTS)), []
    for i, b in enumerate(data):
        seen = {name: counts[name].setdefault(context(name, data, i), {}) for name in m.EXPERTS}
        p = {name: (s.get(b, 0) + 0.5) / (sum(s.values()) + 128) for name, s in seen.items()}
        whole = sum(weights[name] * p[name] for name in m.EXPERTS)
        bits.append(-math.log2(whole))
        weights = {name: (1 - m.SHARE) * weights[name] * p[name] / whole + m.SHARE / len(m.EXPERTS) for name in m.EXPERTS}
        for s in seen.values():
            s[b] = s.get(b, 0) + 1
    return bits


TEXTS = st.lists(st.text("ab e\n_é0", max_size=40).map(str.encode), min_size=1, max_size=5)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_against_one_byte_after_the_other(texts):
    bits, shares = m.mix(m.probabilities(texts), [len(t) for t in texts])
    want = [x for t in texts for x in one_by_one(t)]
    assert np.allclose(bits, want) and np.allclose(shares.sum(axis=0), 1)


def test_arms():
    text = b"abracadabra, abracadabra and once more abracadabra" * 4
    got = dict(m.arms([text])[0])
    assert abs(sum(v for k, v in got.items() if k.startswith("credit-")) - got["full"]) < 1e-6
    assert got["full"] < got["frozen"] < 8 * len(text) and got["refined"] < got["frozen"] and got["without-order-0"] > 0
    assert m.arms([text], ("full",)) == [[("full", got["full"])]]


def test_texts_do_not_learn_from_each_other():
    texts = [b"the same text again", b"", b"the same text again"]
    a, b, c = m.arms(texts, ("full",))
    assert abs(a[0][1] - c[0][1]) < 1e-9 and b == [("full", 0.0)]


def test_rows_and_training(spark, monkeypatch):
    monkeypatch.setattr(m, "AT_ONCE", 200)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word word word " * 60), (4, '{"a": 1}\n'), (4, "x")], "doc_id long, text string")
    rows = m.arm_rows(df, "doc_id", "text", ("full",)).collect()
    assert sorted(x.doc_id for x in rows) == [3, 4, 4]
    weights = m.trained_weights(df, "doc_id", "text")
    assert abs(sum(weights) - 1) < 1e-9 and max(weights) > 1.2 / len(m.EXPERTS)
    equal = {x.doc_id: x.bits for x in m.arm_rows(df, "doc_id", "text", ("frozen",)).collect()}
    trained = {x.doc_id: x.bits for x in m.arm_rows(df, "doc_id", "text", ("frozen",), weights).collect()}
    assert trained[3] < equal[3]
    classes = m.class_losses(df, "doc_id", "text", r.class_runs).groupBy("doc_id").sum("n_bytes").collect()
    assert {x[0]: x[1] for x in classes} == {3: 900, 4: 10}
    quarters = {(x.doc_id, x.quarter): (x.n_bytes, x.bits) for x in m.quarter_rows(df.filter("doc_id = 3"), "doc_id", "text").collect()}
    assert [quarters[3, k][0] for k in (1, 2, 3, 4)] == [225] * 4 and quarters[3, 4][1] < quarters[3, 1][1] / 3
    assert m.trained_weights(df.limit(0), "doc_id", "text") == [1 / len(m.EXPERTS)] * len(m.EXPERTS)
    assert m.arm_rows(df.limit(0), "doc_id", "text").count() == 0
