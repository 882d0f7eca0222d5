import json
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators import records as r

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(), c, max_size=3), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(), JSON, max_size=5), st.sampled_from([None, 1]))
def test_raw_spans_give_the_values_back(d, indent):
    text = json.dumps(d, indent=indent)
    fields = r.top_level_fields(text)
    assert [(k, json.loads(text[a:b])) for k, a, b in fields] == list(d.items())
    assert r.skeleton(text).count("\0") >= len(d)


@pytest.mark.parametrize("text", ["", "not-json", "[1]", '{"a":1', '{"a":1} x', '{"a" 1}', '{"a":NaN}', "{1:2}", '{"a":1,}'])
def test_what_is_no_flat_object(text):
    assert r.top_level_fields(text) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text(), JSON, max_size=4).map(json.dumps) | st.text() | st.just('{"a": 1, "a" : "x:\\"y", "b\\\\": [1 , 2] }'), max_size=5), st.booleans())
def test_texts_come_back_from_their_channels(lines, ended):
    text = "\n".join(lines) + "\n" * ended
    assert r.text_of_channels(*r.json_channels(text)) == text


def test_duplicate_keys_are_kept_in_order():
    text = ' { "b" : [1,2,{"x":"y"}], "b": true }\r'
    assert [(k, text[a:b]) for k, a, b in r.top_level_fields(text)] == [("b", '[1,2,{"x":"y"}]'), ("b", "true")]
    assert r.top_level_fields("{}") == []


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_classes_cover_every_byte(text):
    assert sum(r.byte_classes(text).values()) == len(text.encode())


def test_classes():
    got = r.byte_classes('{"a": "b\\"c", "n": -1.5e3, "t": true}\n')
    assert got["field_name"] == 9 and got["string_value"] == 6 and got["number_value"] == 6 and got["literal_value"] == 4
    assert r.byte_classes('"open\nstring') == {**dict.fromkeys(r.CLASSES, 0), "string_value": 12}


def test_move_to_front():
    assert r.move_to_front(bytes([1, 1, 2, 1])).tolist() == [0, 0, 1, 1]
    assert r.move_to_front(b"").tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80) | st.lists(st.sampled_from([3, 9, 200]), max_size=60).map(bytes))
def test_move_to_front_by_lists(data):
    order, want = sorted(set(data)), []
    for c in data:
        want.append(order.index(c))
        order.insert(0, order.pop(want[-1]))
    assert r.move_to_front(data).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=60).map(str.encode))
def test_repeats_by_dictionary(data):
    last, seeds = {}, []
    for i in range(len(data) - 7):
        if i - last.get(data[i : i + 8], -(1 << 20)) <= 1 << 16:
            seeds.append(i)
        last[data[i : i + 8]] = i
    covered = {j for i in seeds for j in range(i, i + 8)}
    assert r.repeats(data) == (max(0, len(data) - 7), len(seeds), len(covered) if seeds else None)


def test_grammar():
    assert r.repair_grammar([1, 2, 1, 2, 1, 2]) == (2, 2)  # 12 -> X, then XX -> Y once: XXX has one pair without overlap
    assert r.repair_grammar([]) == (0, 0) and r.repair_grammar([1, 2, 3]) == (0, 3)


def residual_commands(data):
    """(zeros, bytes) of every command, from the runs of zeros and of other bytes."""
    out, literal = [], b""

    def put(part):
        out.extend((False, part[i : i + 128]) for i in range(0, len(part), 128))

    for zero, run in groupby(data, key=lambda v: v == 0):
        run = bytes(run)
        if not zero or len(run) == 1:
            literal += run
            continue
        put(literal)
        whole, rest = divmod(len(run), 128)
        out += [(True, bytes(128))] * whole + [(True, bytes(rest))] * (rest > 1)
        literal = bytes(rest == 1)
    put(literal)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 7]), st.integers(1, 140)), max_size=8))
def test_residual_sizes(runs):
    data = b"".join(bytes([v]) * n for v, n in runs)
    commands = residual_commands(data)
    assert b"".join(part for _, part in commands) == data and all(len(part) <= 128 for _, part in commands)
    assert r.residual_size(data) == sum(1 if zeros else 1 + len(part) for zeros, part in commands)


def test_residual_sizes_of_single_zeros():
    assert [r.residual_size(x) for x in (b"", b"\0", b"\0\0", b"\0" + b"\7" * 50, b"\7\0\7", bytes(129), bytes(130), bytes(129) + b"\7")] == [0, 2, 1, 52, 4, 3, 2, 4]


def test_splices(spark):
    df = spark.createDataFrame([(1, "abc-1-xyz\nabc-22-xyz\r\nq")], "k long, t string")
    rows = r.splice_residuals(df, "k", "t").orderBy("rec_no").collect()
    # "abc-22-xyz\r\n" shares "abc-" and the line feed with "abc-1-xyz\n": a middle of 7 bytes and its counts are 11, the line 14
    assert [(x.prefix, x.suffix, x.spliced, x.n_bytes) for x in rows] == [(0, 0, False, 12), (4, 1, True, 11), (0, 0, False, 3)]


def test_slots_collide(spark):
    df = spark.createDataFrame([(1, "aaaa\n" + "b" * 1028 + "\naaaa\naaaa")], "k long, t string")
    assert [x.referenced for x in r.slot_references(df, "k", "t").orderBy("rec_no").collect()] == [False, False, False, True]


def test_templates():
    rows = r.wiki_templates("Vor {{Ort|lage= am See |karte=[[Bild|rechts]]|höhe={{m|wert=412|über={{NN}}}}|letzte}} nach")
    got = {(t, p): v for _, _, _, t, p, _, v in rows}
    assert got["Ort", "lage"] == " am See " and got["Ort", "karte"] == "[[Bild|rechts]]" and got["m", "wert"] == "412" and got["NN", ""] == "" and got["Ort", "4"] == "letzte"
    assert r.wiki_templates("{{offen|a") == [] and r.wiki_templates("") == []


def test_numeric_blocks():
    assert r.block_mode([i * 0.25 for i in range(64)])[0] in ("decimal", "planes")
    assert r.block_mode([float("nan")] * 3)[1] <= 24 and r.block_mode([-0.0])[1] <= 8
    assert r.gorilla_bits([1.0, 1.0, 1.0]) == 66


@pytest.mark.parametrize("size", [0, 1, 5000, 400_000])
def test_windows_change_no_size(size):
    import lzma
    import random

    data = bytes(random.Random(size).choices(b"abcdefgh ", k=size))
    for preset in r.LZMA_WINDOWS:
        assert r.codec_sizes(data)[f"lzma-{preset}"] == len(lzma.compress(data, preset=preset))


def test_texts_with_nulls_and_extremes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (3, "x")], "doc_id long, text string")
    assert r.shred_json(df, "doc_id", "text").count() == 2
    assert r.splice_residuals(df, "doc_id", "text").count() == 2
    assert r.text_codec_sizes(df, "doc_id", "text").filter("codec = 'store'").count() == 3
    assert r.mtf_ranks(df.limit(0), "doc_id", "text").count() == 0


def naive_grammar(symbols, rules):
    made, fresh = 0, max(symbols, default=0) + 1
    while made < rules:
        counts = {}
        for pair in zip(symbols, symbols[1:]):
            counts[pair] = counts.get(pair, 0) + 1
        pair = min(counts, key=lambda p: (-counts[p], p), default=None)
        if pair is None or counts[pair] < 2:
            break
        out, i = [], 0
        while i < len(symbols):
            hit = tuple(symbols[i : i + 2]) == pair
            out.append(fresh if hit else symbols[i])
            i += 2 if hit else 1
        symbols, fresh, made = out, fresh + 1, made + 1
    return made, len(symbols)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.sampled_from([1, 5, 1 << 15]))
def test_grammars_equal_rescans(symbols, rules):
    assert r.repair_grammar(symbols, rules) == naive_grammar(symbols, rules)


def test_grammars_are_not_cut_at_few_rules():
    text = b"".join(b"%d:%d;" % (i % 37, i % 11) for i in range(400))
    assert r.repair_grammar(list(text)) == naive_grammar(list(text), 1 << 15) and r.repair_grammar(list(text))[0] > 16


def test_dictionaries_pool_the_texts_of_a_source(spark):
    long = " ".join(f"name_{i:04d}_long" for i in range(60))
    df = spark.createDataFrame([("s", long)] * 4 + [("t", long)] * 3 + [("wikitext-dump", "it's it's"), ("wikitext-dump", "it's it's"), ("s", None), (None, long)], "source string, text string")
    got = r.source_dictionaries(df).collect()
    assert sorted(x.token for x in got if x.source == "s") == sorted(set(long.split()))
    assert not [x for x in got if x.source == "t"]  # three uses are too few
    wiki = {x.token: (x.n, x.gain) for x in got if x.source == "wikitext-dump"}
    assert set(wiki) == {*r.WIKI_MARKUP, "it's"} and wiki["it's"] == (4, 3)


def test_packing_passes_over_what_does_not_fit():
    assert r.pack_entries([("a", 5), ("b", 9), ("c", 4)], 0, max_bytes=11) == ["a", "c"]
    assert r.pack_entries([("a", 1), ("b", 1), ("c", 1)], 0, max_entries=2) == ["a", "b"]


def test_id_overlay_is_the_union_of_both_marks(spark, tmp_path):
    from tallyloom.queries.streams_of_records import book

    texts = {1: "deadbeefdeadbeef", 2: "zz deadbeefdeadbeefzz", 3: "Session0Identifier99", 4: "abcdefghijklmnopqrstuvwxyz", 5: "short1 99", 6: "x" * 19 + "1 0123456789012345678901"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.n_bytes for x in book.queries["o04_id_overlay"](spark, str(tmp_path)).collect()}
    assert got == {1: 16, 2: 16, 3: 20, 4: 0, 5: 0, 6: 42}


@given(st.lists(st.lists(st.text("ab,;\x00é", max_size=5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_columns_round_trip(rows):
    data = "\n".join(";".join(x) for x in rows).encode()
    assert r.rows_of_columns(r.columns_of(data, b";"), b";") == data


def test_a_column_backend_can_win():
    table = "\n".join(f"{i * 7919 % 1000},{'north' if i % 3 else 'south'},{i}" for i in range(400)).encode()
    backend, level, _, size = r.table_backend(table)
    assert backend == "column" and level == 9 and size < len(table)
    assert r.table_backend(b"") == ("store", 0, "direct or ambiguous", 0)
    assert r.table_backend(b"x,y")[0] == "store"


def test_identifier_ranks():
    got = r.identifier_ranks("def f(a): return b + a\nf(b)")
    assert [x[1:] for x in got] == [(0, True, -1), (1, True, -1), (2, True, -1), (1, False, 1), (0, False, 2), (2, False, 2)]


def test_predictor_bits():
    from math import log2

    data = [(97, 3), (49, 4), (97, 3)]
    alone, mixed = r.predictor_bits(data, {}, 256)
    p = [0.5 / 128, 0.5 / 129, 1.5 / 130]
    assert abs(alone + sum(map(log2, p))) < 1e-9
    assert abs(mixed + sum(log2(0.25 * a + 0.75 * b) for a, b in zip(p, [0.5 / 128] * 3))) < 1e-9


def test_token_predictors_gain_where_tokens_repeat(spark):
    text = " ".join(f"identifier_{i % 40:03d}" for i in range(400))
    d = spark.createDataFrame([(i, "s", text) for i in range(300)] + [(999, "s", None), (1000, "s", "")], "doc_id long, source string, text string")
    dictionaries, weights = r.source_dictionaries(d), r.byte_totals(d, "source", "text")
    got = {x.variant: x for x in r.projected_gains(r.predictor_rows(d, dictionaries, weights), dictionaries, weights).collect()}
    assert got["P0"].gain == 0 and got["P0"].n_texts == 300 and got["P2"].gain > got["P1"].gain > 0
