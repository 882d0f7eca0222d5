import random

import pyarrow as pa

from tallyloom.llm import split_overlap as s


def shingles(words):
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def pairs(spark, records, exact=False):
    members, found = s.overlapping_classes(spark.createDataFrame(records, "key string, train boolean, content string"), exact)
    m = {}
    for r in members.collect():
        m.setdefault(r.cls, []).append((r.key, r.train))
    return {(a, b) for r in found.collect() for a, ta in m[r.train_cls] if ta for b, tb in m[r.other_cls] if not tb}


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    notice = [word() for _ in range(40)]
    records = []
    for i in range(60):
        base = [word() for _ in range(80)]
        if i % 3 == 0:  # a third of all hold the same notice
            base[20:20] = notice
        for k in range(3):
            w = list(base)
            for _ in range(rng.choice((0, 2, 6, 20))):
                w[rng.randrange(len(w))] = word()
            records.append((f"r{i}-{k}", rng.random() < 0.5, " ".join(w).title()))
    sets = {k: shingles(c.lower().split()) for k, _, c in records}
    want = {(a, b) for a, ta, _ in records for b, tb, _ in records if ta and not tb and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = pairs(spark, records)
    assert got <= want and len(got) >= 0.9 * len(want) > 20
    assert pairs(spark, records, exact=True) == want


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.7 * len(a | b)


def test_short_records_and_the_exact_way(spark):
    """Pairs near the limit: one word in twenty differs. Short ones are all found, longer ones at least nine in ten."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    records, want = [], {}
    for n in (20, 40, 60, 80):
        for i in range(120):
            a = [word() for _ in range(n)]
            b = list(a)
            for k in range(n // 20):
                b[20 * k + rng.randrange(20)] = word()
            records += [(f"{n}-{i}-a", True, " ".join(a)), (f"{n}-{i}-b", False, " ".join(b))]
            if similar(a, b):
                want.setdefault(n, set()).add((f"{n}-{i}-a", f"{n}-{i}-b"))
    got = pairs(spark, records)
    for n, of_size in want.items():
        assert len(got & of_size) >= (1.0 if n < s.SHORT else 0.9) * len(of_size) > 10, n
    assert pairs(spark, records, exact=True) == set().union(*want.values())


def with_notice(n_records, own, notice, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(notice)]
    return [(f"r{i}", i % 2 == 0, " ".join([word() for _ in range(own)] + shared)) for i in range(n_records)]


def test_notices_make_no_pairs_of_each_two(spark):
    """A notice of 40 and one of 75 words of 100 in every record: no candidates once its parts are hot."""
    for own, notice in ((60, 40), (25, 75)):
        for n in (1200, 2400):
            df = spark.createDataFrame(with_notice(n, own, notice), "key string, train boolean, content string")
            _, classes = s.record_classes(df)
            assert s.candidates(classes, exact=False).count() <= n / 100  # equal words by chance
            assert s.candidates(classes, exact=True).count() <= n / 100


def test_what_shares_hot_text_only(spark):
    """A notice that makes up most of each of very many records: all pairs are similar, some with a part of it changed."""
    records = with_notice(440, 3, 60)
    half = [(k, t, " ".join(c.split()[:3] + c.split()[3:33] + c.split()[36:])) if i % 4 == 1 else (k, t, c) for i, (k, t, c) in enumerate(records)]
    sets = {k: c.split() for k, _, c in half}
    want = {(a, b) for a, ta, _ in half for b, tb, _ in half if ta and not tb and similar(sets[a], sets[b])}
    assert len(want) == 220 * 220 and pairs(spark, half) == want


def test_chunks_and_shingle_counts():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("ab", "cde", "f", "gh1")) for _ in range(rng.choice((1, 2, 3, 50, 400)))) for _ in range(200)] + ["", "same " * 300 + "same"]
    for column in (pa.array(texts), pa.array(["pad pad"] + texts)[1:]):
        chunks, n, total = s.chunk_texts(column)
        seen = {}
        for words, found, count, size in zip(map(str.split, texts), chunks.to_pylist(), n.tolist(), total.tolist()):
            assert count == len(shingles(words)) and size == sum(c & 127 for c in found) and len(set(found)) == len(found) and all(1 <= c & 127 <= s.MOST_WORDS for c in found)
            assert size <= len(words) and (size > 0) == bool(words)
            seen.setdefault(" ".join(words), set()).add(tuple(found))
        assert all(len(v) == 1 for v in seen.values())  # equal texts are cut alike wherever they stand
    a, b = s.chunk_texts(pa.array(["x y z " + " ".join(map(str, range(300))), " ".join(map(str, range(300))) + " q"]))[0].to_pylist()
    assert sum(c & 127 for c in set(a) & set(b)) > 280


def test_long_runs_without_cuts(spark):
    run = "same " * 3000
    assert pairs(spark, [("a", True, run), ("b", False, run + "tail"), ("c", False, "other words here")]) == set()
    assert pairs(spark, [("a", True, run + "x"), ("b", False, run * 2 + "x")]) == {("a", "b")}


def test_edges(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [("a", True, None), ("b", False, ""), ("c", True, "one two"), ("d", False, "one two")]) == set()
    assert pairs(spark, [("a", True, "One two-three"), ("b", False, "one TWO three!"), ("c", False, "one two three"), ("d", True, "x y z")]) == {("a", "b"), ("a", "c")}
    long = " ".join(f"w{i}" for i in range(20_000))
    assert pairs(spark, [("a", True, long), ("b", False, long + " tail")]) == {("a", "b")}


def test_digest_pairs_only_for_sha256(spark, tmp_path):
    h = "ab" * 32
    spark.createDataFrame([("i1", "Train ", f"sha256:{h.upper()}", "d", None), ("i2", None, h, "d", None), ("i3", "holdout", h, "d", None)], "id string, split string, sha256 string, dataset string, content string").write.parquet(str(tmp_path / "corpus_items.parquet"))
    spark.createDataFrame([("s1", "validation", "SHA-256", h), ("s2", "validation", "md5", h)], "dataset string, split string, digest_algorithm string, digest string").selectExpr("*", "cast(null as string) content").write.parquet(str(tmp_path / "estimator_sources.parquet"))
    assert {tuple(r) for r in s.p5_found(spark, str(tmp_path)).collect()} == {("i1", "i3"), ("i1", "s1")}
    assert {(r.split, r.n_records, r.n_overlapping) for r in s.p5_splits(spark, str(tmp_path)).collect()} == {("holdout", 1, 1), ("validation", 1, 1)} | {("validation", 1, 0)}
