import random

from tallyloom.llm import truncation as t


def corpus():
    rng = random.Random(9)
    name = lambda: "".join(rng.choice(("ka", "lo", "mi", "zu", "fe")) for _ in range(3))
    frames = ["The {} arm finished in {} ms and kept its memory.", "Nobody repeats the {} trial before round {} is over.", "After the warmup of {} all {} segments are read again.", "Why does {} expand under level {}?"]
    whole = [" ".join(rng.choice(frames).format(name(), rng.randint(1, 9999)) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return rng, whole


def found(spark, rows):
    return {r.digest for r in t.find_truncated(spark.createDataFrame(rows, "source string, text string, digest string")).collect()}


def md5(text):
    import hashlib

    return hashlib.md5(text.encode()).digest()


def test_cuts_inside_sentences(spark):
    rng, whole = corpus()
    cut = []
    for _ in range(200):
        w = rng.choice(whole)
        at = rng.randint(len(w) // 2, len(w) - 4)
        if w[at - 1] not in ".? " and w[at] not in ".?":
            cut.append(w[:at] + rng.choice(("", "…", "...", " [truncated]", "\n")))
    rows = [("s", w, "x") for w in whole] + [("s", c, "x") for c in cut]
    got = found(spark, rows)
    assert len(got & {md5(c) for c in cut}) >= 0.95 * len({md5(c) for c in cut})
    assert len(got - {md5(c) for c in cut}) <= 0.01 * len(whole)


def test_a_common_length_is_no_regular_ending(spark):
    rng, whole = corpus()
    rows = [("s", w, "x") for w in whole] + [("s", w[:120], "x") for w in whole if len(w) > 400]
    cut = {md5(w[:120]) for w in whole if len(w) > 400 and w[119] not in ".? " and w[120] not in ".?"}
    assert len(found(spark, rows) & cut) >= 0.9 * len(cut)


def test_a_small_source_beside_a_large_one(spark):
    """What is enough support follows the texts of a source, so 120 texts of their own kind decide as well."""
    rng, whole = corpus()
    small = [" ".join(f"Item {rng.choice(whole[:9]).split()[1]} was put on shelf {rng.randint(1, 99)} by the clerk." for _ in range(6)) for _ in range(120)]
    cut = [w[: w.rindex("was put") + rng.randint(2, 14)] for w in small[:12]]
    rows = [("large", w, "x") for w in whole] + [("small", w, "x") for w in small[12:] + cut]
    got = found(spark, rows)
    assert len(got & {md5(c) for c in cut}) >= 11 and len(got - {md5(c) for c in cut}) <= 0.01 * len(rows)


def test_one_ending_of_very_many_texts(spark):
    rng, whole = corpus()
    rows = [("s", w + " Signed, the lab desk", "x") for w in whole]
    assert found(spark, rows) == set()


def test_edges(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None, ""), ("s", "", ""), ("s", " \n\t", ""), ("s", "...", ""), (None, "one", ""), ("s", "x" * 100_000, ""), ("s", " " * 50_000 + "x", "")]) == set()
