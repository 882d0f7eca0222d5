"""Same or near-same records across splits, by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import mix64
from ..operators.differences import digest_text
from ..session import staged, table

SHINGLE = 3  # words of a shingle
SIMILAR = 0.7  # least Jaccard similarity of the shingle sets
CUT_MASK, MOST_WORDS = 3, 64  # a cut before every fourth word on average, and at the latest after so many
LEAST_OVERLAP = 0.3  # share of both records, in words, in chunks that both have, from which on they surely meet
LENGTH_BITS = 7  # of a packed chunk: its words, below the upper bits of its digest
PROBED = 200  # classes that may look for each other by one key; with more the key is hot
SHORT = 48  # words below which records have too few chunks to rely on
HOT_SHARE = 10_000  # a key with more than one in so many of all occurrences meets its count by a broadcast; there are fewer than so many
SALTS = 16


def words_of(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9]+"), 0)


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs values[start:end]: sums of values over powers of an odd base, from each run's start on, and the
    runs' lengths, modulo 2**64. Equal runs have equal hashes wherever they stand."""
    def powers_of(factor: int) -> np.ndarray:
        powers = np.full(len(values) + 1, factor, np.uint64)
        powers[0] = 1
        return np.cumprod(powers, dtype=np.uint64)

    upto = np.zeros(len(values) + 1, np.uint64)
    upto[1:] = np.cumsum(values * powers_of(pow(base, -1, 1 << 64))[:-1], dtype=np.uint64)
    powers = powers_of(base)
    return mix64((upto[end] - upto[start]) * powers[start] + (end - start).astype(np.uint64))


def _distinct(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value) in order."""
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (values[1:] != values[:-1])
    return group[fresh], values[fresh]


def chunk_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, n, total) of texts of words with single spaces between them: the distinct chunks of each, every one packed
    into a number of its digest and its words; how many distinct shingles it has; and the words of its chunks.

    A rolling hash of two neighbouring words cuts before the second, so cuts depend on content only and an edit moves
    no cut but its own. A whole batch of texts is hashed and cut at once."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = data == 0x20
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(space) + 1)
    ends = np.union1d(offsets[1:][np.diff(offsets) > 0], np.flatnonzero(space))
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = _sums(data.astype(np.uint64) + np.uint64(1), starts, ends, 0x2545F4914F6CDD1D)
    at = np.arange(len(words))
    cut = np.ones(len(words), bool)
    cut[1:] = (text[1:] != text[:-1]) | (((words[:-1] << np.uint64(1) ^ words[1:]) >> np.uint64(17)) & np.uint64(CUT_MASK) == 0)
    cut |= (at - np.maximum.accumulate(np.where(cut, at, 0))) % MOST_WORDS == 0
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(words))
    low = np.uint64((1 << LENGTH_BITS) - 1)
    packed = ((_sums(words, first, last, 0x9E3779B97F4A7C15) & ~low) | (last - first).astype(np.uint64)).view(np.int64)
    of, chunks = _distinct(text[first], packed)
    ends_of = np.searchsorted(of, np.arange(len(texts) + 1))
    total = np.bincount(of, chunks & int(low), len(texts)).astype(np.int64)
    whole = text[2:] == text[:-2] if len(words) > 2 else np.empty(0, bool)
    shingles = mix64(words[:-2] * np.uint64(0xBF58476D1CE4E5B9) + words[1:-1] * np.uint64(0x94D049BB133111EB) + words[2:])[whole] if len(words) > 2 else np.empty(0, np.uint64)
    of_shingle, _ = _distinct(text[:-2][whole] if len(words) > 2 else np.empty(0, np.int64), shingles)
    n = np.bincount(of_shingle, minlength=len(texts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(chunks)), n, total


def with_chunks(classes: DataFrame) -> DataFrame:
    """``classes`` (cls, text, in_train, in_other) with the columns of ``chunk_texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                chunks, n, total = chunk_texts(b.column(1))
                yield pa.RecordBatch.from_arrays([*b.columns, chunks, pa.array(n), pa.array(total)], ["cls", "text", "in_train", "in_other", "chunks", "n", "total"])

    return classes.select("cls", "text", "in_train", "in_other").mapInArrow(run, "cls binary, text string, in_train boolean, in_other boolean, chunks array<bigint>, n int, total bigint")


def shingles_of(words: Column) -> Column:
    """The distinct hashes of SHINGLE consecutive words; ``words`` has no fewer."""
    at = lambda h, i: [F.element_at(h, i + k) for k in range(SHINGLE)]
    of = lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - SHINGLE + 1), lambda i: F.xxhash64(*at(h, i))))
    return F.transform(F.array(words), of)[0]


def chunk_words(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))


def total_words(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda s, c: s + chunk_words(c))


def rarest_keys(held: DataFrame, classes: DataFrame, least: float, weight: Column, label: str) -> DataFrame:
    """(cls, k, f, before, hot, total, n, in_train, in_other) of the keys of each class that both sides hold, as far as
    they come first in it: how many classes hold the key, and the weight of the class's keys before it and of its hot ones.

    ``held``: cls, in_train, in_other, k. ``classes``: cls, total, n, in_train, in_other. The keys of a class go from
    those that one side only holds, which no pair shares, over the rare to the frequent ones. Two classes that have keys
    of at least ``least`` of both totals in common share one that has, in both, no more than 1 - ``least`` of the total
    before it; only these are kept. Very frequent keys meet their counts by a broadcast of at most HOT_SHARE rows, others
    by a shuffle in which no key is hot."""
    counts = held.groupBy("k").agg(F.count("*").alias("f"), F.bool_or("in_train").alias("t"), F.bool_or("in_other").alias("o"))
    counts = staged(counts.filter("f > 1 AND t AND o").select("k", "f"), f"{label}-counts")
    total = counts.agg(F.sum("f")).first()[0] or 0
    heavy = F.broadcast(counts.filter(F.col("f") * HOT_SHARE > total))
    keys = held.select("cls", "k")
    met = keys.join(heavy, "k").unionByName(keys.join(heavy.select("k"), "k", "left_anti").join(counts.filter(F.col("f") * HOT_SHARE <= total), "k"))
    placed = met.withColumn("w", weight.cast("bigint")).join(classes, "cls")
    of_class = Window.partitionBy("cls")
    rarer = of_class.orderBy("f", "k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("total") - F.sum("w").over(of_class) + F.coalesce(F.sum("w").over(rarer), F.lit(0))
    hot = F.coalesce(F.sum(F.when(F.col("f") > PROBED, F.col("w"))).over(of_class), F.lit(0))
    placed = placed.withColumn("before", before).withColumn("hot", hot)
    kept = placed.filter((F.col("before") <= (1 - least) * F.col("total") + 1e-9) | ((F.col("f") > PROBED) & (F.col("hot") >= least * F.col("total") - 1e-9)))
    return staged(kept.drop("w"), f"{label}-rarest")


def _first(rarest: DataFrame, least: float) -> DataFrame:
    return rarest.filter(F.col("before") <= (1 - least) * F.col("total") + 1e-9)


def _sizes_fit(a: str, b: str) -> Column:
    return (F.col(a) >= SIMILAR * F.col(b) - 1e-9) & (F.col(b) >= SIMILAR * F.col(a) - 1e-9)


def _meet(probes: DataFrame) -> DataFrame:
    """(train_cls, other_cls) of classes that share a probe and have sizes a similar pair can have."""
    a = probes.filter("in_train").select("k", F.col("cls").alias("train_cls"), F.col("n").alias("n_a"))
    b = probes.filter("in_other").select("k", F.col("cls").alias("other_cls"), F.col("n").alias("n_b"))
    return a.join(b, "k").filter(_sizes_fit("n_a", "n_b") & (F.col("train_cls") != F.col("other_cls"))).select("train_cls", "other_cls").distinct()


def expand(pairs: DataFrame, members: DataFrame, on: list[str], name: str, each: str) -> DataFrame:
    """``pairs`` with each of its side's members as ``name``. A hot side is dealt over SALTS tasks by its members, each
    of which meets a copy of the pair."""
    dealt = members.select(*on, F.col(each).alias(name), F.pmod(F.xxhash64(each), F.lit(SALTS)).cast("int").alias("_salt"))
    return pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(dealt, [*on, "_salt"]).drop("_salt", *on)


def _hot_pairs(rarest: DataFrame) -> DataFrame:
    """(train_cls, other_cls) of similar classes that share no shingle but hot ones.

    In such a class the shingles that aren't hot are at most 1 - SIMILAR of all, or the pair couldn't be similar. Classes
    with equal hot shingles are one profile, so a notice in any number of records is one profile, not a pair of each two.
    Profiles are compared with each other by the same first keys; a pair of profiles and two sizes fixes the similarity,
    so classes are taken together by profile and size and only true pairs are expanded."""
    within = rarest.filter((F.col("f") > PROBED) & (F.col("hot") >= SIMILAR * F.col("total") - 1e-9))
    of_class = within.groupBy("cls", "n", "in_train", "in_other").agg(F.array_sort(F.collect_set("k")).alias("keys"))
    of_class = staged(of_class.withColumn("profile", F.xxhash64("keys")), "p5-profiled")
    profiles = of_class.groupBy("profile").agg(F.any_value("keys").alias("keys"), F.bool_or("in_train").alias("in_train"), F.bool_or("in_other").alias("in_other"))
    profiles = staged(profiles.withColumn("n", F.size("keys")), "p5-profiles")
    held = profiles.select(F.col("profile").alias("cls"), "in_train", "in_other", F.explode("keys").alias("k"))
    known = profiles.select(F.col("profile").alias("cls"), F.col("n").cast("bigint").alias("total"), "n", "in_train", "in_other")
    met = _meet(_first(rarest_keys(held, known, SIMILAR, F.lit(1), "p5-profile"), SIMILAR))
    keys = lambda side: profiles.select(F.col("profile").alias(f"{side}_cls"), F.col("keys").alias(f"{side}_keys"))
    unlike = met.join(keys("train"), "train_cls").join(keys("other"), "other_cls").select(F.col("train_cls").alias("p"), F.col("other_cls").alias("q"), F.size(F.array_intersect("train_keys", "other_keys")).alias("shared"))
    alike = profiles.filter("in_train AND in_other").select(F.col("profile").alias("p"), F.col("profile").alias("q"), F.col("n").alias("shared"))
    sized = of_class.groupBy("profile", "n").agg(F.bool_or("in_train").alias("in_train"), F.bool_or("in_other").alias("in_other"))
    a = sized.filter("in_train").select(F.col("profile").alias("p"), F.col("n").alias("n_a"))
    b = sized.filter("in_other").select(F.col("profile").alias("q"), F.col("n").alias("n_b"))
    fits = F.col("shared") >= SIMILAR * (F.col("n_a") + F.col("n_b") - F.col("shared")) - 1e-9
    near = unlike.unionByName(alike).join(a, "p").join(b, "q").filter(fits).select("p", "n_a", "q", "n_b")
    train = of_class.filter("in_train").select(F.col("profile").alias("p"), F.col("n").alias("n_a"), "cls")
    other = of_class.filter("in_other").select(F.col("profile").alias("q"), F.col("n").alias("n_b"), "cls")
    return expand(expand(near, train, ["p", "n_a"], "train_cls", "cls"), other, ["q", "n_b"], "other_cls", "cls").filter("train_cls <> other_cls").distinct()


def record_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: cls, key, train) and (classes: cls, text, in_train, in_other, chunks, n, total): records of equal words
    as one class, with its chunks, their words and the number of its shingles. Staged."""
    r = records.select("key", "train", words_of(F.coalesce("content", F.lit(""))).alias("words")).filter(F.size("words") >= SHINGLE)
    r = staged(r.select("key", "train", F.concat_ws(" ", "words").alias("text")).withColumn("cls", F.unhex(F.md5("text"))), "p5-records")
    members = r.select("cls", "key", "train")
    grouped = r.groupBy("cls").agg(F.any_value("text").alias("text"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_other"))
    return members, staged(with_chunks(grouped), "p5-classes")


def candidates(classes: DataFrame, exact: bool) -> DataFrame:
    """(train_cls, other_cls) of the classes to compare; see ``overlapping_classes``."""
    words = F.split("text", " ")
    held = classes.select("cls", "in_train", "in_other", F.explode("chunks").alias("k"))
    known = classes.select("cls", "total", "n", "in_train", "in_other")
    by_chunk = rarest_keys(held, known, LEAST_OVERLAP, chunk_words(F.col("k")), "p5-chunk")
    met = _meet(_first(by_chunk, LEAST_OVERLAP).filter(F.col("f") <= PROBED))

    unsure = classes
    if not exact:
        hot = by_chunk.filter((F.col("f") > PROBED) & (F.col("hot") >= LEAST_OVERLAP * F.col("total") - 1e-9)).select("cls").distinct().withColumn("_hot", F.lit(True))
        unsure = classes.join(hot, "cls", "left").filter((F.col("n") <= SHORT / SIMILAR) | F.col("_hot"))
    unsure = staged(unsure.select("cls", "in_train", "in_other", "n", shingles_of(words).alias("shingles")), "p5-unsure")
    held = unsure.select("cls", "in_train", "in_other", F.explode("shingles").alias("k"))
    by_shingle = rarest_keys(held, unsure.select("cls", F.col("n").cast("bigint").alias("total"), "n", "in_train", "in_other"), SIMILAR, F.lit(1), "p5-shingle")
    return met.unionByName(_meet(_first(by_shingle, SIMILAR).filter(F.col("f") <= PROBED))).unionByName(_hot_pairs(by_shingle)).distinct()


def overlapping_classes(records: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of equal content and their near-same pairs across the two sides.

    ``records``: key, train (boolean), content. Returns (members: cls, key, train) and (pairs: train_cls, other_cls,
    overlap_train, overlap_other, similarity), where a pair joins a class with members in training to one with members
    outside it; a class with both is paired with itself. Records with fewer than SHINGLE words, null or empty content
    have no shingles and are in no pair.

    Copies collapse into classes before anything is compared. A record's chunks are a set, weighted by their words, as
    its shingles are a set. Each class looks for partners by its rarest chunks (``rarest_keys``), and never by a hot
    one, so the joined rows are at most PROBED times the chunks. What may share hot chunks only, and records of fewer
    than SHORT words, look for partners by their rarest shingles instead, which misses no similar pair; of these, too,
    no hot one is a probe (``_hot_pairs`` has the rest). Shared chunk lengths are summed into overlap fractions for every
    candidate, and shingles decide.

    The chunk way is exact for pairs with LEAST_OVERLAP of both in equal chunks, which short similar records may not
    reach; with ``exact`` all classes look by shingles as well, which finds every similar pair."""
    members, classes = record_classes(records)
    met = staged(candidates(classes, exact), "p5-candidates")
    # What takes part in a pair is mostly far less than all; its texts meet the pairs from a table of their own.
    part = met.select(F.explode(F.array("train_cls", "other_cls")).alias("cls")).distinct()
    compared = staged(classes.select("cls", "text", "chunks", "total").join(staged(part, "p5-part"), "cls", "left_semi"), "p5-compared")
    side = lambda x, name: compared.select(F.col("cls").alias(name), F.col("chunks").alias(f"{x}_chunks"), F.col("text").alias(f"{x}_text"), F.col("total").alias(f"{x}_words"))
    both = met.join(side("a", "train_cls"), "train_cls").join(side("b", "other_cls"), "other_cls")
    shared = total_words(F.array_intersect("a_chunks", "b_chunks"))
    both = both.withColumn("overlap_train", shared / F.col("a_words")).withColumn("overlap_other", shared / F.col("b_words"))
    both = both.withColumn("a_shingles", shingles_of(F.split("a_text", " "))).withColumn("b_shingles", shingles_of(F.split("b_text", " ")))
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    near = both.withColumn("similarity", common / (F.size("a_shingles") + F.size("b_shingles") - common)).filter(F.col("similarity") >= SIMILAR - 1e-12)
    one = F.lit(1.0)
    same = classes.filter("in_train AND in_other").select(F.col("cls").alias("train_cls"), F.col("cls").alias("other_cls"), one.alias("overlap_train"), one.alias("overlap_other"), one.alias("similarity"))
    return members, near.select(*same.columns).unionByName(same)


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, origin, split, dataset, train, digest, content) of both tables; rows without a split are left out."""
    split = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    sha = lambda c: F.when(digest_text(c).rlike("^[0-9a-f]{64}$"), digest_text(c))
    items = table(spark, sf_dir, "corpus_items").select(F.col("id").alias("key"), F.lit("corpus_items").alias("origin"), split(F.col("split")).alias("split"), "dataset", sha(F.col("sha256")).alias("digest"), "content")
    named = F.regexp_replace(F.lower("digest_algorithm"), "[^a-z0-9]", "")
    sources = table(spark, sf_dir, "estimator_sources").select(
        F.col("dataset").alias("key"), F.lit("estimator_sources").alias("origin"), split(F.col("split")).alias("split"), "dataset",
        F.when(named.isNull() | (named == "sha256"), sha(F.col("digest"))).alias("digest"), "content",
    )
    both = items.unionByName(sources).filter("key IS NOT NULL AND split <> ''")
    return both.withColumn("train", F.col("split") == "train")


def _record_pairs(pairs: DataFrame, members: DataFrame, train: str, other: str, on: str) -> DataFrame:
    """(train_key, other_key): every record of one side with every one of the other."""
    first = expand(pairs, members.filter("train").withColumnRenamed(on, train), [train], "train_key", "key")
    return expand(first, members.filter("NOT train").withColumnRenamed(on, other), [other], "other_key", "key")


def _pairs(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    records = split_records(spark, sf_dir)
    members, pairs = overlapping_classes(records, exact)
    near = _record_pairs(pairs.select("train_cls", "other_cls"), members, "train_cls", "other_cls", "cls")
    digests = records.filter("digest IS NOT NULL").select("digest", "key", "train")
    both = digests.groupBy("digest").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("o")).filter("t AND o")
    same = _record_pairs(both.select(F.col("digest").alias("train_digest"), F.col("digest").alias("other_digest")), digests, "train_digest", "other_digest", "digest")
    every = near.unionByName(same).filter("train_key <> other_key")
    return every.select(F.least("train_key", "other_key").alias("record_a"), F.greatest("train_key", "other_key").alias("record_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records; records of equal content or digest are expanded, as the result is one row per pair."""
    return _pairs(spark, sf_dir, False)


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, with all records looking for partners by shingles as well as by chunks."""
    return _pairs(spark, sf_dir, True)


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and dataset: records outside training, and how many of them also occur in training by
    content or by digest. Counted by class; no pairs are expanded."""
    records = split_records(spark, sf_dir)
    members, pairs = overlapping_classes(records)
    near = members.filter("NOT train").join(pairs.select(F.col("other_cls").alias("cls")).distinct(), "cls", "left_semi").select("key")
    d = records.filter("digest IS NOT NULL")
    same = d.filter("NOT train").join(d.filter("train").select("digest").distinct(), "digest", "left_semi").select("key")
    found = near.unionByName(same).distinct().withColumn("found", F.lit(1))
    outside = records.filter("NOT train").select("key", "split", "dataset", "origin")
    return outside.join(found, "key", "left").groupBy("origin", "split", "dataset").agg(F.count("*").alias("n_records"), F.count("found").alias("n_overlapping"))


_SQL = """
WITH r AS (
  SELECT id AS k, 'corpus_items' AS origin, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS s, dataset, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS w,
    regexp_extract(lower(sha256), '[0-9a-f]{64}\\s*$') AS d FROM corpus_items
  UNION ALL
  SELECT dataset, 'estimator_sources', lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')), dataset, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'),
    CASE WHEN regexp_replace(lower(digest_algorithm), '[^a-z0-9]', '', 'g') = 'sha256' THEN regexp_extract(lower(digest), '[0-9a-f]{64}\\s*$') END FROM estimator_sources),
q AS (SELECT k, origin, s, dataset, w, trim(d, E' \\n\\t\\r') AS d FROM r WHERE s <> ''),
g AS (SELECT DISTINCT k, s, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, s, w, unnest(range(1, len(w) - 1)) AS i FROM q)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
m AS (SELECT a.k AS ka, b.k AS kb, count(*) AS m FROM g a JOIN g b USING (g) WHERE a.s = 'train' AND b.s <> 'train' GROUP BY ALL),
p AS (SELECT ka, kb FROM m JOIN n na ON na.k = ka JOIN n nb ON nb.k = kb WHERE m >= 0.7 * (na.n + nb.n - m)
      UNION SELECT a.k, b.k FROM q a JOIN q b USING (d) WHERE d <> '' AND a.s = 'train' AND b.s <> 'train')
"""
QUERIES = {"p5_found": p5_found, "p5_exact": p5_exact, "p5_splits": p5_splits}
ORACLES = {
    **dict.fromkeys(("p5_found", "p5_exact"), _SQL + "SELECT DISTINCT least(ka, kb) AS record_a, greatest(ka, kb) AS record_b FROM p"),
    "p5_splits": _SQL + "SELECT origin, s AS split, dataset, count(*) AS n_records, count_if(k IN (SELECT kb FROM p)) AS n_overlapping FROM q WHERE s <> 'train' GROUP BY ALL",
}
