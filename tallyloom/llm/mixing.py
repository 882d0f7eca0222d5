"""Mixes of documents whose sources meet target shares, by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged, table
from .corpus_encoding import count_tokens

SEED = 20_260_103
SLICES = 4096  # hash slices by which documents are selected
BROADCAST_ROUTES, SALTS = 20_000, 64
MOST_PATTERNS = 100_000  # membership patterns that the driver routes


class Flow:
    """Min-cost flow with integer capacities by successive shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            far, via, queued, queue = {source: 0}, {}, {source}, deque([source])
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and far[x] + self.cost[e] < far.get(y, 1 << 62):
                        far[y], via[y] = far[x] + self.cost[e], e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if sink not in far:
                return
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most


def route_mix(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[int, int]]) -> dict[tuple[tuple[str, ...], str], int]:
    """(pattern, source) -> tokens: how many tokens of documents that belong to all sources of ``pattern`` go to which
    source's quota. ``patterns`` has the tokens of each pattern, ``targets`` (quota, max_repeats) of each source.

    The r-th repetition of a pattern's tokens costs r - 1, so repetition is convex and falls first on what is plentiful;
    a source without enough tokens gets all it can, and its shortfall goes to no other source."""
    names = sorted(targets)
    live = [p for p in sorted(patterns) if patterns[p] > 0 and any(s in targets for s in p)]
    flow = Flow(2 + len(live) + len(names))
    at = {s: 2 + len(live) + i for i, s in enumerate(names)}
    arcs = {}
    for i, p in enumerate(live):
        members = [s for s in p if s in targets]
        for r in range(max((targets[s][1] for s in members), default=0)):
            flow.arc(0, 2 + i, patterns[p], r)
        for s in members:
            arcs[p, s] = flow.arc(2 + i, at[s], patterns[p] * targets[s][1], 0)
    for s in names:
        flow.arc(at[s], 1, targets[s][0], 0)
    flow.run(0, 1)
    return {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1] > 0}


def membership(sources: Column, listed: list[str]) -> Column:
    """A document's pattern: its sources, as far as any mix lists them."""
    return F.array_sort(F.array_intersect(F.array_compact(F.coalesce(sources, F.array().cast("array<string>"))), F.array(*[F.lit(s) for s in listed]).cast("array<string>")))


def listed_sources(targets: DataFrame) -> list[str]:
    return sorted(r["source"] for r in targets.select("source").distinct().collect() if r["source"] is not None)


def plan_mixes(sized: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan: mix_id, source, target_share, max_repeats, quota, capacity, tokens, share) and
    (routes: mix_id, pattern, source, tokens, before).

    ``sized``: sources (array), tokens per document. ``targets``: mix_id, source, target_share, max_repeats, size_ratio.
    Documents are reduced to their membership patterns among the listed sources by one aggregate; only patterns (at most
    MOST_PATTERNS, which is checked) and the target rows reach the driver. Documents without tokens or with a null source count for the size
    only by their tokens and are in no source. A source listed twice in a mix counts by its last row; null targets and
    negative shares count as 0, null repeats as 1. A mix of an empty corpus is empty.
    """
    spark = sized.sparkSession
    by_pattern = sized.groupBy(membership(F.col("sources"), listed_sources(targets)).alias("pattern")).agg(F.sum("tokens").alias("tokens"))
    found = by_pattern.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r["pattern"] or ()): int(r["tokens"] or 0) for r in found}
    total = sum(patterns.values())
    mixes: dict[str, dict] = {}
    for r in targets.select("mix_id", "source", "target_share", "max_repeats", "size_ratio").orderBy("mix_id", "source").collect():
        mixes.setdefault(r["mix_id"], {})[r["source"]] = (max(r["target_share"] or 0.0, 0.0), int(r["max_repeats"] if r["max_repeats"] is not None else 1), r["size_ratio"] or 0.0)
    plan, routes = [], []
    for mix, rows in mixes.items():
        quotas = {s: (round(share * ratio * total), repeats) for s, (share, repeats, ratio) in rows.items() if s is not None}
        routed = route_mix(patterns, quotas)
        got = {s: sum(v for (_, to), v in routed.items() if to == s) for s in rows}
        before: dict = {}
        for (p, s), tokens in sorted(routed.items()):
            routes.append((mix, list(p), s, tokens, patterns[p], before.get(p, 0)))
            before[p] = before.get(p, 0) + tokens
        for s, (share, repeats, _) in rows.items():
            capacity = sum(t for p, t in patterns.items() if s in p) * repeats
            plan.append((mix, s, share, repeats, quotas.get(s, (0, 0))[0], capacity, got[s], got[s] / max(sum(got.values()), 1)))
    a = spark.createDataFrame(plan, "mix_id string, source string, target_share double, max_repeats bigint, quota bigint, capacity bigint, tokens bigint, share double")
    b = spark.createDataFrame(routes, "mix_id string, pattern array<string>, source string, tokens bigint, held bigint, before bigint")
    return a, b


def select_documents(sized: DataFrame, routes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_id, source, key, tokens, repeats): the documents of each mix and how often each is taken.

    A route of T tokens over a pattern that holds H takes every document floor(T / H) times and, of a seeded order, the
    first documents that fit the rest once more. The order is by hash: token sums of SLICES hash slices are compared
    with the rest first, and only the one slice in which it ends is ordered by document, so no group of documents is
    ever sorted as a whole, however many a source holds. ``routes`` has a row per mix, pattern and source; up to
    BROADCAST_ROUTES of them are broadcast, more meet the documents of their pattern dealt over SALTS tasks. Where a pattern serves several sources of a mix, each has its own order.
    """
    d = sized.select("key", "tokens", membership(F.col("sources"), listed_sources(targets)).alias("pattern")).filter("tokens > 0")
    r = routes.select("mix_id", "pattern", "source", F.expr("tokens div held").alias("rounds"), F.expr("tokens % held").alias("rest"))
    r = F.broadcast(r) if r.count() <= BROADCAST_ROUTES else r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d if "_salt" not in r.columns else d.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    h = F.xxhash64(F.lit(seed), "mix_id", "source", "key")
    met = staged(d.join(r, [c for c in ("pattern", "_salt") if c in r.columns]).drop("_salt").withColumn("h", h).withColumn("slice", F.pmod("h", F.lit(SLICES))), "mix-documents")
    slices = met.groupBy("mix_id", "pattern", "source", "slice").agg(F.sum("tokens").alias("in_slice"))
    upto = F.sum("in_slice").over(Window.partitionBy("mix_id", "pattern", "source").orderBy("slice"))
    slices = slices.withColumn("slice_before", upto - F.col("in_slice"))
    placed = met.join(slices, ["mix_id", "pattern", "source", "slice"])
    whole = F.col("slice_before") + F.col("in_slice") <= F.col("rest")
    ends = placed.filter(~whole & (F.col("slice_before") < F.col("rest")))
    run = F.sum("tokens").over(Window.partitionBy("mix_id", "pattern", "source").orderBy("h", "key"))
    extra = placed.filter(whole | (F.col("slice_before") >= F.col("rest"))).withColumn("extra", whole.cast("bigint"))
    extra = extra.unionByName(ends.withColumn("extra", (F.col("slice_before") + run <= F.col("rest")).cast("bigint")))
    taken = extra.withColumn("repeats", F.col("rounds") + F.col("extra")).filter("repeats > 0")
    return taken.select("mix_id", "source", "key", "tokens", "repeats")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    counted = count_tokens(docs, "doc", "text").select(F.col("doc.doc_id").alias("key"), F.array("doc.source").alias("sources"), "tokens")
    return staged(counted, "sized-documents")


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with what its source can give and what it got."""
    return plan_mixes(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_plan(spark, sf_dir).filter("tokens < quota").select("mix_id", "source")


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets")
    return select_documents(sized, plan_mixes(sized, targets)[1], targets).withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the selected documents give each source."""
    got = p9_selection(spark, sf_dir).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    return got.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix_id")))


def p9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts that occur in several sources go: each distinct text once, a member of all sources that hold it, and
    for each mix, pattern of sources and source the tokens routed there."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL")
    texts = docs.groupBy(F.md5("text").alias("key")).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.any_value("text").alias("text"))
    sized = count_tokens(texts.select(F.struct("key", "sources").alias("doc"), "text"), "doc", "text").select("doc.key", "doc.sources", "tokens")
    routes = plan_mixes(staged(sized, "sized-texts"), table(spark, sf_dir, "mix_targets"))[1]
    return routes.select("mix_id", F.array_join("pattern", "+").alias("pattern"), "source", "held", "tokens")


QUERIES = {"p9_overlap": p9_overlap, "p9_found": p9_found, "p9_plan": p9_plan, "p9_selection": p9_selection, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
