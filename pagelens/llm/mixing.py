"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas.

Texts that stand in several sources can serve any of them. Texts are therefore grouped by membership
pattern – the set of target sources that hold the text – and only tokens per pattern go to the
driver. There a min-cost flow routes token capacity from patterns to source quotas; using a pattern's
texts a first time costs nothing, a second time 1 a token, a third time 2, and so on, so repetition is
spent where it is needed. The flow's amounts then select documents: texts of a pattern line up in
seeded order, as often as they are repeated, and each source takes its stretch of that line.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.runtime import collect_small, durable

#: Vocabulary file of a public tokenizer (ranks of byte pairs).
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public splitting pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SOURCES = 10_000
#: Distinct membership patterns that occur; their number depends on the sources, not on the documents.
MAX_PATTERNS = 50_000
#: Texts of one hash bucket of a pattern's line.
BUCKET_TEXTS = 50_000

_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    key = (path, pattern)
    if key not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def sizes(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, n_tokens and text_id (a 128-bit hash of the whole text) of every document; null texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "text_id", "n_tokens"])

    rows = documents.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, text_id string, n_tokens long")


class Flow:
    """Maximum flow by blocking flows over shortest paths (Dinic); capacities are whole tokens.

    Arcs keep what they carry, so capacity can be added and more be sent. An augmentation never takes
    flow back from an arc that leaves the source; so if only those arcs have costs, sending over the
    cheapest ones first and adding dearer capacity step by step gives a flow of least cost.
    """

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int) -> int:
        self.at[a].append(len(self.to))
        self.at[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.cap += (cap, 0)
        return len(self.to) - 2

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.at)
        level[s], queue = 0, [s]
        for a in queue:
            for e in self.at[a]:
                b = self.to[e]
                if self.cap[e] > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def send(self, s: int, t: int) -> int:
        """Send as much as possible from s to t; the amount."""
        total = 0
        to, cap, at = self.to, self.cap, self.at
        while True:
            level = self._levels(s)
            if level[t] < 0:
                return total
            tried = [0] * len(at)
            path: list[int] = []
            node = s
            while True:
                if node == t:
                    amount = min(cap[e] for e in path)
                    total += amount
                    first = None
                    for i, e in enumerate(path):
                        cap[e] -= amount
                        cap[e ^ 1] += amount
                        if first is None and cap[e] == 0:
                            first = i
                    node = to[path[first] ^ 1]
                    del path[first:]
                    continue
                arcs, i = at[node], tried[node]
                while i < len(arcs) and not (cap[arcs[i]] > 0 and level[to[arcs[i]]] == level[node] + 1):
                    i += 1
                tried[node] = i
                if i < len(arcs):
                    path.append(arcs[i])
                    node = to[arcs[i]]
                elif path:
                    node = to[path.pop() ^ 1]
                    tried[node] += 1
                else:
                    break

    def reached(self, s: int) -> list[bool]:
        """The source's side of a least cut, after :meth:`send`."""
        return [x >= 0 for x in self._levels(s)]


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens from each pattern to each source: (total size, {(pattern, source): tokens}).

    ``patterns`` has the tokens of distinct texts per sorted tuple of sources, ``targets`` the share
    and the repetition cap per source. The total is the largest for which every source with any text
    can fill its share, or ``total`` if that is smaller: each size that is too large has a cut that
    bounds the size, and the next trial is that bound. Sources without text get nothing.
    """
    held = {s for p in patterns for s in p}
    share = {s: w for s, (w, _) in targets.items() if s in held and w and w > 0}
    whole = sum(share.values())
    if not whole:
        return 0, {}
    share = {s: w / whole for s, w in share.items()}
    sources = sorted(share)
    place = {s: i for i, s in enumerate(sources)}
    repeats = {s: max(1, targets[s][1]) for s in sources}
    names = sorted(p for p in patterns if any(s in share for s in p))
    most = [max(repeats[s] for s in p if s in share) for p in names]
    first = 2 + len(names)

    def network(size: int) -> tuple[Flow, list[int], dict, list[int]]:
        g = Flow(first + len(sources))
        supply = [g.arc(0, 2 + i, 0) for i in range(len(names))]
        arcs = {(p, s): g.arc(2 + i, first + place[s], patterns[p] * repeats[s]) for i, p in enumerate(names) for s in p if s in share}
        return g, supply, arcs, [g.arc(first + i, 1, int(share[s] * size)) for i, s in enumerate(sources)]

    size = sum(patterns[p] * m for p, m in zip(names, most))
    size = size if total is None else min(size, total)
    while size > 0:
        g, supply, arcs, sinks = network(size)
        for e, p, m in zip(supply, names, most):
            g.cap[e] = patterns[p] * m
        wanted = sum(g.cap[e] for e in sinks)
        if g.send(0, 1) == wanted:
            break
        mine = g.reached(0)
        # Beyond the cut lie quotas that only its arcs fill: what these carry at most bounds the size.
        bound = sum(patterns[p] * m for i, (p, m) in enumerate(zip(names, most)) if not mine[2 + i])
        bound += sum(patterns[p] * repeats[s] for i, p in enumerate(names) if mine[2 + i] for s in p if s in share and not mine[first + place[s]])
        beyond = sum(share[s] for s in sources if not mine[first + place[s]])
        size = min(size - 1, int(bound / beyond) + 1)
    if size <= 0:
        return 0, {}
    g, supply, arcs, sinks = network(size)
    wanted, sent = sum(g.cap[e] for e in sinks), 0
    for k in range(max(most)):
        for e, p, m in zip(supply, names, most):
            if k < m:
                g.cap[e] += patterns[p]
        sent += g.send(0, 1)
        if sent == wanted:
            break
    return size, {k: g.cap[e ^ 1] for k, e in arcs.items() if g.cap[e ^ 1] > 0}


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, copies: bool = True) -> DataFrame:
    """The selected documents: doc_id, source_name (the source it counts for), n_uses, n_tokens (of one use).

    ``sized`` comes from :func:`sizes`; ``targets`` has source_name, target_share and max_repeats (null
    counts as 1). Documents whose source is null or no target, and texts without a token, are not
    selected. A text in several sources serves any of them through the smallest doc_id of each; its
    further copies within a source are documents of that source alone, or without ``copies`` no
    documents at all. A document is used at most max_repeats times; each source gets its share of the
    total to within one document per pattern. Rows that repeat a doc_id count once. Empty tables give an
    empty selection. Deterministic for a seed.
    """
    spark = sized.sparkSession
    aims = {r[0]: (r[1] or 0.0, r[2] or 1) for r in collect_small(targets.filter("source_name IS NOT NULL").select("source_name", "target_share", "max_repeats"), MAX_SOURCES, "sources")}
    named = spark.createDataFrame([(s,) for s in aims], "source string")
    usable = sized.filter("n_tokens > 0").join(F.broadcast(named), "source", "left_semi")
    firsts = durable(usable.groupBy("text_id", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")), "firsts")
    shared = firsts.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "doc_id"))).alias("docs"), F.max("n_tokens").alias("n_tokens"))
    if copies:
        # By document, so that a text with very many copies is no group anywhere.
        more = usable.join(firsts.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
        shared = shared.unionByName(more.select(F.concat_ws(":", "text_id", "doc_id").alias("text_id"), F.create_map("source", "doc_id").alias("docs"), "n_tokens"))
    units = durable(shared.withColumn("pattern", F.array_sort(F.map_keys("docs"))).withColumn("h", F.xxhash64(F.lit(seed), "text_id")), "units")
    buckets = max(1024, -(-units.count() // BUCKET_TEXTS))
    units = units.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    patterns = {tuple(r[0]): r[1] for r in collect_small(units.groupBy("pattern").agg(F.sum("n_tokens")), MAX_PATTERNS, "membership patterns")}
    _, flow = route(patterns, aims, total)
    plan = []
    for p, tokens in patterns.items():
        at, stretches = 0, []
        for s in p:
            if flow.get((p, s)):
                stretches.append((float(at), float(at + flow[p, s]), s))
                at += flow[p, s]
        if stretches:
            plan.append((list(p), tokens, -(-at // tokens), stretches))
    plan_rows = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, pattern_tokens long, passes int, stretches array<struct<lo:double,hi:double,source_name:string>>"))
    sums = units.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("pattern", "bucket", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("start"))
    line = Window.partitionBy("pattern", "bucket").orderBy("h", "text_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        units.join(plan_rows, "pattern")
        .join(starts, ["pattern", "bucket"])
        .withColumn("middle", F.col("start") + F.sum("n_tokens").over(line) - F.col("n_tokens") / 2)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("x", F.col("middle") + F.col("pass") * F.col("pattern_tokens"))
        .withColumn("source_name", F.expr("get(filter(stretches, s -> x >= s.lo AND x < s.hi), 0).source_name"))
        .filter("source_name IS NOT NULL")
    )
    return placed.groupBy("text_id", "source_name").agg(F.first(F.expr("docs[source_name]")).alias("doc_id"), F.count("*").alias("n_uses"), F.first("n_tokens").alias("n_tokens")).select(
        "doc_id", "source_name", "n_uses", "n_tokens"
    )


def report(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source the share reached: source_name, target_share, actual_share, n_tokens, n_documents, most_uses, max_repeats."""
    sums = selected.groupBy("source_name").agg(
        F.sum(F.col("n_uses") * F.col("n_tokens")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("n_uses").alias("most_uses")
    )
    # One window over as many rows as there are sources.
    sums = sums.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))
    return targets.join(sums, "source_name", "left").select(
        "source_name",
        "target_share",
        F.coalesce(F.expr("try_divide(n_tokens, all_tokens)"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        "max_repeats",
    )
