"""Train, validation and test splits that keep linked records together (grouped iterative stratification).

1. Find components: records are linked if they share a source page, a volume or a scribe, over any
   number of steps.
2. Aggregate label vectors: per component the number of records of each label (dataset tag).
3. Place components: the label with the fewest outstanding records first, each into the split that
   needs that label most, with its whole vector counted against what the splits need.

Components that hold more than :data:`LARGE_SHARE` of all records – at most ``1 / LARGE_SHARE`` of them
– are placed one by one. All others are bundled by their rarest label and a hash, and the bundles are
placed the same way by their summed vectors; with few components a bundle holds one. The number of
bundles and of their labels is bounded, so the driver sees vectors of bounded size only, and one pass
over the table assigns all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.runtime import collect_small, durable

SPLITS = ("train", "validation", "test")
#: Components beyond this share of all records are placed singly.
LARGE_SHARE = 0.001
#: Bundles of small components, and entries of their label vectors, that are placed on the driver.
MAX_BUNDLES = 65_536
MAX_ENTRIES = 2_000_000
MAX_LABELS = 1000
MAX_ROUNDS = 100

#: Scribes that stand for "unknown", as letters and digits in lower case; a parameter of :func:`groups`.
PLACEHOLDERS = (
    "", "okänd", "okänt", "okand", "ejangiven", "ejangivet", "ejkänd", "nn", "anonym", "namnlös", "saknas",
    "ingen", "unknown", "unbekannt", "anonymous", "none", "null", "na", "nan",
)


def scribe_key(ref: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """The letters and digits of a scribe reference in lower case; null for null, blank and placeholders."""
    key = F.regexp_replace(F.lower(ref), r"[^\p{L}\p{M}\p{N}]", "")
    return F.when((key != "") & ~key.isin(*placeholders), key)


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of an undirected graph: columns node, component (its smallest node).

    ``edges`` has string columns a and b. Each round hooks every node to its smallest neighbour, jumps
    twice, and contracts the graph to the hooks, so at least half of the nodes that still have an edge
    disappear; rounds grow with the logarithm of the nodes. Minima combine before the shuffle, and
    every round is cut into a durable table.
    """
    rest = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(MAX_ROUNDS):
        if rest.isEmpty():
            return labels
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("n"), "p"), "hooks")
        for _ in range(2):
            up = hook.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p", "left").select("n", F.coalesce("pp", "p").alias("p"))
        hook = durable(hook, "hooks")
        labels = durable(
            labels.join(hook.withColumnRenamed("n", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")),
            "labels",
        )
        ends = rest.join(hook.select(F.col("n").alias("a"), F.col("p").alias("x")), "a").join(hook.select(F.col("n").alias("b"), F.col("p").alias("y")), "b")
        rest = durable(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    raise RuntimeError("connected components did not converge")


def groups(pages: DataFrame, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """The linked group of every record: rec_no, dataset_tag, group_id, group_volume_no.

    ``pages`` has rec_no (the key; repeated rows count once), source_page_id, volume_no, scribe_ref and
    dataset_tag; further columns are ignored. Null links nothing; a record without any link is a group
    of its own. group_volume_no is the smallest volume of the group, null if it has none. An empty
    table gives an empty table.

    The graph has volumes and scribes as nodes, not records: a source page ties all volumes and scribes
    of its rows to the smallest of them, so a volume with a third of all records costs one edge per
    distinct partner.
    """
    rows = durable(
        pages.select("rec_no", "source_page_id", "volume_no", "scribe_ref", "dataset_tag")
        .filter("rec_no IS NOT NULL")
        .dropDuplicates(["rec_no"])
        .select(
            "rec_no",
            "dataset_tag",
            "volume_no",
            F.coalesce(F.concat(F.lit("s"), "source_page_id"), F.concat(F.lit("r"), F.col("rec_no").cast("string"))).alias("source"),
            F.concat(F.lit("v"), F.col("volume_no").cast("string")).alias("vkey"),
            F.concat(F.lit("w"), scribe_key(F.col("scribe_ref"), placeholders)).alias("wkey"),
        ),
        "pages",
    )
    keys = rows.select("source", F.explode(F.array("vkey", "wkey")).alias("key")).filter("key IS NOT NULL").distinct()
    hub = durable(keys.groupBy("source").agg(F.min("key").alias("hub")), "hubs")
    edges = keys.join(hub, "source").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    found = connected_components(edges)
    volume = (
        rows.select("vkey", "volume_no").filter("vkey IS NOT NULL").distinct()
        .join(found.withColumnRenamed("node", "vkey"), "vkey")
        .groupBy("component").agg(F.min("volume_no").alias("group_volume_no"))
    )
    named = hub.join(found.withColumnRenamed("node", "hub"), "hub").join(volume, "component", "left").select("source", "component", "group_volume_no")
    return rows.join(named, "source", "left").select(
        "rec_no", "dataset_tag", F.coalesce("component", "source").alias("group_id"), "group_volume_no"
    )


def proportions(metrics: DataFrame) -> dict[str | None, tuple[float, float, float]]:
    """Share of train, validation and test per dataset tag, from n_train and n_val; key None holds that of all tags.

    Test is as large as validation. Rows with a null count are ignored; without any row the shares are
    0.8, 0.1 and 0.1.
    """
    rows = collect_small(
        metrics.filter("n_train IS NOT NULL AND n_val IS NOT NULL").groupBy("dataset_tag").agg(F.sum("n_train"), F.sum("n_val")), MAX_LABELS, "dataset tags"
    )
    sums = {tag: (t, v) for tag, t, v in rows}
    sums[None] = (sum(t for t, _ in sums.values()), sum(v for _, v in sums.values()))
    return {tag: (t / (t + 2 * v), v / (t + 2 * v), v / (t + 2 * v)) if t + 2 * v > 0 else (0.8, 0.1, 0.1) for tag, (t, v) in sums.items()}


def _refined(placed: list[tuple[str, int]], counts: dict[str, dict[str, int]], need: dict[str, list[float]]) -> list[tuple[str, int]]:
    """Large groups moved to other splits as long as that lowers the squared excess over what labels need; ``need`` is kept up to date.

    Small groups fill what is needed afterwards, so only excess counts. At most 1 / LARGE_SHARE groups take part.
    """
    split = dict(placed)

    def excess(k: str, s: int, change: int) -> float:
        return min(0.0, need[k][s] - change) ** 2

    for _ in range(20):
        moved = False
        for g in sorted(split, key=lambda g: (-sum(counts[g].values()), g)):
            a, mine = split[g], counts[g]
            before = {s: sum(excess(k, s, 0) for k in mine) for s in range(len(SPLITS))}
            best, to = 1e-9, a
            for b in range(len(SPLITS)):
                if b != a:
                    gain = before[a] + before[b] - sum(excess(k, a, -n) + excess(k, b, n) for k, n in mine.items())
                    if gain > best:
                        best, to = gain, b
            if to != a:
                for k, n in mine.items():
                    need[k][a] += n
                    need[k][to] -= n
                split[g], moved = to, True
        if not moved:
            break
    return sorted(split.items())


def _place(units: dict[str, dict[str, int]], need: dict[str, list[float]]) -> list[tuple[str, int]]:
    """Iterative stratification of units (name to label counts): (name, split); ``need`` is kept up to date.

    Of the labels with outstanding records the rarest comes first, and of its units the one with most of
    it. A unit goes to the split that needs the label most, among those with room for its whole
    vector if there are any, else where its vector exceeds the needs least.
    """
    left: dict[str, int] = {}
    holders: dict[str, list[str]] = {}
    for name, counts in units.items():
        for k, n in counts.items():
            left[k] = left.get(k, 0) + n
            holders.setdefault(k, []).append(name)
    placed: dict[str, int] = {}
    splits = range(len(SPLITS))
    while any(left.values()):
        label = min((k for k, n in left.items() if n), key=lambda k: (left[k], k))
        for name in sorted((u for u in holders[label] if u not in placed), key=lambda u: (-units[u][label], u)):
            counts = units[name]
            room = [sum(min(0.0, need[k][s] - n) for k, n in counts.items()) for s in splits]
            fits = [s for s in splits if room[s] > -0.5] or [max(splits, key=lambda s: (room[s], -s))]
            split = max(fits, key=lambda s: (need[label][s], sum(need[k][s] for k in counts), -s))
            placed[name] = split
            for k, n in counts.items():
                need[k][split] -= n
                left[k] -= n
    return sorted(placed.items())


def assign(group_rows: DataFrame, shares: dict[str | None, tuple[float, float, float]], seed: int = 42) -> DataFrame:
    """The split of every record: the columns of ``group_rows`` and ``split``.

    ``group_rows`` has group_id and dataset_tag (the label; null is a label of its own); it is read three
    times, so it should be a table. All records of a group get the same split. Deterministic for equal
    input and seed, whatever the partitioning.
    """
    spark = group_rows.sparkSession
    counted = group_rows.groupBy("group_id", F.coalesce("dataset_tag", F.lit("\0")).alias("k")).agg(F.count("*").alias("n"))
    vectors = durable(
        counted.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"), F.sum("n").alias("size")), "vectors"
    )
    outstanding = dict(collect_small(vectors.select(F.explode("counts").alias("k", "v")).groupBy("k").agg(F.sum("v")), MAX_LABELS, "labels"))
    need = {k: [n * p for p in shares.get(None if k == "\0" else k, shares[None])] for k, n in outstanding.items()}
    limit = sum(outstanding.values()) * LARGE_SHARE
    large = {r.group_id: r.counts for r in collect_small(vectors.filter(F.col("size") > limit), int(1 / LARGE_SHARE) + 1, "large groups")}
    placed = _refined(_place(large, need), large, need)

    # The rarest label of each small group, by the order of all labels, and the bundle of its hash.
    order = sorted(outstanding, key=lambda k: (outstanding[k], k))
    small = vectors.filter(F.col("size") <= limit).withColumn("rarest", F.array_min(F.transform(F.map_keys("counts"), lambda k: F.array_position(F.lit(order or [""]), k))))
    kinds = small.select("rarest", F.explode(F.map_keys("counts")).alias("k")).distinct().count()
    bundles = max(1, min(MAX_BUNDLES // max(len(order), 1), MAX_ENTRIES // max(kinds, 1)))
    small = small.withColumn("bundle", F.concat_ws(":", "rarest", F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(bundles))))
    sums = small.select("bundle", F.explode("counts").alias("k", "n")).groupBy("bundle", "k").agg(F.sum("n").alias("n"))
    units: dict[str, dict[str, int]] = {}
    for bundle, k, n in collect_small(sums, MAX_ENTRIES, "labels of bundles"):
        units.setdefault(bundle, {})[k] = n
    by_bundle = F.broadcast(spark.createDataFrame([(u, SPLITS[s]) for u, s in _place(units, need)], "bundle string, split string"))
    by_group = small.join(by_bundle, "bundle").select("group_id", "split")
    # Records of large groups get their split from at most 1 / LARGE_SHARE rows, so no task gathers such a group.
    singly = F.broadcast(spark.createDataFrame([(g, SPLITS[s]) for g, s in placed], "group_id string, split string"))
    rest = group_rows.join(singly.select("group_id"), "group_id", "left_anti").join(by_group, "group_id")
    return group_rows.join(singly, "group_id").unionByName(rest)


def report(assigned: DataFrame, shares: dict[str | None, tuple[float, float, float]]) -> DataFrame:
    """Records and share per dataset tag and split beside the share aimed at."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("dataset_tag", "split").agg(F.count("*").alias("n_records"), F.countDistinct("group_id").alias("n_groups"))
    total = assigned.groupBy("dataset_tag").agg(F.count("*").alias("n_tag"))
    aims = spark.createDataFrame([(k, s, p) for k, ps in shares.items() for s, p in zip(SPLITS, ps) if k is not None], "dataset_tag string, split string, target_share double")
    return (
        counts.join(total, "dataset_tag")
        .join(aims, ["dataset_tag", "split"], "left")
        .select("dataset_tag", "split", "n_records", "n_groups", (F.col("n_records") / F.col("n_tag")).alias("share"), "target_share")
    )
