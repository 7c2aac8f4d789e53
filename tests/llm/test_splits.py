import random

from pagelens.llm import splits

SCHEMA = "rec_no long, source_page_id string, volume_no long, scribe_ref string, dataset_tag string, group_id string, component string, split string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    rows = {r[0]: r for r in rows if r[0] is not None}
    parent = {k: k for k in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for k, (_, s, v, w, _) in rows.items():
        key = "".join(c for c in (w or "").lower() if c.isalnum())
        for name in (("s", s), ("v", v), ("w", key if key not in splits.PLACEHOLDERS else None)):
            if name[1] is not None:
                parent[find(k)] = find(seen.setdefault(name, k))
    lows = {}
    for k, r in rows.items():
        if r[2] is not None:
            lows[find(k)] = min(lows.get(find(k), r[2]), r[2])
    return {k: (find(k), lows.get(find(k))) for k in rows}


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_groups_against_union_find(spark):
    rng = random.Random(5)
    rows = [
        (i, f"p{rng.randint(0, 70)}" if rng.random() < 0.9 else None, rng.randint(0, 25) if rng.random() < 0.3 else None,
         rng.choice(["Åke-1", "(ÅKE 1)", "åke.1", "okänd", "N.N.", "-", "", None, f"W{rng.randint(0, 60)}", f"w-{rng.randint(0, 60)}."]), "t")
        for i in range(150)
    ]
    want = brute(rows)
    got = {r.rec_no: (r.group_id, r.group_volume_no) for r in splits.groups(table(spark, rows + rows[:9])).collect()}
    assert got.keys() == want.keys()
    assert same_partition([got[k][0] for k in want], [want[k][0] for k in want])
    assert all(got[k][1] == want[k][1] for k in want)


def test_long_chain_and_hot_volume(spark):
    chain = [(i, f"p{i // 2}", None if i % 2 else -1, f"s{(i + 1) // 2}", "t") for i in range(200)]
    hot = [(1000 + i, f"q{i}", 7, None, "t") for i in range(200)]
    chain = [(r[0], r[1], None, r[3], r[4]) for r in chain]
    got = {r.rec_no: r.group_id for r in splits.groups(table(spark, chain + hot)).collect()}
    assert len({got[r[0]] for r in chain}) == 1 and len({got[r[0]] for r in hot}) == 1 and len(set(got.values())) == 2


def test_nulls_and_empty(spark):
    got = splits.groups(table(spark, [(1, None, None, None, None), (2, None, None, None, None), (None, "a", 1, "b", "t")])).collect()
    assert len({r.group_id for r in got}) == 2 and all(r.group_volume_no is None for r in got)
    empty = splits.groups(table(spark, []))
    assert empty.count() == 0
    assert splits.assign(empty, {None: (0.8, 0.1, 0.1)}).count() == 0


def test_assignment_keeps_groups_and_proportions(spark):
    rng = random.Random(6)
    rows = [(i, f"g{i}" if rng.random() < 0.7 else f"g{rng.randint(0, 999)}", rng.choice("abc") if i % 50 else None) for i in range(12_000)]
    df = spark.createDataFrame(rows, "rec_no long, group_id string, dataset_tag string")
    shares = {None: (0.8, 0.1, 0.1), "a": (0.7, 0.15, 0.15)}
    got = splits.assign(df, shares).collect()
    assert len(got) == 12_000 and {r.split for r in got} == set(splits.SPLITS)
    by_group = {}
    for r in got:
        by_group.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    for tag in ("a", "b", "c"):
        mine = [r.split for r in got if r.dataset_tag == tag]
        for s, share in zip(splits.SPLITS, shares.get(tag, shares[None])):
            assert abs(mine.count(s) / len(mine) - share) < 0.03
    again = {r.rec_no: r.split for r in splits.assign(df.repartition(5), shares).collect()}
    assert again == {r.rec_no: r.split for r in got}


def test_proportions(spark):
    df = spark.createDataFrame([("a", 80, 10), ("a", 80, 10), ("b", None, 5)], "dataset_tag string, n_train long, n_val long")
    assert splits.proportions(df)["a"] == (0.8, 0.1, 0.1) and "b" not in splits.proportions(df)
    assert splits.proportions(df.limit(0)) == {None: (0.8, 0.1, 0.1)}
