import itertools
import random
import time

import pytest

from pagelens.llm import mixing as M

DOCS = "doc_id long, source string, text string, n_tokens long, pattern string, h long"
TARGETS = "source_name string, target_share double, max_repeats int, source string"


def sized(spark, rows):
    return M.sizes(spark.createDataFrame([(i, s, t, 1, "clash", 1) for i, (s, t) in enumerate(rows)], DOCS))


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


def test_sizes_match_the_tokenizer(spark):
    rows = [("a", "hej du"), ("a", None), ("b", ""), ("b", "åäö <|endoftext|> " * 50)]
    got = {r.doc_id: r.n_tokens for r in sized(spark, rows).collect()}
    enc = M.encoder()
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, (_, t) in enumerate(rows)}
    assert enc.decode(enc.encode_ordinary(rows[3][1])) == rows[3][1]


def test_flow_is_largest_and_least_costly():
    """Against all ways of sending whole tokens."""
    rng = random.Random(11)
    for _ in range(120):
        sources = ["a", "b", "c"][: rng.randint(1, 3)]
        names = [p for n in range(1, 4) for p in itertools.combinations(sources, n)]
        patterns = {p: rng.randint(1, 4) for p in rng.sample(names, min(len(names), rng.randint(1, 3)))}
        targets = {s: (rng.choice([0.2, 0.3, 0.5]), rng.randint(1, 3)) for s in sources}
        size, flow = M.route(patterns, targets)
        held = [s for s in sources if any(s in p for p in patterns)]
        whole = sum(targets[s][0] for s in held)
        share = {s: targets[s][0] / whole for s in held}
        arcs = [(p, s) for p in patterns for s in p]

        def best(quota):
            """Least cost of filling the quotas, None if they can't be filled."""
            found = {tuple(0 for _ in held): {(): 0}}
            states = {tuple([0] * len(held)): 0}
            for p, tokens in patterns.items():
                most = max(targets[s][1] for s in p) * tokens
                cost = [0]
                for k in range(most):
                    cost.append(cost[-1] + k // tokens)
                ahead = {}
                for got, c in states.items():
                    for give in itertools.product(*(range(min(targets[s][1] * tokens, quota[s] - got[held.index(s)]) + 1) for s in p)):
                        if sum(give) <= most:
                            to = list(got)
                            for s, x in zip(p, give):
                                to[held.index(s)] += x
                            to = tuple(to)
                            ahead[to] = min(ahead.get(to, 10**9), c + cost[sum(give)])
                states = ahead
            assert found
            return states.get(tuple(quota[s] for s in held))

        quota = lambda n: {s: int(share[s] * n) for s in held}
        least = best(quota(size))
        used = {p: sum(flow.get((p, s), 0) for s in p) for p in patterns}
        assert all(sum(flow.get((p, s), 0) for p in patterns if s in p) == quota(size)[s] for s in held)
        assert all(f <= patterns[p] * targets[s][1] for (p, s), f in flow.items()) and set(flow) <= set(arcs)
        assert least == sum(sum(k // patterns[p] for k in range(used[p])) for p in patterns)
        assert best(quota(size + len(held) + 1)) is None or any(sum(quota(n).values()) == sum(quota(size).values()) for n in range(size + 1, size + 5))


def test_large_networks_are_solved():
    rng = random.Random(13)
    sources = [f"s{i}" for i in range(60)]
    patterns = {}
    while len(patterns) < 8000:
        patterns[tuple(sorted(rng.sample(sources, rng.randint(1, 6))))] = rng.randint(1, 10**7)
    targets = {s: (rng.random(), rng.randint(1, 5)) for s in sources}
    began = time.perf_counter()
    size, flow = M.route(patterns, targets)
    assert time.perf_counter() - began < 60
    whole = sum(w for w, _ in targets.values())
    for s in sources:
        assert abs(sum(f for (_, t), f in flow.items() if t == s) / size - targets[s][0] / whole) < 1e-6


def test_shares_caps_and_overlap(spark):
    rng = random.Random(12)
    text = lambda i: f"text number {i} " + "ord " * rng.randint(5, 40)
    rows = [("big", text(i)) for i in range(600)] + [("small", text(1000 + i)) for i in range(60)]
    shared = [text(5000 + i) for i in range(80)]
    rows += [("big", t) for t in shared] + [("small", t) for t in shared] + [("other", "x y"), (None, "z"), ("big", None), ("big", "")] + [("big", rows[0][1])] * 3
    aims = targets(spark, [("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1), (None, 0.1, 1)])
    s = sized(spark, rows).cache()
    picked = M.mix(s, aims).cache()
    got = picked.collect()
    assert {r.source_name for r in got} == {"big", "small"}
    assert all(rows[r.doc_id][0] == r.source_name and r.n_uses <= {"big": 1, "small": 3}[r.source_name] for r in got)
    assert len({(r.doc_id, r.source_name) for r in got}) == len(got)
    shares = {r.source_name: r for r in M.report(picked, aims).collect()}
    assert abs(shares["big"].actual_share - 0.6) < 0.01 and abs(shares["small"].actual_share - 0.4) < 0.01 and shares["none"].n_tokens == 0
    again = {tuple(r) for r in M.mix(s.repartition(9), aims).collect()}
    assert again == {tuple(r) for r in got}
    half = M.mix(s, aims, total=2000)
    assert abs(sum(r.n_uses * r.n_tokens for r in half.collect()) - 2000) < 150
    assert {tuple(r) for r in M.mix(s, aims, total=2000, seed=1).collect()} != {tuple(r) for r in half.collect()}


def test_empty(spark):
    aims = targets(spark, [("a", 1.0, None)])
    assert M.mix(sized(spark, []), aims).count() == 0
    assert M.report(M.mix(sized(spark, []), aims), aims).first().actual_share == 0
    assert M.mix(sized(spark, [("a", "x")]), targets(spark, [])).count() == 0
    assert M.mix(sized(spark, [("a", "x y z")]), aims).first().n_uses == 1


@pytest.mark.parametrize("seed", range(5))
def test_route_reaches_the_largest_total(seed):
    rng = random.Random(seed)
    patterns = {("a",): rng.randint(1, 50), ("b",): rng.randint(1, 50), ("a", "b"): rng.randint(1, 50)}
    aims = {"a": (0.5, 1), "b": (0.5, 2)}
    total, flow = M.route(patterns, aims)
    for p, n in patterns.items():
        assert sum(flow.get((p, s), 0) for s in p) <= n * max(aims[s][1] for s in p)
        assert all(flow.get((p, s), 0) <= n * aims[s][1] for s in p)
    for s in "ab":
        assert sum(v for (p, t), v in flow.items() if t == s) == int(total * 0.5)
