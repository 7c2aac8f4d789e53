import random

from pagelens.llm import leakage as L
from pagelens.llm.words import words

DOCS = "doc_id long, text string, item_no long, terms string"
ITEMS = "item_no long, text string, doc_id long"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(docs)], DOCS)
    e = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], ITEMS)
    rows = L.leaks(d, e, **kw).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    assert all(r.match in ("phrase", "proximity") for r in rows)
    return {(r.item_no, r.doc_id) for r in rows}


def brute(docs, items, least=20):
    out = set()
    for j, t in enumerate(docs):
        w = words(t, True)
        for i, p in enumerate(items):
            a = words(p, True)
            for s in range(len(a) - least + 1):
                row, hit = [0] * (len(w) + 1), False
                for m in range(1, len(a) - s + 1):
                    last, row = row, [m]
                    for k in range(1, len(w) + 1):
                        row.append(min(last[k - 1] + (a[s + m - 1] != w[k - 1]), last[k] + 1, row[-1] + 1))
                    hit = hit or (m >= least and min(row) <= m // 8)
                if hit:
                    out.add((i, j))
                    break
    return out


def test_against_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.choice([19, 20, 27, 45])) for _ in range(6)]
    docs = []
    for _ in range(60):
        p = rng.choice(items)
        a = rng.randint(0, max(0, len(p) - 20))
        part = p[a : a + rng.choice([18, 20, 22, 30, 45])]
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(part) - 1)
            part[k : k + 1] = rng.choice([[], ["zz"], [part[k], "zz"]])
        docs.append(text(rng.randint(0, 15)) + part + text(rng.randint(0, 15)))
    items = [" ".join(p) for p in items]
    docs = [", ".join(d).upper() if i % 3 else "\n".join(d) for i, d in enumerate(docs)]
    want = brute(docs, items)
    assert len(want) > 10
    assert found(spark, docs, items) == want


def test_shorter_parts_and_other_proportions(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(12)] for _ in range(8)]
    docs = []
    for k in range(40):
        part = list(items[k % 8])
        if k % 3:
            part[rng.randint(0, 11)] = "zz"
        docs.append(" ".join(["q"] * rng.randint(0, 3) + part))
    items = [" ".join(p) for p in items]
    assert found(spark, docs, items, min_words=10) == brute(docs, items, 10) != set()
    assert found(spark, docs, items) == set()
    # 24 words, every third of which is altered.
    p = [f"ord{i}" for i in range(24)]
    d = " ".join("zz" if i % 3 == 2 else w for i, w in enumerate(p))
    assert found(spark, [d], [" ".join(p)], one_in=3) == {(0, 0)} and found(spark, [d], [" ".join(p)]) == set()


def test_blocks_and_kinds_of_match(spark):
    p = [[f"a{i}x{k}" for k in range(25)] for i in range(30)]
    docs = [" ".join(w) for w in p] + [" ".join([*w[:12], "zz", *w[13:]]) for w in p]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(p)], "item_no long, text string")
    rows = L.search(L.build_index(d), e, block_passages=8).collect()
    assert {tuple(r) for r in rows} == {(i, i, "phrase") for i in range(30)} | {(i, i + 30, "proximity") for i in range(30)}


def test_frequent_words_are_intersected_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS", 50)
    p = L.Passages([(0, " ".join(["ja", "nej"] * 15))])
    text = ["ja", "nej"] * 40
    row = {"doc_ids": [7], "ends": [80], "terms": __import__("numpy").array(["ja", "nej"], dtype=object), "offsets": [0, 40, 80], "positions": [*range(0, 80, 2), *range(1, 80, 2)]}
    assert len(text) == 80 and L._search_shard(p, row, 20, 8, 6) == ([0], [7], [True])


def test_broken_words_and_documents_do_not_run_together(spark):
    p = [f"ord{i}" for i in range(24)]
    whole = " ".join(p)
    hyphen = whole.replace("ord7", "or-\nd7").replace("ord9", "ord\xad\n9")
    assert found(spark, [hyphen, " ".join(p[:12]), " ".join(p[12:])], [whole]) == {(0, 0)}


def test_nulls_short_items_repeats_and_empty(spark):
    p = " ".join(f"ord{i}" for i in range(20))
    assert found(spark, [None, "", p, p.upper()], [None, "kort", p, p]) == {(2, 2), (2, 3), (3, 2), (3, 3)}
    assert found(spark, [], [p]) == set() and found(spark, [p], []) == set()


def test_very_long_document(spark):
    p = " ".join(f"ord{i}" for i in range(30))
    assert found(spark, ["x y z " * 400_000 + p, "ord1 ord2 " * 100_000], [p]) == {(0, 0)}
