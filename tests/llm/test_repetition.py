import random

import numpy as np
import pytest

from pagelens.llm import repetition as R
from pagelens.llm.words import batch_words, codes, words

DOCS = "doc_id long, text string, band string, ratio string"


def share(text):
    w = words(text)
    seen, covered = set(), np.zeros(len(w), dtype=bool)
    for i in range(len(w) - 7):
        k = tuple(w[i : i + 8])
        if k in seen:
            covered[i : i + 8] = True
        seen.add(k)
    return covered.mean() if len(w) else 0.0


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzåäö") for _ in range(rng.randint(2, 11))) for _ in range(3000)]
    docs = []
    for _ in range(250):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60, 150, 400, 1500]))]
        for _ in range(rng.randint(0, 12)):
            k, n = rng.randint(0, len(w) - 1), rng.choice([4, 7, 8, 9, 20, 60])
            at = rng.randint(0, len(w))
            w[at:at] = w[k : k + n]
        docs.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    return docs + ["", None, "...", "a " * 50, "a b c d e f g h", "a b c d e f g h " * 2, "ab\x01cd " * 20]


def table(spark, docs):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(docs)], DOCS)


def test_shares_against_brute_force(spark):
    docs = corpus(1)
    got = {r.doc_id: r for r in R.measure(table(spark, docs), exact="all").collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(docs):
        assert got[i].repeated_share == pytest.approx(share(t), abs=1e-12)


def test_the_bands_lose_no_case(spark):
    docs = corpus(2) + corpus(3)
    want = {i for i, t in enumerate(docs) if share(t) >= R.REPEATED_SHARE}
    assert len(want) > 50
    assert {r.doc_id for r in R.repetitive(table(spark, docs)).collect()} == want
    bands = [r.band for r in R.measure(table(spark, docs)).collect()]
    assert bands.count("ordinary") > 100 and bands.count("empty") == 6


def test_cases_among_dense_codes(spark):
    """14 identifiers and a repeated clause of eight short words: a third of the words, few of the bytes."""
    rng = random.Random(5)
    docs = []
    for make in (lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=8)), lambda: f"{rng.getrandbits(32):08x}"):
        w = []
        while len(w) < 2000:
            w += [make() for _ in range(14)] + "och så är det nu i by a".split()
        docs.append(" ".join(w))
    assert all(share(t) >= R.REPEATED_SHARE for t in docs)
    assert {r.doc_id for r in R.repetitive(table(spark, docs)).collect()} == {0, 1}
    assert all(r.band == "repetitive" for r in R.measure(table(spark, docs)).collect())


def test_the_band_holds_for_the_hardest_cases(spark):
    """Ever new words with runs of exactly eight, scattered, staggered or far apart, at a share of just 30 %."""
    rng = random.Random(9)
    docs = []
    for n in (40, 80, 200, 1000, 30_000):
        fresh = iter(range(10**9))
        new = lambda k: [f"{next(fresh):x}q" for _ in range(k)]
        base = new(int(n * 0.7))
        spots = sorted(rng.randint(0, len(base) - 16) for _ in range(max(2, int(n * 0.3 / 8) + 1)))
        tail = []
        for k in spots:
            tail += base[k : k + 8] + new(1)
        docs.append(" ".join(base + tail))
        # Runs that overlap: each of nine words, made of two runs of eight from different places.
        chain = new(40)
        w = list(chain)
        for k in range(0, 24, 2):
            w += new(3) + chain[k : k + 8] + new(2) + chain[k + 1 : k + 9]
        docs.append(" ".join(w))
    docs = [d for d in docs if share(d) >= R.REPEATED_SHARE]
    assert len(docs) >= 8
    assert {r.doc_id for r in R.repetitive(table(spark, docs)).collect()} == set(range(len(docs)))


def test_long_texts_are_read_whole(spark):
    rng = random.Random(4)
    w = [f"{rng.randrange(10**6)}" for _ in range(300_000)]
    text = " ".join(w[:200_000] + w[:150_000])
    r = R.measure(table(spark, [text, "x" * 1_000_000])).orderBy("doc_id").collect()
    assert r[0].band == "repetitive" and r[0].repeated_share == pytest.approx(150 / 350, abs=1e-3) and r[1].n_words == 1


def test_repeats_and_empty_table(spark):
    df = table(spark, ["a b c d e f g h " * 3])
    assert R.repetitive(df.union(df)).count() == 2 and R.repetitive(df.limit(0)).count() == 0


def test_incompressible():
    assert R.repetitive_limit(np.array([100]))[0] > R.repetitive_limit(np.array([5000]))[0]
    assert R.limit(100, R.INCOMPRESSIBLE_LIMITS) > R.limit(5000, R.INCOMPRESSIBLE_LIMITS)
    found = batch_words(["a b", None, "a"])
    code, text = codes(found)
    assert code.tolist()[:2] != [-1, -1] and text.tolist() == [0, 0, 0, 1, 2, 2] and code[0] == code[4]
