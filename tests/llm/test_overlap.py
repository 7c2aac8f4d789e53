import random

import pytest

from pagelens.llm import overlap as O
from pagelens.llm.words import words

SCHEMA = "row_no long, split string, csv_file string, page_text string, text_id string, norm string, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, s, "f.csv", t, "clash", "clash", 1) for i, (s, t) in enumerate(rows)], SCHEMA)


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def brute(rows):
    out = set()
    for i, (s, a) in enumerate(rows):
        for j, (t, b) in enumerate(rows):
            if s == "train" and t not in ("train", None) and a and b:
                x, y = words(a), words(b)
                if x and y and slow(x, y) <= max(len(x), len(y)) // 8:
                    out.add((min(i, j), max(i, j)))
    return out


def test_distance_within():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        d, k = slow(a, b), rng.randint(0, 6)
        assert O.distance_within(a, b, k) == (d if d <= k else None)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 30, 64]))]
        rows.append(("train", " ".join(base)))
        for split in rng.sample(["val", "test", "train"], 2):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 6 + 1)):
                k = rng.randint(0, max(0, len(w) - 1))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [*w[k : k + 1], "extra"]])
            text = " ".join(w)
            rows.append((split, text.upper().replace(" ", ",\n ") if rng.random() < 0.3 else text))
    return rows


@pytest.mark.parametrize("shard", [O.SHARD_PASSAGES, 20])
def test_pairs_against_brute_force(spark, shard):
    rows = corpus(1)
    got = O.row_pairs(*O.matches(table(spark, rows), shard_passages=shard, part_texts=17, block_texts=50)[:2]).collect()
    assert {(r.row_no_a, r.row_no_b) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [("train", "a b c"), ("val", "A, b; c"), ("val", None), ("test", " .!"), (None, "a b c"), ("val", "a b c"), ("train", "")]
    df = table(spark, rows)
    pairs, members, coverage = O.matches(df.union(df))
    assert {(r.row_no, r.n_words, r.covered, r.share) for r in O.record_coverage(members, coverage).collect()} == {(1, 3, 3, 1.0), (5, 3, 3, 1.0)}
    assert {(r.row_no_a, r.row_no_b) for r in O.row_pairs(pairs, members).collect()} == {(0, 1), (0, 5)}
    c = O.counts(pairs, members).collect()
    assert [(r.split, r.n_rows, r.n_overlapping, r.n_exact) for r in c] == [("val", 2, 2, 2)]
    pairs, members, coverage = O.matches(df.limit(0))
    assert pairs.count() == 0 and coverage.count() == 0 and O.row_pairs(pairs, members).count() == 0


def test_long_text_and_hot_copy(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    rows = [("train", long), ("val", long + " more"), *[("train", "same words here")] * 40, ("test", "same words here")]
    got = {(r.row_no_a, r.row_no_b) for r in O.row_pairs(*O.matches(table(spark, rows))[:2]).collect()}
    assert got == {(0, 1), *((i, 42) for i in range(2, 42))}


@pytest.mark.parametrize("shard", [O.SHARD_PASSAGES, 20])
def test_wording_shared_by_many_records(spark, shard):
    """A form whose heading stands in every record: only records alike as a whole are pairs."""
    rng = random.Random(2)
    form = " ".join(f"form{i}" for i in range(16))
    body = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(40))
    bodies = [body() for _ in range(60)]
    rows = [("train", f"{form} {b}") for b in bodies] + [("val", f"{form} {b if i % 3 == 0 else body()}") for i, b in enumerate(bodies)]
    got = {(r.row_no_a, r.row_no_b) for r in O.row_pairs(*O.matches(table(spark, rows), shard_passages=shard)[:2]).collect()}
    assert got == brute(rows) and len(got) >= 20


def test_coverage_is_merged_over_training_texts(spark):
    w = [f"w{i}" for i in range(28)]
    rows = [("test", " ".join(w)), ("train", " ".join(w[:11])), ("train", "x " + " ".join(w[3:14])), ("train", " ".join(w[5:])), ("train", "y z")]
    _, members, coverage = O.matches(table(spark, rows))
    r = O.record_coverage(members, coverage).first()
    cuts = O.passages(w)
    assert (r.row_no, r.n_words) == (0, 28) and r.covered == sum(b - a for a, b in cuts if b <= 11 or a >= 3 and b <= 14 or a >= 5) > 20
