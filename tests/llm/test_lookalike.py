import random
import unicodedata

import pytest

from pagelens.llm import lookalike as L
from pagelens.llm import queries

LINES = "line_no long, text string, ref_no long, fold boolean, key string"
REFS = "ref_no long, text string, map_w_to_v boolean, line_no long"


@pytest.mark.parametrize(
    "stored,plain",
    [("ｖｉｄ", "vid"), ("vⅰd", "vid"), ("v​i\xadd", "vid"), ("а̊r", "år"), ("år", "år"), ("Å", "Å"), ("ﬁn", "fin"), ("a\xa0b", "a b"), ("﻿ a ", "a"), ("Ν", "N"), ("", ""), (None, "")],
)
def test_plain(stored, plain):
    assert L.plain(stored) == plain


def test_automaton_costs():
    t = L.Trie(["kall", "vall", "år"])
    assert t.walk("kaⅼl") == ("kall", 0) and t.walk("kal") is None
    assert t.walk("kal", 1) == ("kall", 1) and t.walk("xkall", 1) == ("kall", 1) and t.walk("hall", 1) == ("kall", 1) and t.walk("kx", 1) is None
    assert L.Trie(["vid"], fold_w=True).walk("wid") == ("vid", 0) and L.Trie(["vid"]).walk("wid") is None


def pairs(spark, lines, refs, **kw):
    a = spark.createDataFrame([(i, t, 9, True, "clash") for i, t in enumerate(lines)], LINES)
    b = spark.createDataFrame([(i, *r, 5) for i, r in enumerate(refs)], REFS)
    return sorted((r.line_no, r.ref_no) for r in L.same_looking(a.union(a), b, **kw).collect())


@pytest.mark.parametrize("bound", [L.MAX_VOCABULARY, 1])
def test_pairs(spark, bound):
    lines = ["vid а år", "vid\xa0a år ", "vid a år", "Vid a år", "wid a år", "vid  a år", None, "", "vid a", "vida år", "Wåren‍"]
    refs = [("vid a år", False), ("vid a år", True), (None, True), ("Våren", True), ("Våren", None)]
    want = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (4, 1), (10, 3)]
    assert pairs(spark, lines, refs, max_vocabulary=bound) == want


@pytest.mark.parametrize("bound", [L.MAX_VOCABULARY, 1])
def test_letters_are_folded_before_they_are_composed(spark, bound):
    """The same rows through the trie and by table, for w with an accent too."""
    assert pairs(spark, ["ẃa", "ẃa", "va", "wa"], [("v́a", True), ("v́a", False)], max_vocabulary=bound) == [(0, 0), (1, 0)]


def test_spellings(spark):
    rng = random.Random(6)
    vocabulary = sorted({"".join(rng.choices("abåw", k=rng.randint(1, 6))) for _ in range(60)})
    asked = sorted({"".join(rng.choices("abåwｂ", k=rng.randint(1, 6))) for _ in range(300)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for k, y in enumerate(b, 1):
                row.append(min(last[k - 1] + (x != y), last[k] + 1, row[-1] + 1))
        return row[-1]

    texts = spark.createDataFrame([(" ".join(asked[i : i + 7]), "x") for i in range(0, len(asked), 7)] + [(None, "x")], "text string, word string")
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    for budget in (0, 1, 2):
        got = {r.token: (r.cost, r.spelling) for r in L.spellings(texts, words, budget).collect()}
        nfd = lambda s: unicodedata.normalize("NFD", L.plain(s))
        want = {t: min((edits(nfd(t), nfd(w)), w) for w in vocabulary) for t in asked}
        assert got == {t: w for t, w in want.items() if w[0] <= budget}


def test_empty_and_long(spark):
    assert pairs(spark, [], [("a", False)]) == [] and pairs(spark, ["a"], []) == []
    assert pairs(spark, ["a " * 100_000 + "ｂ"], [("a " * 100_000 + "b", False)]) == [(0, 0)]
    assert pairs(spark, ["a" * 20_000 + "ｂ"], [("a" * 20_000 + "b", False)]) == [(0, 0)]


def test_normalise(spark):
    rows = spark.createDataFrame([(1, "ｖｉｄ kaⅼl​ Ϝ", "x"), (2, None, "x"), (3, "", "x")], "line_no long, text string, word string")
    vocabulary = spark.createDataFrame([("kall",), (None,)], "word string")
    got = {r.line_no: r.norm for r in L.normalise(rows, vocabulary).collect()}
    assert got == {1: "vid kall Ϝ", 2: None, 3: ""}


def pairs_of_forms(spark, d):
    """Pairs whose forms are equal and whose texts as stored differ."""
    norm = queries.p4_normalised(spark, d).collect()
    texts = {r.line_no: r.text for r in spark.read.parquet(f"{d}/text_lines.parquet").collect()}
    refs = {r.ref_no: r.text for r in spark.read.parquet(f"{d}/ref_lines.parquet").collect()}
    of = {}
    for r in norm:
        if r.line_no is not None and r.norm is not None:
            of.setdefault((r.map_w_to_v, r.norm), []).append(r.line_no)
    return {(i, r.ref_no) for r in norm if r.ref_no is not None and r.norm is not None for i in of.get((r.map_w_to_v, r.norm), []) if texts[i] != refs[r.ref_no]}


def test_forms_give_the_pairs(spark, tmp_path, data):
    lines = ["wid", "vid", "Ẇid", "wid x\u030a ẘ", "vid x\u030a v\u030a", "wil", "ｖｉｄ ", "", " ", None, "wid"]
    spark.createDataFrame(list(enumerate(lines)), "line_no long, text string").write.parquet(f"{tmp_path}/text_lines.parquet")
    refs = [("vid", True), ("wid", False), ("wid", None), ("v\u030a", True), ("vid x\u030a v\u030a", True), ("vil", False), ("", True)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(refs)], "ref_no long, text string, map_w_to_v boolean").write.parquet(f"{tmp_path}/ref_lines.parquet")
    spark.createDataFrame([("wil", True), (None, None)], "word string, map_w_to_v boolean").write.parquet(f"{tmp_path}/lexicon.parquet")
    for d in (str(tmp_path), data):
        want = {tuple(r) for r in queries.p4_found(spark, d).select("line_no", "ref_no").collect()}
        assert pairs_of_forms(spark, d) == want and want
        if d == str(tmp_path):
            assert {(0, 0), (10, 0), (6, 0), (3, 4)} <= want and (1, 1) not in want and (5, 5) not in want
