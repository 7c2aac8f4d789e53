import random

import pytest

from pagelens.llm import editor, repair

LINES = "line_no long, rec_no long, volume_no long, line_pos int, text string, kind string, word string"
WORDS = ("torp skog lada torplada skogslada gård gårdslada regn lampa sommar vinter sommarlada brev protokoll den vid och stor hade skogar lampor brevlada ladan gärna kanna panna"
         " handel mandel kandel landet vandra andra").split()  # fmt: skip


def lexicon(spark, words=WORDS):
    return spark.createDataFrame([(w, 1) for w in words] + [(None, 1), ("", 1)], "word string, kind int")


def table(spark, pages):
    """pages: (rec_no, volume, lines)"""
    rows, n = [], 0
    for rec, volume, lines in pages:
        for pos, t in enumerate(lines):
            rows.append((n, rec, volume, pos, t, "clash", "clash"))
            n += 1
    return spark.createDataFrame(rows + rows[:2], LINES), {(r[1], r[3]): r[0] for r in rows}


def kinds(df):
    out = {}
    for r in df.filter("kind <> 'text'").collect():
        out.setdefault(r.line_no, set()).add(r.kind)
    return out


@pytest.mark.parametrize(
    "text,want",
    [("( 53", ("a", 53)), ("— 46 —", ("a", 46)), ("l3", ("a", 13)), ("sid. 44", ("a", 44)), ("fol. 21v", ("f", 43)), ("fol. 22r", ("f", 44)), ("LIV", ("r", 54)), ("XIX", ("r", 19)), ("vid", None), ("lada", None), ("den 12", None), ("IIV", None)],
)
def test_page_numbers(text, want):
    assert repair.page_number(text) == want


def test_titles():
    titles = ["tullboktorpa1882"]
    assert repair.is_title("29   Tullblk Torpa 1882", titles) and repair.is_title("TULLBOK TORPA 1882", titles) and repair.is_title(".Tu.bok T0rpa 1882 .", titles)
    assert not repair.is_title("enligt Tullbok Torpa 1882. Det", titles) and not repair.is_title("hade stor lada", titles)


def name(i):
    """A word that no other page has, far from all others."""
    return "".join("bdfghjkmnprstvxz"[(i * k + k) % 16] + "aeiouy"[(i + k) % 6] for k in (3, 5, 7, 11)).capitalize()


def pages(n=24, volume=1):
    out = []
    for i in range(n):
        head = [["Tullbok Torpa 1882", "TULLBOK TORPA 1882", "Tullb0k Torpa 1882"][i % 3]] if i % 4 else []
        body = [f"{name(i)} hade {name(i + 50)}", "hade gårds-" if i % 2 else "hade skogs¬", f"lada och {name(i + 100)}", "1874."]
        out.append((10 * i, volume, [*head, *body, f"— {40 + i} —"]))
    return out


def test_furniture_and_splits(spark):
    df, at = table(spark, pages())
    got = kinds(repair.repair(df, lexicon(spark)))
    for i in range(24):
        shift = 1 if i % 4 else 0
        if shift:
            assert got[at[10 * i, 0]] == {"running_header"}
        assert got[at[10 * i, 4 + shift]] == {"page_number"}
        assert got[at[10 * i, 1 + shift]] == {"split_word"}
        assert at[10 * i, 3 + shift] not in got


def test_words_broken_over_pages_and_blocks(spark):
    lists = [(1, 1, ["den stor skog", "vid sommar-", None, " "]), (2, 1, ["lada hade", "vid vinter-"]), (600, 1, [None, " "]), (1200, 1, ["lada och", "regn"])]
    df, at = table(spark, [*lists, (1, 2, ["lada"]), (5, None, ["vid sommar-"])])
    found = repair.repair(df, lexicon(spark, [*WORDS, "vinterlada"]))
    got = kinds(found)
    assert got == {at[1, 1]: {"split_word"}, at[2, 1]: {"split_word"}}
    text = {(r.volume_no, r.rec_no): r.text for r in repair.paragraphs(found).collect()}
    assert text[1, 1].endswith("vid sommarlada") and text[1, 2].startswith("hade") and text[1, 1200] == "och regn"


def test_misread_words_are_learned_from_the_corpus(spark):
    noisy = ["stor 1ada och", "den 1ampa vid", "stor 1andet och", "den ska1a vid", "hade mande1 och", "vid hande1 och", "den torp1ada vid", "hade 1ampor vid", "stor skogs1ada och", "den brev1ada vid"]
    clean = ["den stor lada vid Elvira och", "hade wid skog wid regn"]
    df, at = table(spark, [(i, i, [f"{name(i)} den {t} regn", f"{clean[i % 2]} {name(i + 40)}"]) for i, t in enumerate(noisy * 3)])
    found = repair.repair(df, lexicon(spark))
    got = kinds(found)
    for i in range(30):
        assert (got.get(at[i, 0]) == {"misread"}) == ("ska1a" not in noisy[i % 10])
        assert at[i, 1] not in got
    texts = [r.text for r in found.filter("kind = 'text'").collect()]
    assert f"{name(0)} den stor lada och regn" in texts


def test_nulls_empty_and_long(spark):
    df, at = table(spark, [(1, 1, [None, "", "x " * 200_000]), (2, None, ["a" * 300_000])])
    assert repair.repair(df, lexicon(spark)).filter("kind = 'text'").count() == 2
    empty = df.limit(0)
    assert repair.repair(empty, lexicon(spark)).count() == 0
    assert repair.repair(df, lexicon(spark, [])).filter("kind IN ('misread', 'split_word')").count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None), (1, 1, None, None, "lada", None, None)], LINES)
    assert repair.repair(nulls, lexicon(spark)).count() >= 0


def test_editor_held_out():
    """Trained on part of the corrupted words, the editor repairs most of the others and leaves names alone."""
    vowels = "aeiou"
    words = [a + b + c + d for a in "kmstr" for b in vowels for c in ("ll", "nd", "rk") for d in ("a", "or", "en")]
    n = editor.Neighbours(words)
    # Only corruptions with one possible origin can be judged.
    bad = [(w.replace("l", "1", 1), w) for w in words if "l" in w] + [(w.replace("d", "cl"), w) for w in words if "d" in w]
    bad = [(b, w) for b, w in bad if len({b[:i] + r + b[i + len(x) :] for i, x, r in n.edits(b)}) == 1]
    names = [f"q{w}x" for w in words]
    model = editor.train([(b, 1) for b, _ in bad[::2]] + [(x, 1) for x in names], [], n)
    held = bad[1::2]
    right = sum(model.repair(b, n.edits(b)) == w for b, w in held)
    assert right >= 0.9 * len(held)
    assert not any(model.repair(x, n.edits(x)) for x in names)


def test_gaps_pairs_and_headings_of_both_pages(spark):
    """Planted lost, extra and twice misread characters, and different headings on facing pages."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abdefgiklmnoprstuvy", k=9)) for _ in range(500)})
    neighbours = editor.Neighbours(words)
    lost = [(w[:3] + w[4:], w) for w in words]
    extra = [(w[:3] + "x" + w[3:], w) for w in words]
    twice = [(w.replace("l", "1", 1).replace("r", "7", 1), w) for w in words if "l" in w and "r" in w]
    single = [(w.replace("l", "1", 1), w) for w in words if "l" in w] + [(w.replace("r", "7", 1), w) for w in words if "r" in w]
    one_way = lambda pairs, edits: [(b, w) for b, w in pairs if {b[:i] + r + b[i + len(x) :] for i, x, r in edits(b)} == {w}]
    lost = [p for p in one_way(lost, neighbours.gaps) if not neighbours.edits(p[0])]
    extra = [p for p in one_way(extra, neighbours.gaps) if not neighbours.edits(p[0])]
    sample = [*lost[::2], *extra[::2], *single]
    model = editor.train([(b, 1) for b, _ in sample], [], neighbours)
    judge = repair.Words(neighbours, model)
    for planted in (lost[1::2], extra[1::2], twice):
        assert len(planted) >= 5
        assert sum(judge.repaired(b) == ("respelt", w) for b, w in planted) >= 0.9 * len(planted)
    assert judge.repaired("q" * 100_000) is None
    left, right = "Tullbok Torpa 1882", "Norra Vedbo domsaga"
    df, at = table(spark, [(i, 3, [right if i % 2 else left, f"{name(i)} hade lada", f"{name(i + 60)} och regn"]) for i in range(30)])
    got = kinds(repair.repair(df, lexicon(spark)))
    assert sum(got.get(at[i, 0]) == {"running_header"} for i in range(30)) >= 27


def test_marked_breaks_of_other_words(spark):
    df, at = table(spark, [(1, 1, ["den Lindq-", "vist och Karl-", "Johan vid sommar-", "lada."])])
    found = repair.repair(df, lexicon(spark))
    assert kinds(found) == {at[1, 0]: {"joined"}, at[1, 1]: {"joined"}, at[1, 2]: {"split_word"}}
    assert " ".join(r.text for r in repair.paragraphs(found).orderBy("paragraph_no").collect()) == "den Lindqvist och Karl-Johan vid sommarlada."
