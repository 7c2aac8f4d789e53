"""The queries over texts as stored, against brute force in plain Python."""

import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelens import queries


def is_word(c):
    return c == "_" or unicodedata.category(c)[0] in "LN"


def is_space(c):
    return c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c)[0] == "Z"


def words(text):
    return "".join(c if is_word(c) else "\n" for c in text.lower()).split("\n")


def collapsed(text):
    return " ".join(x for x in "".join("\0" if is_space(c) else c for c in text).split("\0") if x)


def windows(text, n):
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def lines(spark, data):
    rows = {r.line_no: r for r in spark.read.parquet(f"{data}/text_lines.parquet").collect()}
    assert any(not (r.text or "").isascii() for r in rows.values())
    return [(r.line_no, r.rec_no, r.line_pos, r.text or "") for r in rows.values()]


def by_page(lines):
    pages = defaultdict(list)
    for line in lines:
        pages[line[1]].append(line)
    return pages


def got(spark, data, name, keys=1):
    return {tuple(r[:keys]) if keys > 1 else r[0]: tuple(r[keys:]) for r in queries.queries()[name](spark, data).collect()}


def test_shapes(spark, data, lines):
    found, alpha = got(spark, data, "line_shape"), got(spark, data, "no_alpha_lines")
    pages = by_page(lines)
    assert found.keys() == alpha.keys() == pages.keys()
    for k, page in pages.items():
        n = [len(t) for *_, t in page]
        low, high = np.percentile(n, [20, 80])
        want = (len(n), sum(n), sum(len(collapsed(t).split(" ")) if collapsed(t) else 0 for *_, t in page), np.mean(n < low), np.mean(n > high))
        assert found[k] == pytest.approx(want, abs=1e-8)
        assert alpha[k][0] == pytest.approx(np.mean([not any(unicodedata.category(c)[0] == "L" for c in t) for *_, t in page]), abs=1e-8)


def test_ngrams(spark, data, lines):
    counts = {n: Counter(g for *_, t in lines for g in windows(collapsed(t), n)) for n in (3, 4)}
    top = {r.gram: r.cnt for r in queries.ngram_top(spark, data).collect()}
    assert len(top) == 200 and all(counts[4][g] == c for g, c in top.items()) and any(not g.isascii() for g in top)
    assert sorted(top.values()) == sorted(sorted(counts[4].values())[-200:])
    ratios = got(spark, data, "ngram_ratio")
    assert len(ratios) == len(lines)
    for k, _, _, t in lines:
        w = windows(collapsed(t), 3)
        assert ratios[k][0] == (pytest.approx(np.mean([counts[3][g] >= 50 for g in w]), abs=1e-8) if w else None)


def test_perplexity(spark, data, lines):
    counts = Counter(g for *_, t in lines for g in windows(t, 3))
    total, vocab = Counter(), Counter()
    for g, n in counts.items():
        total[g[:2]] += n
        vocab[g[:2]] += 1
    found = got(spark, data, "lm_perplexity")
    assert len(found) == len(lines)
    for k, _, _, t in lines:
        w = windows("".join(c for c in t if not is_space(c)), 3)
        p = [max((counts[g] + 0.1) / (total[g[:2]] + 0.1 * vocab.get(g[:2], 1)), 1e-12) for g in w]
        assert found[k][0] == (pytest.approx(np.exp(-np.mean(np.log(p))), rel=1e-6, abs=1e-4) if w else None)


def test_lexicon(spark, data, lines):
    lexicon = defaultdict(set)
    for r in spark.read.parquet(f"{data}/lexicon.parquet").collect():
        if r.word is not None:
            lexicon[r.lexicon_name].add(r.word.lower())
            lexicon["combined"].add(r.word.lower())
    found = got(spark, data, "lexicon_match", 2)
    pages = by_page(lines)
    assert len(found) == len(pages) * len(lexicon)
    for (k, name), value in found.items():
        tokens = [w for *_, t in pages[k] for w in words(t) if w]
        hits = [w for w in tokens if w in lexicon[name]]
        assert value == pytest.approx((len(hits) / len(tokens) if tokens else 0.0, len(hits), len(set(hits))), abs=1e-8)
    assert any("ö" in w for w in lexicon["combined"])


def test_error_rates(spark, data, lines):
    bow, cer = got(spark, data, "bow_prf"), got(spark, data, "linewise_cer")
    pages = by_page(lines)
    assert bow.keys() == pages.keys()
    for k, page in pages.items():
        a, b = (Counter(w for _, _, pos, t in page if pos % 2 == odd for w in words(t) if w) for odd in (0, 1))
        t, r, m = a.total(), b.total(), (a & b).total()
        p, c = (1.0 if t == r == 0 else m / r if t and r else 0.0), (1.0 if t == 0 else m / t if r else 0.0)
        assert bow[k] == pytest.approx((p, c, 2 * p * c / (p + c) if p + c else 0.0), abs=1e-8)
        truth, read = ({pos // 2: t for _, _, pos, t in page if pos % 2 == odd} for odd in (0, 1))
        rates = [(distance(t, read[i]) / len(t) if t else float(read[i] != "")) if i in read else 1.0 for i, t in truth.items()]
        n, m = len(truth), len(read)
        assert cer[k] == pytest.approx((np.mean(rates) if rates else 0.0, max(n - m, 0) / max(n, 1), max(m - n, 0) / max(m, 1)), abs=1e-8)


def test_word_boxes(spark, data, lines):
    want = {}
    for k, _, pos, t in lines:
        parts = [w for w in t.split(" ") if w]
        if parts:
            width = len(t) * 9 + pos % 7
            want[k] = (len(parts), min(width // len(t) * sum(len(w) + 1 for w in parts), width))
    assert got(spark, data, "word_boxes") == want
