import itertools
import math
import random

import numpy as np
import pytest

from pagelens.operators import evaluate as E
from pagelens.operators.assignment import solve


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(25):
            cost = rng.integers(0, 9, (n, n)).astype(float)
            columns = solve(cost)
            assert sorted(columns) == list(range(n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert cost[np.arange(n), columns].sum() == best


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_levenshtein():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("aåb😀") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert E.levenshtein(a, b) == slow(a, b)
    words = ["".join(rng.choice("aåb😀") for _ in range(rng.randint(0, 9))) for _ in range(15)]
    assert E.distances(words[:7], words[7:]).tolist() == [[slow(a, b) for b in words[7:]] for a in words[:7]]


def rate(truth, read):
    d = E.distances(truth, read)
    return E.permutation_cer(truth, read, d, 1.0), E.permutation_cer(truth, read, d, 0.0)


def test_hand_cases():
    assert rate(["abc", "de"], ["de", "abc"])[0][0] == 0
    assert E.linewise_cer(["abc", "de"], ["de", "abc"]) == pytest.approx(1.25)
    (strict, only), (tolerant, _) = rate(["abc"], ["abc", "zz"])
    assert strict == pytest.approx(2 / 3) and only == 0 and tolerant == 0
    assert rate(["abc", "de"], ["abc"])[0][0] == pytest.approx(2 / 5)
    assert rate([], [])[0][0] == 0 and math.isnan(rate([], [])[0][1])
    assert rate([], ["x"])[0][0] == 1
    assert rate(["x"], [])[0][0] == 1
    with pytest.raises(ZeroDivisionError):
        rate([""], ["x"])
    assert E.bag_of_words([], []) == (1, 1, 1) and E.bag_of_words([], ["x"]) == (0, 1, 0) and E.bag_of_words(["x"], []) == (0, 0, 0)
    assert E.bag_of_words(["a a b"], ["a b b"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert E.precision_recall(0, 0, 0) == (1, 1, 1) and E.precision_recall(0, 2, 0) == (0, 1, 0) and E.precision_recall(2, 0, 0) == (1, 0, 0)


def test_detection_hand_case():
    iou = E.iou_matrix(np.array([[0, 0, 10, 10.0]]), np.array([[0, 0, 10, 10.0], [100, 100, 110, 110]]))
    assert E.average_precision(iou, [0.5, 0.9], 0.5) == 0.5
    assert E.precision_recall(1, 2, sum(v >= 0.5 for v in E.greedy_ious(iou))) == pytest.approx((0.5, 1, 2 / 3))
    assert E.average_precision(np.zeros((0, 0)), [], 0.5) == 1 and E.average_precision(np.zeros((0, 1)), [1], 0.5) == 0 and E.average_precision(np.zeros((1, 0)), [], 0.5) == 0


def test_targets_of_random_pages():
    rng = random.Random(3)
    for _ in range(40):
        side = lambda: [{"text": "".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))), **b()} for _ in range(rng.randint(0, 5))]

        def b():
            x, y = rng.randint(0, 20), rng.randint(0, 20)
            return {"xmin": x, "ymin": y, "xmax": x + rng.randint(1, 9), "ymax": y + rng.randint(1, 9)}

        truth, read = side(), side()
        dets = [{"kind": k, "score": rng.random(), **b()} for k in ("line", "region") for _ in range(rng.randint(0, 4))]
        t = E.targets(truth, truth, truth, read, dets)
        assert tuple(t) == E.TARGETS
        assert t["target_pi_missing_ratio"] == t["target_avg_missing_ratio"] and t["target_perm_cer_split_penalty"] >= -1e-9
        for k, v in t.items():
            if any(x in k for x in ("bow", "map", "iou")):
                assert -1e-9 <= v <= 1 + 1e-9
        same = E.targets(truth, truth, truth, truth, [{"kind": k, "score": 1.0, **{s: x[s] for s in ("xmin", "ymin", "xmax", "ymax")}} for x in truth for k in ("line", "region")])
        assert same["target_perm_cer_strict"] == 0 and same["target_bow_f1"] == 1


def test_evaluate_keeps_failing_pages(spark):
    line = "array<struct<text:string,xmin:double,ymin:double,xmax:double,ymax:double>>"
    box = "array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
    det = "array<struct<kind:string,score:double,xmin:double,ymin:double,xmax:double,ymax:double>>"
    truth = spark.createDataFrame([("a", [("x", 0.0, 0.0, 1.0, 1.0)], [], []), ("b", [("", None, None, None, None)], [], None), ("c", None, None, None)], f"stem string, lines {line}, boxes {box}, regions {box}")
    read = spark.createDataFrame([("a", [("x", 0.0, 0.0, 1.0, 1.0)], []), ("b", [("y", None, None, None, None)], []), ("z", [], [])], f"stem string, lines {line}, detections {det}")
    got = {r.stem: r for r in E.evaluate(truth, read).collect()}
    assert set(got) == {"a", "b"} and got["a"].target_perm_cer_strict == 0 and got["b"].error.startswith("ZeroDivisionError")
    assert E.corpus_means(E.evaluate(truth, read)).first().n_pages == 1
