import numpy as np
import pytest

from pagelens.functions import polygons as P
from pagelens.operators import evaluate


def inside(p, x, y):
    """Even-odd rule for many points."""
    a, b = p, np.roll(p, -1, axis=0)
    found = np.zeros(x.shape, dtype=bool)
    for (x0, y0), (x1, y1) in zip(a, b):
        if y0 != y1:
            found ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return found


def star(rng, n):
    """A simple polygon, mostly not convex."""
    angle = np.sort(rng.random(n)) * 2 * np.pi
    size = 1 + 3 * rng.random(n)
    return np.stack([5 + size * np.cos(angle), 5 + size * np.sin(angle)], axis=1) + rng.random(2)


def test_areas_against_sampling():
    rng = np.random.default_rng(3)
    x, y = (rng.random(200_000) * 11 for _ in range(2))
    for _ in range(25):
        p, q = star(rng, rng.integers(3, 12)), star(rng, rng.integers(3, 12))
        if not (P.is_simple(p) and P.is_simple(q)):
            continue
        both, either = inside(p, x, y) & inside(q, x, y), inside(p, x, y) | inside(q, x, y)
        assert P.iou(p, q) == pytest.approx(both.sum() / either.sum(), abs=0.02)
        assert P.intersection_area(p, p) == pytest.approx(P.area(p)) and P.iou(p, p) == pytest.approx(1.0)
        assert P.intersection_area(p, q) == pytest.approx(P.intersection_area(q, p))


def test_simple_outlines():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], dtype=float)
    assert P.is_simple(square) and P.is_simple(square[::-1]) and P.is_simple(np.vstack([square, square[:1]]))
    for bad in ([(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (2, 0), (1, 0), (1, 2)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], [(0, 0), (0, 0), (1, 1)]):
        assert not P.is_simple(np.array(bad, dtype=float))
    assert P.iou(square, np.array([(0, 0), (2, 2), (2, 0), (0, 2)], dtype=float)) == 0.0
    # Side by side, and one within the other.
    assert P.iou(square, square + [2, 0]) == 0.0 and P.iou(square, square / 2) == pytest.approx(0.25)


def test_points():
    assert P.parse_points("1,2 3,4;5,6 x") is not None and P.parse_points("1,2 3,4") is None
    assert P.parse_points("1,2 3,4 a,6") is None and P.parse_points("") is None and P.parse_points(None) is None


def line(points, polygon=True):
    x, y = [p[0] for p in points], [p[1] for p in points]
    text = " ".join(f"{a},{b}" for a, b in points)
    return {"xmin": min(x), "ymin": min(y), "xmax": max(x), "ymax": max(y), "polygon": text if polygon else "", "kind": "line", "score": 0.9}


def test_targets_match_skewed_lines_by_outline():
    """Two slanting lines whose boxes are the same but whose outlines only touch."""
    low, high = [(0, 0), (100, 80), (100, 100), (0, 20)], [(0, 20), (100, 100), (100, 120), (0, 40)]
    words = [{"text": "a", "xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0}]
    run = lambda a, b: evaluate.targets(words, [a], [], words, [b])
    assert run(line(low), line(low))["target_iou75_line_f1"] == 1.0
    assert run(line(low), line(high))["target_iou50_line_f1"] == 0.0
    assert run(line(low), line(high, False))["target_iou50_line_f1"] == 1.0
    # Average precision goes by the boxes.
    assert run(line(low), line(high))["target_map50_line"] == 1.0
