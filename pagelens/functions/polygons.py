"""Areas of polygons and of their intersections, exact for any simple polygon, in NumPy."""

from __future__ import annotations

import numpy as np


def parse_points(text: str | None) -> np.ndarray | None:
    """Corners of ``x,y`` tokens parted by blanks or semicolons (n × 2); None for fewer than three or a coordinate that is no number.

    Tokens without a comma are skipped.
    """
    parts = [t.partition(",") for t in (text or "").replace(";", " ").split()]
    try:
        points = [(float(x), float(y)) for x, comma, y in parts if comma]
    except ValueError:
        return None
    return np.array(points) if len(points) >= 3 else None


def _ring(p: np.ndarray) -> np.ndarray:
    """Corners without repeats in a row, also over the end."""
    return p[np.any(p != np.roll(p, 1, axis=0), axis=1)]


def area(p: np.ndarray) -> float:
    x, y = (p - p.mean(axis=0)).T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sign of the turn from a over b to c."""
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def is_simple(p: np.ndarray) -> bool:
    """Whether the outline has an area and neither crosses nor touches itself."""
    if not np.isfinite(p).all():
        return False
    p = _ring(p)
    n = len(p)
    if n < 3 or area(p) == 0:
        return False
    a, b = p, np.roll(p, -1, axis=0)
    c = np.roll(p, -2, axis=0)
    # Neighbouring edges share a corner; they overlap if the second turns straight back.
    back = (_side(a, b, c) == 0) & (((b - a) * (c - b)).sum(axis=1) < 0)
    if back.any():
        return False
    i, j = np.triu_indices(n, 2)
    apart = ~((i == 0) & (j == n - 1))
    i, j = i[apart], j[apart]
    s1, s2 = _side(a[i], b[i], a[j]), _side(a[i], b[i], b[j])
    s3, s4 = _side(a[j], b[j], a[i]), _side(a[j], b[j], b[i])
    cross = (s1 != s2) & (s3 != s4)

    def on(u: np.ndarray, v: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s == 0) & np.all((np.minimum(u, v) <= w) & (w <= np.maximum(u, v)), axis=1)

    touch = on(a[i], b[i], a[j], s1) | on(a[i], b[i], b[j], s2) | on(a[j], b[j], a[i], s3) | on(a[j], b[j], b[i], s4)
    return not (cross & (s1 * s2 <= 0) & (s3 * s4 <= 0) | touch).any()


def _crossings(p: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Sorted x of the outline at each height (heights × corners, unused places infinite)."""
    a, b = p, np.roll(p, -1, axis=0)
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    cut = (low[None, :] < ys[:, None]) & (ys[:, None] < high[None, :])
    rise = np.where(b[:, 1] != a[:, 1], b[:, 1] - a[:, 1], 1.0)
    x = a[None, :, 0] + (ys[:, None] - a[None, :, 1]) * ((b[:, 0] - a[:, 0]) / rise)[None, :]
    return np.sort(np.where(cut, x, np.inf), axis=1)


def intersection_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area common to two simple polygons.

    Corners and crossings of the outlines cut the plane into slabs in which no edges meet, so the common
    width is linear in each and its middle gives the slab's area.
    """
    lo, hi = np.maximum(p.min(axis=0), q.min(axis=0)), np.minimum(p.max(axis=0), q.max(axis=0))
    if (lo >= hi).any():
        return 0.0
    p, q = _ring(p), _ring(q)
    a, b = p[:, None, :], np.roll(p, -1, axis=0)[:, None, :]
    c, d = q[None, :, :], np.roll(q, -1, axis=0)[None, :, :]
    r, s = b - a, d - c
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((c - a)[..., 0] * s[..., 1] - (c - a)[..., 1] * s[..., 0]) / cross
        u = ((c - a)[..., 0] * r[..., 1] - (c - a)[..., 1] * r[..., 0]) / cross
        met = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        heights = (a[..., 1] + t * r[..., 1])[met]
    ys = np.unique(np.concatenate([p[:, 1], q[:, 1], heights]))
    ys = ys[(ys >= lo[1]) & (ys <= hi[1])]
    if len(ys) < 2:
        return 0.0
    middle = (ys[1:] + ys[:-1]) / 2
    x, z = _crossings(p, middle), _crossings(q, middle)
    left = np.maximum(x[:, 0 : len(p) - 1 : 2, None], z[:, None, 0 : len(q) - 1 : 2])
    right = np.minimum(x[:, 1 : len(p) : 2, None], z[:, None, 1 : len(q) : 2])
    both = np.isfinite(right)
    width = np.where(both, np.maximum(0.0, np.where(both, right, 0.0) - np.where(both, left, 0.0)), 0.0).sum(axis=(1, 2))
    return float((width * np.diff(ys)).sum())


def iou(p: np.ndarray, q: np.ndarray) -> float:
    """Intersection over union of two polygons; 0 if one is not simple."""
    return _iou(p, q, is_simple(p), is_simple(q))


def _iou(p: np.ndarray, q: np.ndarray, p_simple: bool, q_simple: bool) -> float:
    if not p_simple or not q_simple:
        return 0.0
    both = intersection_area(p, q)
    whole = area(_ring(p)) + area(_ring(q)) - both if both > 0 else 0.0
    return both / whole if whole > 0 else 0.0


def iou_matrix(a: list[str | None], b: list[str | None], boxes: np.ndarray) -> np.ndarray:
    """Intersection over union of all pairs of polygons (as text); where one has none, that of the boxes."""
    out = boxes.copy()
    same = a is b

    def read(texts: list[str | None]) -> tuple[list[np.ndarray | None], np.ndarray]:
        found = [None if p is None or not np.isfinite(p).all() else p for p in map(parse_points, texts)]
        around = np.array([[np.nan] * 4 if p is None else [*p.min(axis=0), *p.max(axis=0)] for p in found]).reshape(-1, 4)
        return found, around

    left, x = read(a)
    right, y = (left, x) if same else read(b)
    simple: dict[int, bool] = {}

    def is_plain(p: np.ndarray) -> bool:
        if id(p) not in simple:
            simple[id(p)] = is_simple(p)
        return simple[id(p)]

    both = ~np.isnan(x[:, None, 0]) & ~np.isnan(y[None, :, 0])
    meet = (x[:, None, :2] < y[None, :, 2:]).all(axis=2) & (y[None, :, :2] < x[:, None, 2:]).all(axis=2)
    out[both] = 0.0
    for i, j in zip(*np.nonzero(both & meet)):
        if same and j == i:
            # An outline with itself.
            out[i, j] = 1.0
        elif not same or i < j:
            out[i, j] = _iou(left[i], right[j], is_plain(left[i]), is_plain(right[j]))
    # A list against itself needs half of the pairs.
    return np.triu(out) + np.triu(out, 1).T if same else out
