"""Gradient-boosted trees on histograms with learned directions for missing values, and search, selection and reports around them.

A model is trained on a bounded matrix (pages of a training set, :data:`MAX_ROWS`) by NumPy; work items
(target, feature set, trial) are spread over the executors, each training one model. Scoring runs in
Arrow batches over tables of any size.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.runtime import collect_small, durable

#: Rows a model is trained on at most; the training table must not be larger.
MAX_ROWS = 500_000
MAX_CELLS = 100_000_000
BINS = 64

#: The grid of the random search.
GRID = {
    "n_trees": (400, 600, 800, 1000, 1200, 1600),
    "max_depth": (3, 4, 5, 6, 7),
    "learning_rate": (0.01, 0.02, 0.03, 0.05, 0.1),
    "subsample": (0.6, 0.8, 1.0),
    "colsample": (0.6, 0.8, 1.0),
    "colsample_node": (0.5, 0.8, 1.0),
    "min_child": (1, 3, 5, 10),
    "gamma": (0.0, 0.1, 0.3),
    "reg_alpha": (0.0, 0.1, 0.5),
    "reg_lambda": (0.5, 1.0, 2.0),
}


@dataclass
class Params:
    n_trees: int = 600
    learning_rate: float = 0.03
    max_depth: int = 4
    min_child: float = 1.0
    subsample: float = 0.8
    colsample: float = 0.8
    colsample_node: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    patience: int = 40
    seed: int = 42


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), dtype=int)
        feature, cut, left, right, miss = (np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.missing_left))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            rows = np.flatnonzero(inner)
            node = at[rows]
            v = x[rows, feature[node]]
            go_left = np.where(np.isnan(v), miss[node], v < cut[node])
            at[rows] = np.where(go_left, left[node], right[node])


class Model:
    """Sum of trees over a base value."""

    def __init__(self, features: Sequence[str], base: float, trees: list[Tree], params: Params, best_iteration: int, valid_error: float | None = None) -> None:
        self.features, self.base, self.trees, self.params, self.best_iteration = list(features), base, trees, params, best_iteration
        #: Mean absolute error over the validation rows it was trained with; not saved.
        self.valid_error = valid_error
        #: Its JSON on the executors; scoring and selection then need no trees here.
        self.sent: Broadcast | None = None
        self._ready: tuple | None = None

    def _prepared(self) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
        """(sorted cuts of each feature; per tree its depth, features, cuts by number, missing_left, children in pairs and values)."""
        if self._ready is None:
            used: list[list[np.ndarray]] = [[] for _ in self.features]
            arrays = [tuple(np.array(v) for v in (t.feature, t.cut, t.missing_left, t.left, t.right, t.value)) for t in self.trees]
            for feature, cut, *_ in arrays:
                for j in np.unique(feature[feature >= 0]):
                    used[j].append(cut[feature == j])
            cuts = [np.unique(np.concatenate(u)) if u else np.zeros(0) for u in used]
            trees = []
            for feature, cut, miss, left, right, value in arrays:
                number, own = np.zeros(len(cut), dtype=np.intp), np.arange(len(cut))
                for j in np.unique(feature[feature >= 0]):
                    number[feature == j] = np.searchsorted(cuts[j], cut[feature == j])
                leaf = feature < 0
                child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel()
                depth, level = 0, np.zeros(1, dtype=int)
                while not leaf[level].all():
                    depth, level = depth + 1, np.unique(child.reshape(-1, 2)[level])
                trees.append((depth, np.where(leaf, 0, feature), number, miss, child, value))
            self._ready = cuts, trees
        return self._ready

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees; rows are led by the numbers of the cuts that their values reach."""
        cuts, trees = self._prepared()
        n = len(x)
        out = np.full(n, self.base)
        if not n or not len(cuts):
            return out + sum(t[5][0] for t in trees)
        last = max(len(c) for c in cuts) + 1
        codes = np.full((len(cuts), n), last, dtype=np.min_scalar_type(last))
        for j, c in enumerate(cuts):
            known = ~np.isnan(x[:, j])
            codes[j, known] = np.searchsorted(c, x[known, j], side="right")
        for first in range(0, n, PREDICTED):
            part = np.ascontiguousarray(codes[:, first : first + PREDICTED])
            k, flat, total = part.shape[1], part.ravel(), out[first : first + PREDICTED]
            gaps, row = bool((part == last).any()), np.arange(k)
            for depth, feature, number, miss, child, value in trees:
                begin, above, at = feature * k, number.astype(codes.dtype), np.zeros(k, dtype=np.intp)
                for _ in range(depth):
                    code = flat.take(begin.take(at) + row)
                    right = code > above.take(at)
                    if gaps:
                        right &= ~((code == last) & miss.take(at))
                    at <<= 1
                    at += right
                    at = child.take(at)
                total += value.take(at)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        return np.stack([t.leaves(x) for t in self.trees], axis=1) if self.trees else np.zeros((len(x), 0), dtype=int)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Contribution of each feature to each prediction: changes of node means along the path."""
        out = np.zeros((len(x), len(self.features)))
        for t in self.trees:
            mean = np.array(t.value)
            for node in range(len(t.feature) - 1, -1, -1):
                if t.feature[node] >= 0:
                    a, b = t.left[node], t.right[node]
                    mean[node] = (mean[a] * t.cover[a] + mean[b] * t.cover[b]) / (t.cover[a] + t.cover[b])
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = np.flatnonzero(np.array(t.feature)[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                f = np.array(t.feature)[node]
                v = x[inner, f]
                left = np.where(np.isnan(v), np.array(t.missing_left)[node], v < np.array(t.cut)[node])
                at[inner] = np.where(left, np.array(t.left)[node], np.array(t.right)[node])
                out[inner, f] += mean[at[inner]] - mean[node]
        return out

    def importances(self) -> list[dict]:
        """Per feature gain (mean per split), weight (splits) and cover (mean), each also as share; most gain first."""
        sums = {f: [0.0, 0, 0.0] for f in self.features}
        for t in self.trees:
            for f, g, c in zip(t.feature, t.gain, t.cover):
                if f >= 0:
                    s = sums[self.features[f]]
                    s[0] += g
                    s[1] += 1
                    s[2] += c
        rows = [{"feature": f, "gain": g / w, "weight": float(w), "cover": c / w} for f, (g, w, c) in sums.items() if w]
        for kind in ("gain", "weight", "cover"):
            total = sum(r[kind] for r in rows) or 1.0
            for r in rows:
                r[f"{kind}_norm"] = r[kind] / total
        return sorted(rows, key=lambda r: (-r["gain_norm"], r["feature"]))

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "base": self.base, "params": asdict(self.params), "best_iteration": self.best_iteration, "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(d["features"], d["base"], [Tree(**t) for t in d["trees"]], Params(**d["params"]), d["best_iteration"])


def _edges(x: np.ndarray) -> list[np.ndarray]:
    out = []
    for j in range(x.shape[1]):
        v = x[:, j]
        v = np.unique(v[np.isfinite(v)])
        if len(v) > BINS - 1:
            v = np.unique(np.quantile(v, np.linspace(0, 1, BINS)[1:-1]))
        out.append((v[1:] + v[:-1]) / 2 if len(v) > 1 and len(v) < BINS - 1 else v)
    return out


#: Nodes of a level whose rows are split by comparing whole columns; levels with more look each row's cut up.
COMPARED = 16
#: Rows that are led through all trees together.
PREDICTED = 8192
#: Joint columns that are kept, and sets of columns whose cells are.
KEPT = 64


class _Binned:
    """A matrix as bin numbers, one row per column; missing values have the last number."""

    def __init__(self, codes: np.ndarray, edges: list[np.ndarray], bins: int) -> None:
        self.codes, self.edges, self.bins, self.n = codes, edges, bins, codes.shape[1]
        self.missing = [bool((c == bins - 1).any()) for c in codes]
        self.rows = np.arange(self.n)
        self._joint: dict = {}
        self._cells: dict = {}

    @staticmethod
    def of(x: np.ndarray, edges: list[np.ndarray]) -> _Binned:
        bins = max((len(e) for e in edges), default=0) + 2
        codes = np.full((len(edges), len(x)), bins - 1, dtype=np.uint8)
        for j, e in enumerate(edges):
            known = ~np.isnan(x[:, j])
            codes[j, known] = np.searchsorted(e, x[known, j], side="right")
        return _Binned(codes, edges, bins)

    def joint(self, a: int, b: int) -> np.ndarray:
        """Bin numbers of two columns as one number."""
        if (found := self._joint.get((a, b))) is None:
            found = self.codes[a].astype(np.int16) * np.int16(self.bins) + self.codes[b]
            if len(self._joint) < KEPT:
                self._joint[a, b] = found
        return found

    def cells(self, columns: np.ndarray) -> tuple[_Binned, np.ndarray] | None:
        """Distinct rows of these columns and the one of each row, where they are less than half as many; None if not, or if sets of so many columns are too many to keep."""
        d, k = len(self.codes), len(columns)
        if k > 10 or math.comb(d, k) > KEPT // 4:
            return None
        key = tuple(columns)
        if key not in self._cells:
            at = np.zeros(self.n, dtype=np.int64)
            for j in key:
                at = at * self.bins + self.codes[j]
            _, first, inverse = np.unique(at, return_index=True, return_inverse=True)
            self._cells[key] = (_Binned(np.ascontiguousarray(self.codes[:, first]), self.edges, self.bins), inverse.reshape(-1)) if 2 * len(first) < self.n else None
        return self._cells[key]

    def sums(self, columns: np.ndarray, rows: np.ndarray | None, slot: np.ndarray | None, slots: int, grad: np.ndarray, hess: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and hessians by slot, column and bin, over ``rows`` (None: the first ``limit``)."""
        s = self.bins
        out = np.empty((2, slots, len(columns), s))
        pick = (lambda v: v[:limit]) if rows is None else (lambda v: v.take(rows))
        g, h = pick(grad), None if hess is None else pick(hess)

        def add(code: np.ndarray, width: int) -> list[np.ndarray]:
            at = pick(code) if slot is None else slot * width + pick(code)
            return [np.bincount(at, weights=w, minlength=slots * width).reshape(slots, width) for w in (g, h)]

        i = 0
        while i < len(columns):
            # Two columns at once, where their joint bins are few beside the rows.
            if i + 1 < len(columns) and 2 * slots * s * s <= len(g):
                for o, v in zip(out, add(self.joint(columns[i], columns[i + 1]), s * s)):
                    v = v.reshape(slots, s, s)
                    o[:, i], o[:, i + 1] = v.sum(axis=2), v.sum(axis=1)
                i += 2
            else:
                for o, v in zip(out, add(self.codes[columns[i]], s)):
                    o[:, i] = v
                i += 1
        return out[0], out[1]


def _grow(b: _Binned, grad: np.ndarray, hess: np.ndarray | None, use: np.ndarray | None, columns: np.ndarray, p: Params, rng: np.random.Generator, exact: bool = True) -> tuple[Tree, np.ndarray]:
    """(tree, its value for every row of ``b``), grown level by level.

    Gradients are those of the first rows, ``use`` of them (None: all); the rest is only led to its leaves.
    Without ``hess`` each row counts 1. With ``exact`` hessians (whole numbers) only the smaller child of a
    node is summed up, the other one is the difference.
    """
    t, n, s = Tree(), len(grad), b.bins
    any_missing = any(b.missing[j] for j in columns)
    open_bins = np.array([[i < len(b.edges[j]) for i in range(s - 1)] for j in columns])

    def shrunk(g):
        """Sums of gradients drawn towards 0 by reg_alpha."""
        return np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0) if p.reg_alpha else g

    def nodes(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        k, first = len(g), len(t.feature)
        for column, v in zip((t.feature, t.cut, t.missing_left, t.left, t.right, t.gain), (-1, 0.0, True, -1, -1, 0.0)):
            column.extend([v] * k)
        t.value.extend((-shrunk(g) / (h + p.reg_lambda) * p.learning_rate).tolist())
        t.cover.extend(h.tolist())
        return np.arange(first, first + k)

    rows = None if use is None else np.flatnonzero(use)
    sums_g, sums_h = b.sums(columns, rows, None, 1, grad, hess, n)
    # By slot: its node, and its place among the open nodes of the level (-1: a leaf).
    tot_g, tot_h = sums_g[:, 0].sum(axis=1), sums_h[:, 0].sum(axis=1)
    node, place = nodes(tot_g, tot_h), np.zeros(1, dtype=int)
    pos = np.zeros(b.n, dtype=np.uint8)
    for depth in range(p.max_depth):
        # --- the best split of every open node
        k = len(tot_g)
        gl, hl = sums_g[:, :, None, :-1].cumsum(axis=3), sums_h[:, :, None, :-1].cumsum(axis=3)
        if any_missing:
            gl, hl = np.concatenate([gl + sums_g[:, :, None, -1:], gl], axis=2), np.concatenate([hl + sums_h[:, :, None, -1:], hl], axis=2)
        g, h = tot_g[:, None, None, None], tot_h[:, None, None, None]
        ok = (hl >= p.min_child) & (h - hl >= p.min_child) & open_bins[:, None, :]
        if p.colsample_node < 1:
            few = rng.random((k, len(columns))).argsort(axis=1).argsort(axis=1) < max(1, round(p.colsample_node * len(columns)))
            ok &= few[:, :, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, shrunk(gl) ** 2 / (hl + p.reg_lambda) + shrunk(g - gl) ** 2 / (h - hl + p.reg_lambda) - shrunk(g) ** 2 / (h + p.reg_lambda), -np.inf) / 2 - p.gamma
        best = gain.reshape(k, -1).argmax(axis=1)
        top = gain.reshape(k, -1)[np.arange(k), best]
        split = top > 1e-12
        if not split.any():
            break
        which, way, cut = np.unravel_index(best, gain.shape[1:])
        left_g, left_h = gl.reshape(k, -1)[np.arange(k), best], hl.reshape(k, -1)[np.arange(k), best]
        # --- its rows
        m = len(node)
        parents = np.flatnonzero(place >= 0)
        parents = parents[split[place[parents]]]
        of = place[parents]
        feature = columns[which[of]]
        for q, j, i, w, r in zip(node[parents].tolist(), feature.tolist(), cut[of].tolist(), way[of].tolist(), top[of].tolist()):
            t.feature[q], t.cut[q], t.missing_left[q], t.gain[q] = j, float(b.edges[j][i]), w == 0, r
        if len(parents) <= COMPARED and pos.dtype == np.uint8:
            right = np.zeros(b.n, dtype=bool)
            for q, j, i, w in zip(parents.tolist(), feature.tolist(), cut[of].tolist(), way[of].tolist()):
                there = b.codes[j] > i
                if b.missing[j] and w == 0:
                    there &= b.codes[j] != s - 1
                if m > 1:
                    there &= pos == np.uint8(q)
                right |= there
        else:
            at = pos.astype(np.intp)
            begin, above, stays = np.zeros(m, dtype=np.intp), np.full(m, 255, dtype=np.uint8), np.zeros(m, dtype=bool)
            begin[parents], above[parents], stays[parents] = feature * b.n, cut[of], way[of] == 0
            code = b.codes.ravel().take(begin.take(at) + b.rows)
            right = code > above.take(at)
            if any_missing:
                right &= ~((code == s - 1) & stays.take(at))
        # --- the slots of the next level: a left and a right one for each, or, if these are too many for bytes, one for each leaf
        child_g, child_h = np.stack([left_g[of], tot_g[of] - left_g[of]], axis=1), np.stack([left_h[of], tot_h[of] - left_h[of]], axis=1)
        made = nodes(child_g.ravel(), child_h.ravel()).reshape(-1, 2)
        for q, (x, y) in zip(node[parents].tolist(), made.tolist()):
            t.left[q], t.right[q] = x, y
        ids = np.repeat(node, 2)
        ids[2 * parents], ids[2 * parents + 1] = made[:, 0], made[:, 1]
        opened = np.full(2 * m, -1)
        opened[2 * parents], opened[2 * parents + 1] = 2 * np.arange(len(parents)), 2 * np.arange(len(parents)) + 1
        if 2 * m <= 256:
            pos = (pos << 1) | right.view(np.uint8)
            node, place = ids, opened
        else:
            kept = np.ones(2 * m, dtype=bool)
            kept[1::2] = False
            kept[2 * parents + 1] = True
            pos = (np.cumsum(kept) - 1).take((pos.astype(np.intp) << 1) | right)
            node, place = ids[kept], opened[kept]
        tot_g, tot_h = child_g.ravel(), child_h.ravel()
        if depth + 1 == p.max_depth:
            break
        # --- their sums
        k = len(parents)
        small = 2 * np.arange(k) + (child_h[:, 1] < child_h[:, 0]) if exact else np.arange(2 * k)
        number = np.full(2 * k + 1, -1)
        number[small] = np.arange(len(small))
        number = number[place]
        if len(small) <= COMPARED // 2 and pos.dtype == np.uint8:
            chosen = np.zeros(n, dtype=bool)
            for q in np.flatnonzero(number >= 0):
                chosen |= pos[:n] == np.uint8(q)
        else:
            chosen = (number >= 0).take(pos[:n].astype(np.intp))
        if use is not None:
            chosen &= use
        rows = np.flatnonzero(chosen)
        some_g, some_h = b.sums(columns, rows, number.take(pos.take(rows).astype(np.intp)), len(small), grad, hess, n)
        if exact:
            next_g, next_h = np.empty((2 * k, *some_g.shape[1:])), np.empty((2 * k, *some_g.shape[1:]))
            next_g[small], next_h[small] = some_g, some_h
            next_g[small ^ 1], next_h[small ^ 1] = sums_g[of] - some_g, sums_h[of] - some_h
            next_g[next_h == 0] = 0.0
            sums_g, sums_h = next_g, next_h
        else:
            sums_g, sums_h = some_g, some_h
    return t, np.array(t.value)[node].take(pos.astype(np.intp))


def train(x: np.ndarray, y: np.ndarray, features: Sequence[str], p: Params, weight: np.ndarray | None = None, valid: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Squared-error boosting; with validation rows it stops after ``patience`` rounds without a lower absolute error.

    Rows that are alike in the columns of a tree are summed up first, where that leaves less than half of them.
    """
    rng = np.random.default_rng(p.seed)
    n, w = len(y), None if weight is None else np.asarray(weight, dtype=float)
    binned = _Binned.of(x if valid is None else np.concatenate([x, valid[0]]), _edges(x))
    base = float(np.average(y, weights=w)) if n else 0.0
    fit = np.full(binned.n, base) if x.shape[1] else np.full(n + (0 if valid is None else len(valid[1])), base)
    trees: list[Tree] = []
    best, best_at = math.inf, 0
    for i in range(p.n_trees):
        use = rng.random(n) < p.subsample if p.subsample < 1 else None
        columns = np.sort(rng.permutation(x.shape[1])[: max(1, round(p.colsample * x.shape[1]))])
        if not n or not len(columns) or use is not None and not use.any():
            break
        grad = fit[:n] - y
        if w is not None:
            grad *= w
        if cells := binned.cells(columns):
            of, inverse = cells[0], cells[1][:n]
            if use is not None:
                grad = grad * use
            hess = np.bincount(inverse, weights=use if w is None else w if use is None else w * use, minlength=of.n).astype(float)
            t, values = _grow(of, np.bincount(inverse, weights=grad, minlength=of.n), hess, hess > 0, columns, p, rng, w is None)
            values = values.take(cells[1])
        else:
            t, values = _grow(binned, grad, w, use, columns, p, rng, w is None)
        trees.append(t)
        fit += values
        if valid is not None:
            error = float(np.abs(fit[n:] - valid[1]).mean())
            if error < best:
                best, best_at = error, i
            elif i - best_at >= p.patience:
                break
    if valid is not None:
        trees = trees[: best_at + 1]
    return Model(features, base, trees, p, best_at if valid is not None else len(trees) - 1, best if valid is not None and trees else None)


def matrix(df: DataFrame, features: Sequence[str], target: str, key: str) -> pd.DataFrame:
    """The training matrix on the driver: key, features as doubles, target, split; its size is checked against MAX_ROWS."""
    rows = df.select(key, *(F.col(c).cast("double").alias(c) for c in features), F.col(target).cast("double").alias(target), "split").filter(F.col(target).isNotNull() & ~F.isnan(target))
    n = rows.limit(MAX_ROWS + 1).count()
    if n > MAX_ROWS or n * len(rows.columns) > MAX_CELLS:
        raise ValueError(f"more than {MAX_ROWS} training rows or {MAX_CELLS} cells")
    return rows.toPandas().sort_values(key, kind="stable")


def matrices(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: str) -> dict[str, Broadcast]:
    """Per target with ten rows or more its features, values, and which rows are train and val, for the executors."""
    found = {}
    for t in targets:
        m = matrix(df, features, t, key)
        if len(m) >= 10:
            found[t] = df.sparkSession.sparkContext.broadcast((m[list(features)].to_numpy(float), m[t].to_numpy(float), (m["split"] == "train").to_numpy(), (m["split"] == "val").to_numpy()))
    return found


def trials(n: int, seed: int = 42, grid: dict = GRID) -> list[dict]:
    """Seeded random points of the grid; for n = 0 the one point of the base parameters."""
    if n == 0:
        base = asdict(Params())
        return [{k: base[k] for k in grid}]
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in grid.items()} for _ in range(n)]


def search(df: DataFrame, sets: dict[str, Sequence[str]], targets: Sequence[str], key: str, n_trials: int = 20, most_trees: int | None = None, seed: int = 42, models: bool = True, shared: dict[str, Broadcast] | None = None) -> DataFrame:
    """Random search over target × feature set × trial as one job: target, feature_set, trial, params_json, n_features, n_train, n_val, val_mae, best_iteration, model_json.

    ``df`` has the features, targets and split (train or val). Targets with fewer than ten rows give no
    row. Trials take their number of trees from the grid, at most ``most_trees`` if that is given, and stop early.
    The matrices are sent to the workers one target at a time; each has at most MAX_ROWS rows and MAX_CELLS cells.
    Each trial is a task of its own, the longest first. Without ``models`` model_json is null.
    ``shared``: the matrices of all features of the sets in order of name, where they are at hand.
    """
    spark = df.sparkSession
    every = sorted({c for columns in sets.values() for c in columns})
    # One broadcast per target: a task reads the matrices of its own work items only.
    shared = matrices(df, every, targets, key) if shared is None else shared
    names = {k: list(v) for k, v in sets.items()}
    items = [(t, s, i, json.dumps(p)) for (t, s), (i, p) in itertools.product(itertools.product(shared, names), enumerate(trials(n_trials, seed)))]
    schema = "target string, feature_set string, trial int, params_json string, n_features int, n_train long, n_val long, val_mae double, best_iteration int, model_json string"
    if not items:
        return spark.createDataFrame([], schema)

    def chosen(p: str, i: int) -> Params:
        values = json.loads(p)
        return Params(**{**values, "n_trees": min(values["n_trees"], most_trees or values["n_trees"]), "seed": seed + i})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, s, i, p in batch.itertuples(index=False):
                x, y, tr, va = shared[t].value
                columns = names[s]
                x = x[:, [every.index(c) for c in columns]]
                held = (x[va], y[va]) if va.any() else None
                model = train(x[tr], y[tr], columns, chosen(p, i), valid=held)
                error = float("nan") if held is None else model.valid_error if model.valid_error is not None else float(np.abs(model.predict(held[0]) - held[1]).mean())
                rows.append((t, s, i, p, len(columns), int(tr.sum()), int(va.sum()), error, model.best_iteration, model.to_json() if models else None))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    def effort(item: tuple) -> float:
        p = chosen(item[3], item[2])
        return p.n_trees * p.max_depth * max(1, round(p.colsample * len(names[item[1]])))

    # Tasks start in the order of their partitions.
    items.sort(key=lambda item: -effort(item))
    work = spark.createDataFrame(spark.sparkContext.parallelize(items, len(items)), "target string, feature_set string, trial int, params_json string")
    return work.mapInPandas(run, schema)


def best_trials(searched: DataFrame) -> DataFrame:
    """The trial with the lowest validation error per target and feature set (ties: the first)."""
    return searched.groupBy("target", "feature_set").agg(F.min_by(F.struct(*searched.columns[2:]), F.struct("val_mae", "trial")).alias("b")).select("target", "feature_set", "b.*")


def score(df: DataFrame, model: Model, output: str, fill: float = float("nan")) -> DataFrame:
    """``df`` with the model's prediction; missing feature columns are filled, nulls are missing values."""
    from pagelens.operators.matrix import aligned

    sent, text = model.sent, model.to_json() if model.sent is None else None
    names = aligned(df, model.features, fill).columns
    inputs = [F.col(c).cast("double") if c in df.columns else F.lit(fill) for c in names]

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = Model.from_json(text if sent is None else sent.value)
        for rows in batches:
            yield pd.Series(m.predict(rows.to_numpy(float)))

    # One struct, so a model of one feature gets its rows like any other.
    return df.withColumn(output, predict(F.struct(*(c.alias(f"f{i}") for i, c in enumerate(inputs)))))


def score_test_set(df: DataFrame, model: Model, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    """A trained model on a test set: (predictions, error).

    predictions has the key, gt (null where the target is missing or not finite; absent without such a
    column) and pred; features the table lacks count as missing. error has one row: target, n and
    mae over rows with a target, null if there are none or the column is absent.
    """
    scored = score(df, model, "pred")
    if target not in df.columns:
        none = df.sparkSession.createDataFrame([(target, 0, None)], "target string, n long, mae double")
        return scored.select(key, "pred"), none
    value = F.col(target).cast("double")
    rows = scored.select(key, F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("gt"), "pred")
    return rows, rows.agg(F.lit(target).alias("target"), F.count("gt").alias("n"), F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("mae"))


def _rises(model: Model, x: np.ndarray, y: np.ndarray, base: float, j: int, repeats: int, seed: int) -> list[float]:
    """Rises in absolute error over ``base`` when feature ``j`` is shuffled, by the draws that follow those of the features before it."""
    rng = np.random.default_rng(seed)
    for i in range(j * repeats):
        rng.permutation(x[:, i // repeats])
    rises, z = [], x.copy()
    for _ in range(repeats):
        z[:, j] = rng.permutation(x[:, j])
        rises.append(np.abs(model.predict(z) - y).mean() - base)
    return rises


def permutation_importance(model: Model, x: np.ndarray, y: np.ndarray, repeats: int = 3, seed: int = 42) -> list[tuple[str, float, float]]:
    """(feature, mean, deviation) of the rise in absolute error when the feature's values are shuffled; largest first."""
    base = np.abs(model.predict(x) - y).mean()
    rows = [(name, _rises(model, x, y, base, j, repeats, seed)) for j, name in enumerate(model.features)]
    return sorted(((name, float(np.mean(r)), float(np.std(r))) for name, r in rows), key=lambda r: (-r[1], r[0]))


def sent(spark: SparkSession, text: str, features: Sequence[str], params: Params, best_iteration: int, valid_error: float | None) -> tuple[Model, list[dict]]:
    """(a saved model that is on the executors only, its importances): trees of large models are not held on the driver."""
    model = Model(features, 0.0, [], params, best_iteration, valid_error)
    model.sent = shared = spark.sparkContext.broadcast(text)
    return model, spark.sparkContext.parallelize([0], 1).map(lambda _: Model.from_json(shared.value).importances()).first()


def selected(spark: SparkSession, model: Model, shared: Broadcast, features: Sequence[str], how: str, top: int, seed: int = 42) -> list[str]:
    """The model's features that permutation or stability selection chooses over its validation rows, most important first.

    ``features`` names the columns of the shared matrix. A task shuffles one feature, or does one bootstrap round.
    """
    columns, text = [list(features).index(c) for c in model.features], model.sent or spark.sparkContext.broadcast(model.to_json())
    base, rounds = model.valid_error, 10

    def run(i: int) -> list[tuple[str, float]]:
        x, y, tr, va = shared.value
        x, m = x[:, columns], Model.from_json(text.value)
        if how == "permutation":
            error = np.abs(m.predict(x[va]) - y[va]).mean() if base is None else base
            return [(m.features[i], float(np.mean(_rises(m, x[va], y[va], error, i, 3, seed))))]
        return [(f, 1.0) for f in stable_round(x[tr], y[tr], (x[va], y[va]), m.features, m.params, i, top, seed)]

    n = len(model.features) if how == "permutation" else rounds
    found = [r for part in spark.sparkContext.parallelize(range(n), n).map(run).collect() for r in part] if n else []
    if how == "permutation":
        return [f for f, _ in sorted(found, key=lambda r: (-r[1], r[0]))[:top]]
    return most_stable([f for f, _ in found], model.features, rounds, top)[0]


def refitted(spark: SparkSession, work: Sequence[tuple[str, str, Params, Sequence[str]]], shared: dict[str, Broadcast], features: Sequence[str]) -> DataFrame:
    """Models of (target, feature set, parameters, features) trained as one task each: target, feature_set, val_mae, best_iteration, model_json."""
    columns, items = list(features), [(t, s, json.dumps(asdict(p)), list(names)) for t, s, p, names in work]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, s, p, names in batch.itertuples(index=False):
                x, y, tr, va = shared[t].value
                names = list(names)
                x = x[:, [columns.index(c) for c in names]]
                model = train(x[tr], y[tr], names, Params(**json.loads(p)), valid=(x[va], y[va]))
                error = model.valid_error if model.valid_error is not None else float(np.abs(model.predict(x[va]) - y[va]).mean())
                yield pd.DataFrame([(t, s, error, model.best_iteration, model.to_json())], columns=["target", "feature_set", "val_mae", "best_iteration", "model_json"])

    rows = spark.createDataFrame(spark.sparkContext.parallelize(items, len(items)), "target string, feature_set string, params string, features array<string>")
    return rows.mapInPandas(run, "target string, feature_set string, val_mae double, best_iteration int, model_json string")


def stable_round(x: np.ndarray, y: np.ndarray, valid: tuple[np.ndarray, np.ndarray], features: Sequence[str], p: Params, i: int, top: int, seed: int) -> list[str]:
    """The top features that help a model of the i-th bootstrap sample."""
    rng = np.random.default_rng(seed)
    for _ in range(i + 1):
        rows = rng.integers(0, len(y), len(y))
    model = train(x[rows], y[rows], features, Params(**{**asdict(p), "seed": p.seed + i}), valid=valid)
    return [name for name, gain, _ in permutation_importance(model, *valid, repeats=1, seed=seed + i)[:top] if gain > 0]


def most_stable(found: Sequence[str], features: Sequence[str], rounds: int, top: int, least: float = 0.6) -> tuple[list[str], dict[str, float]]:
    """Features found in at least that share of the rounds, and the share of each; the most frequent if none is."""
    share = {f: found.count(f) / rounds for f in features}
    chosen = [f for f in features if share[f] >= least]
    return chosen or sorted(features, key=lambda f: (-share[f], f))[:top], share


def stability_selection(x: np.ndarray, y: np.ndarray, valid: tuple[np.ndarray, np.ndarray], features: Sequence[str], p: Params, rounds: int = 10, top: int = 20, least: float = 0.6, seed: int = 42) -> tuple[list[str], dict[str, float]]:
    """Features among the top ones in at least that share of bootstrap rounds, and how often each was; the most frequent if none is."""
    found = [f for i in range(rounds) for f in stable_round(x, y, valid, features, p, i, top, seed)]
    return most_stable(found, features, rounds, top, least)


def meta_features(models: Sequence[Model], final: Model, x: np.ndarray) -> pd.DataFrame:
    """What an error model sees of a prediction: spread over fold models, leaves visited, and contributions."""
    each = np.stack([m.predict(x) for m in models], axis=1)
    leaves = final.leaves(x)
    n = max(1, leaves.shape[1])
    contributions = final.contributions(x)
    size = np.abs(contributions)
    share = np.divide(size, size.sum(axis=1, keepdims=True), out=np.zeros_like(size), where=size.sum(axis=1, keepdims=True) > 0)

    def leaf_entropy(row: np.ndarray) -> float:
        p = np.unique(row, return_counts=True)[1] / len(row)
        return float(-(p * np.log(p)).sum() / np.log(len(row))) if len(row) > 1 else 0.0

    return pd.DataFrame(
        {
            "pred": final.predict(x), "ens_mean": each.mean(axis=1), "ens_std": each.std(axis=1), "ens_min": each.min(axis=1), "ens_max": each.max(axis=1),
            "ens_range": np.ptp(each, axis=1), "leaf_unique_ratio": [len(set(r)) / n for r in leaves], "leaf_entropy": [leaf_entropy(r) for r in leaves],
            "contrib_abs_sum": size.sum(axis=1), "contrib_abs_max": size.max(axis=1) if size.shape[1] else 0.0,
            "contrib_entropy": -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1),
            "n_missing": np.isnan(x).sum(axis=1).astype(float),
        }
    )


def error_model(x: np.ndarray, y: np.ndarray, fold: np.ndarray, features: Sequence[str], p: Params) -> tuple[Model, Model, np.ndarray]:
    """(main model, model of its absolute error in percent points, out-of-fold predictions)."""
    oof, models = np.zeros(len(y)), []
    for k in np.unique(fold):
        m = train(x[fold != k], y[fold != k], features, p)
        oof[fold == k] = m.predict(x[fold == k])
        models.append(m)
    final = train(x, y, features, p)
    meta = meta_features(models, final, x)
    return final, train(meta.to_numpy(float), 100 * np.abs(oof - y), list(meta.columns), p), oof


#: Partial sums that reach the driver, and partial sums that one task adds up.
PARTS, FAN_IN = 16, 256


def pca_fit(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components k × d) of an array column, over the rows whose vector is as long as the first one's.

    Sums and products of each partition are added up by executors, level by level, so at most PARTS
    matrices of d × d numbers reach the driver, however many partitions there are.
    """
    width = df.select(F.size(vector).alias("n")).filter("n > 0").first().n

    def batch(n: int, s: np.ndarray, ss: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None and len(v) == width], dtype=float).reshape(-1, width)
            n += len(x)
            s += x.sum(axis=0)
            ss += x.T @ x
        yield batch(n, s, ss)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(width), np.zeros(width * width)
        for b in batches:
            for i in range(b.num_rows):
                n += b.column(0)[i].as_py()
                s += b.column(1)[i].values.to_numpy()
                ss += b.column(2)[i].values.to_numpy()
        yield batch(n, s, ss)

    schema = "n long, s array<double>, ss array<double>"
    sums = durable(df.select(vector).mapInArrow(first, schema), "sums")
    parts = sums.count()
    while parts > PARTS:
        parts = -(-parts // FAN_IN)
        sums = durable(sums.repartition(parts).mapInArrow(added, schema), "sums")
    rows = collect_small(sums, PARTS, "partial sums")
    n = sum(r.n for r in rows)
    mean = sum(np.array(r.s) for r in rows) / n
    cov = sum(np.array(r.ss) for r in rows).reshape(width, width) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    components = vectors[:, ::-1][:, :k].T
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    return mean, components * signs[:, None]


def pca_transform(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, prefix: str = "dit_emb") -> DataFrame:
    """``df`` with columns prefix_000… of the centred, projected vector."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list((np.stack(batch.to_numpy()) - mean) @ components.T))

    out = df.withColumn("_p", project(vector))
    return out.select("*", *(F.get("_p", i).alias(f"{prefix}_{i:03d}") for i in range(len(components)))).drop("_p")
