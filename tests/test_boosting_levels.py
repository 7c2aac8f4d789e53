import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import boosting as B


def plain_tree(x, grad, hess, p, edges, depth=0):
    """The value of every row by a tree grown node by node, each cut tried over the rows themselves."""
    value = np.full(len(x), -grad.sum() / (hess.sum() + p.reg_lambda) * p.learning_rate)
    best = (1e-12, None)
    for j, e in enumerate(edges):
        for stays in (True, False):
            for cut in e:
                left = np.where(np.isnan(x[:, j]), stays, x[:, j] < cut)
                a, b = grad[left].sum(), hess[left].sum()
                c, d = grad[~left].sum(), hess[~left].sum()
                if b >= p.min_child and d >= p.min_child:
                    gain = (a * a / (b + p.reg_lambda) + c * c / (d + p.reg_lambda) - (a + c) ** 2 / (b + d + p.reg_lambda)) / 2 - p.gamma
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
    if depth < p.max_depth and best[1] is not None:
        for side in (best[1], ~best[1]):
            value[side] = plain_tree(x[side], grad[side], hess[side], p, edges, depth + 1)
    return value


@pytest.mark.parametrize("kind", ["plain", "missing", "weights", "alike"])
def test_trees_equal_plain_ones(kind):
    rng = np.random.default_rng(3)
    x = rng.random((300, 3)) if kind != "alike" else rng.integers(0, 4, (300, 3)).astype(float)
    y = 3 * x[:, 0] + np.sin(9 * x[:, 1]) + rng.normal(size=300)
    if kind == "missing":
        x[rng.random(x.shape) < 0.2] = np.nan
    w = rng.random(300) + 0.5 if kind == "weights" else None
    p = B.Params(n_trees=1, max_depth=3, min_child=5, subsample=1.0, colsample=1.0, learning_rate=0.5)
    h = np.ones(300) if w is None else w
    m = B.train(x, y, list("abc"), p, weight=w)
    expected = m.base + plain_tree(x, h * (m.base - y), h, p, B._edges(x))
    assert np.allclose(m.predict(x), expected)
    assert (B._Binned.of(x, B._edges(x)).cells(np.arange(3)) is not None) == (kind == "alike")


def test_sums_are_by_level(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.random((2000, 4)), rng.random(2000)
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *args, **kwargs: calls.append(1) or count(*args, **kwargs))
    m = B.train(x, y, list("abcd"), B.Params(n_trees=10, max_depth=7, colsample=1.0))
    assert sum(len(t.feature) for t in m.trees) > 800 and len(calls) <= 10 * 7 * 4 * 2


def test_validation_error_is_that_of_the_model():
    rng = np.random.default_rng(5)
    x, y = rng.random((400, 2)), rng.random(400)
    x[::6, 0], x[::11, 1] = np.inf, np.nan
    m = B.train(x[:300], y[:300], ["a", "b"], B.Params(n_trees=30), valid=(x[300:], y[300:]))
    assert m.valid_error == np.abs(m.predict(x[300:]) - y[300:]).mean()
    x[::7, 0], x[::5, 1] = np.nan, np.inf
    by_tree = m.base + sum(np.array(t.value)[t.leaves(x)] for t in m.trees)
    assert np.allclose(m.predict(x), by_tree)


def test_search_without_models_gives_the_same_errors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, v), float(v[0] + rng.random()), "train" if i % 4 else "val") for i, v in enumerate(rng.random((120, 2)))]
    df = spark.createDataFrame(rows, "key long, a double, b double, target_y double, split string")
    args = (df, {"full": ["a", "b"], "one": ["b"]}, ["target_y"], "key")
    plain, bare = B.search(*args, n_trials=3, most_trees=20), B.search(*args, n_trials=3, most_trees=20, models=False)
    # One task a trial.
    assert bare.select(F.spark_partition_id()).distinct().count() == 6
    found = [{tuple(r) for r in d.drop("model_json").collect()} for d in (plain, bare)]
    assert found[0] == found[1] and len(found[0]) == 6
    assert bare.filter("model_json IS NOT NULL").count() == 0 and plain.filter("model_json IS NULL").count() == 0
    for r in plain.collect():
        held = df.filter("split = 'val'").toPandas()
        m = B.Model.from_json(r.model_json)
        assert r.val_mae == pytest.approx(np.abs(m.predict(held[m.features].to_numpy(float)) - held["target_y"]).mean())
