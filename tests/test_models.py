import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelens.operators import boosting as B
from pagelens.operators import matrix as M
from pagelens.operators import tree


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = np.where(np.isnan(x[:, 0]), 0, x[:, 0]) + 2 * (x[:, 1] > 0) + 0.05 * rng.normal(size=600)
    x[rng.random(600) < 0.1, 0] = np.nan
    return x, y


def test_boosting_learns_and_survives_saving(sample):
    x, y = sample
    m = B.train(x[:400], y[:400], list("abcd"), B.Params(n_trees=150, learning_rate=0.1), valid=(x[400:], y[400:]))
    error, base = np.abs(m.predict(x[400:]) - y[400:]).mean(), np.abs(y[400:] - y[:400].mean()).mean()
    assert error < 0.4 * base
    again = B.Model.from_json(m.to_json())
    assert np.array_equal(again.predict(x), m.predict(x))
    names = [r["feature"] for r in m.importances()]
    assert set(names[:2]) == {"a", "b"} and sum(r["gain_norm"] for r in m.importances()) == pytest.approx(1)
    assert {r[0] for r in B.permutation_importance(m, x[400:], y[400:])[:2]} == {"a", "b"}
    parts = m.contributions(x)
    shift = m.predict(x) - parts.sum(axis=1)
    assert np.allclose(shift, shift[0])


def test_stability_and_error_model(sample):
    x, y = sample
    chosen, share = B.stability_selection(x[:400], y[:400], (x[400:], y[400:]), list("abcd"), B.Params(n_trees=20, learning_rate=0.2), rounds=3, top=2)
    assert set(chosen) >= {"b"} and share["b"] == 1
    final, err, oof = B.error_model(x, y, np.arange(600) % 3, list("abcd"), B.Params(n_trees=20, learning_rate=0.2))
    assert len(oof) == 600 and len(err.features) == 12 and final.predict(x).shape == (600,)


def test_search_and_score(spark, sample):
    x, y = sample
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(target_y=y, key=range(600), split=["train"] * 400 + ["val"] * 200)
    df = spark.createDataFrame(pdf)
    found = B.best_trials(B.search(df, {"full": list("abcd"), "one": ["c"]}, ["target_y"], "key", n_trials=2, most_trees=30)).collect()
    best = {r.feature_set: r for r in found}
    assert best["full"].val_mae < best["one"].val_mae and best["full"].n_train == 400
    model = B.Model.from_json(best["full"].model_json)
    got = np.array([r.p for r in B.score(df, model, "p").orderBy("key").collect()])
    assert np.allclose(got, model.predict(x))
    assert B.score(df.drop("c"), model, "p").filter("p IS NULL").count() == 0


def test_grid_and_penalties(sample):
    assert B.trials(0) == [{k: getattr(B.Params(), k) for k in B.GRID}] and all(t[k] in B.GRID[k] for t in B.trials(30) for k in B.GRID)
    x, y = sample
    plain = B.train(x, y, list("abcd"), B.Params(n_trees=5))
    drawn = B.train(x, y, list("abcd"), B.Params(n_trees=5, reg_alpha=50.0))
    assert np.abs(drawn.predict(x) - drawn.base).max() < np.abs(plain.predict(x) - plain.base).max()
    few = B.train(x, y, list("abcd"), B.Params(n_trees=5, colsample=1.0, colsample_node=0.25))
    assert len({f for t in few.trees for f in t.feature if f >= 0}) > 1


def test_score_of_a_test_set(spark, sample):
    x, y = sample
    model = B.train(x, y, list("abcd"), B.Params(n_trees=5))
    rows = [(i, *map(float, v), [float(y[i]), None, float("nan")][0 if i % 10 else 1 + i % 20 // 10]) for i, v in enumerate(x[:100])]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, target_y double")
    scored, error = B.score_test_set(df, model, "target_y", "i")
    got = {r.i: r for r in scored.collect()}
    keep = [i for i in range(100) if i % 10]
    assert all((got[i].gt is None) == (i % 10 == 0) for i in range(100))
    e = error.first()
    assert e.n == 90 and e.mae == pytest.approx(np.abs(model.predict(x[keep]) - y[keep]).mean())
    assert B.score_test_set(df.drop("target_y"), model, "target_y", "i")[1].first().mae is None


def test_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    mean, comp = B.pca_fit(df, "v", 2)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(np.abs(comp @ vt[:2].T), np.eye(2), atol=1e-6)
    got = B.pca_transform(df, "v", mean, comp).orderBy("i").select("dit_emb_000", "dit_emb_001").toPandas().to_numpy()
    assert np.allclose(got, (x - mean) @ comp.T)


def test_matrix_operators(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, 1.0, float("nan"), None, "x", float(i % 2)) for i in range(50)], "k long, a double, b double, c double, n double, z double, s string, target_t double")
    assert M.usable_columns(df, ["k"]) == ["a", "b"]
    assert M.prune_correlated(df, ["a", "b"]) == ["a"]
    split = M.holdout(df, "k", 0.2)
    assert split.filter("split = 'val'").count() == 10
    assert {r.k for r in split.repartition(7).filter("split = 'val'").collect()} == {r.k for r in M.holdout(df.repartition(3), "k", 0.2).filter("split = 'val'").collect()}
    assert M.feature_set("confidence_only", ["line_conf_mean", "x"]) == ["line_conf_mean"]
    names = ["page_ppl", "line_ppl_std", "char_3gram_ratio_present", "dit_emb_001", "dit_other", "blur_score_var_laplacian", "fg_ratio", "fg_ratio_x", "lex_main_match_ratio", "n_lines"]
    assert M.feature_set("ngram_only", names) == names[:3] and M.feature_set("dit_only", names) == ["dit_emb_001"]
    assert M.feature_set("image_only", names) == ["blur_score_var_laplacian", "fg_ratio"] and M.feature_set("json_model_only", names) == ["dit_other", "fg_ratio_x", "n_lines"]
    with pytest.raises(ValueError):
        M.feature_set("ngram_only", ["x"])
    row = df.agg(M.mae(F.col("a"), F.col("b"), F.lit(0.0)).alias("m")).first()
    assert row.m == pytest.approx(24.5)
    assert M.aligned(df, ["a", "missing"], 0.0).first().missing == 0.0


def test_tree_steps(spark):
    rows = [("d", 0, None, 0, None, 0.0, 0.0, 100.0, 100.0), ("d", 1, 0, 1, None, 0.0, 0.0, 50.0, 50.0), ("d", 2, 1, 2, 0.9, 0.0, 0.0, 40.0, 10.0), ("d", 3, 1, 2, 0.2, 0.0, 10.0, 40.0, 10.0), ("d", 4, 0, 1, 0.5, 0.0, 60.0, 10.0, 80.0)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long, depth int, conf double, xmin double, ymin double, xmax double, ymax double")
    ids = lambda df: sorted(r.node_id for r in df.collect())
    assert ids(tree.leaves(nodes)) == [2, 3, 4]
    assert ids(tree.prune(nodes, F.col("node_id") == 1)) == [0, 4]
    assert ids(tree.low_confidence_lines(nodes, 0.3)) == [0, 1, 2, 4]
    assert {r.node_id: round(r.mean_conf, 4) for r in tree.mean_confidence(nodes).collect()}[1] == round(1.1 / 3, 4)
    assert ids(tree.low_confidence_regions(nodes, 0.4)) == [0, 4]
    assert ids(tree.by_shape(nodes, 1.0)) == [0, 1, 2]
    assert ids(tree.run(nodes, [("FilterRegionsBySize", {"min_height": 5})])) == [0, 1, 2, 4]
    with pytest.raises(RuntimeError):
        tree.run(nodes, [("Break", {})])
    with pytest.raises(KeyError):
        tree.run(nodes, [("NoSuchStep", {})])
