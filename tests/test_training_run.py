import os

import numpy as np
import pytest

from pagelens.operators import boosting as B
from pagelens.plans import training


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.random((160, 4))
    y, z = x[:, 0] + 0.3 * x[:, 1] + 0.05 * rng.random(160), 1 - x[:, 2]
    return spark.createDataFrame([(i, *map(float, v), float(a), float(b), "train" if i % 4 else "eval") for i, (v, a, b) in enumerate(zip(x, y, z))], "page_id long, a_conf double, b_conf double, c double, d double, target_bow double, target_cer double, split string")


@pytest.mark.parametrize("select", ["permutation", "stability"])
def test_a_run_equals_its_steps_and_leaves_models_to_the_executors(spark, rows, monkeypatch, select):
    cfg = training.Config(("target_bow", "target_cer"), ("full", "confidence_only"), n_trials=3, most_trees=25, select=select, top_k=2)

    driver, train = os.getpid(), B.train

    def here(*args, **kwargs):
        assert os.getpid() != driver
        return train(*args, **kwargs)

    def never(*args, **kwargs):
        raise AssertionError("on the driver")

    with monkeypatch.context() as m:
        m.setattr(B, "train", here)
        m.setattr(B.Model, "predict", never)
        m.setattr(B.Model, "from_json", never)
        done = training.run(rows, cfg)
        summary = {r.model_name + r.target: r for r in done["summary"].collect()}
        names = [r.model_name for r in done["summary"].collect()]
        selection = done["selection"].collect()
    assert len(summary) == 8 and all(names[names.index(f"xgb_hpo_full_{t}") + 1] == f"xgb_hpo_full_fs_{t}" for t in cfg.targets)
    pdf = rows.toPandas().sort_values("page_id")
    tr, va = (pdf["split"] == "train").to_numpy(), (pdf["split"] == "eval").to_numpy()
    every = ["a_conf", "b_conf", "c", "d"]
    for t in cfg.targets:
        x, y = pdf[every].to_numpy(float), pdf[t].to_numpy(float)
        found = []
        for i, values in enumerate(B.trials(3)):
            p = B.Params(**{**values, "n_trees": 25, "seed": 42 + i})
            found.append((B.train(x[tr], y[tr], every, p, valid=(x[va], y[va])), p))
        model, p = min(found, key=lambda f: f[0].valid_error)
        assert summary[f"xgb_hpo_full_{t}{t}"].val_mae == pytest.approx(model.valid_error)
        if select == "permutation":
            chosen = [f for f, _, _ in B.permutation_importance(model, x[va], y[va])[:2]]
        else:
            chosen, _ = B.stability_selection(x[tr], y[tr], (x[va], y[va]), every, p, top=2)
        assert [r.feature for r in sorted(selection, key=lambda r: r.rank) if r.model_name == f"xgb_hpo_full_{t}"] == chosen
        z = pdf[chosen].to_numpy(float)
        again = B.train(z[tr], y[tr], chosen, p, valid=(z[va], y[va]))
        row = summary[f"xgb_hpo_full_fs_{t}{t}"]
        assert row.val_mae == pytest.approx(again.valid_error) and row.best_iteration == again.best_iteration and row.n_features == len(chosen)
        w = np.clip(1 + 2 * (1 - np.clip(y[va], 0, 1)) ** 2, 1, 5) if "bow" in t and -0.05 <= y.min() and y.max() <= 1.05 else np.ones(va.sum())
        assert row.val_wmae == pytest.approx(float((w * np.abs(again.predict(z[va]) - y[va])).sum() / w.sum()))


def test_a_search_of_its_own_over_the_chosen_features(spark, rows):
    cfg = training.Config(("target_bow",), n_trials=2, most_trees=10, select="permutation", top_k=2, retrain="small_hpo", small_trials=2)
    row = training.run(rows, cfg)["summary"].filter("feature_set = 'full_fs'").first()
    assert row.n_features == 2 and row.val_mae > 0
    with pytest.raises(ValueError):
        training.run(rows, training.Config(("target_bow",), n_trials=1, most_trees=2, select="permutation", retrain="no such way"))
