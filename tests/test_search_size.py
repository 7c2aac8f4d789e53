import inspect

import pytest

from pagelens import queries
from pagelens.operators import boosting
from pagelens.plans import training


class Seen(Exception):
    pass


def test_boosted_search_takes_the_defaults(spark, data, monkeypatch):
    def search(*args, **kwargs):
        raise Seen(kwargs)

    default = inspect.signature(boosting.search).parameters
    monkeypatch.setattr(boosting, "search", search)
    with pytest.raises(Seen) as seen:
        queries.boosted_search(spark, data)
    assert all(seen.value.args[0].get(k, default[k].default) == default[k].default for k in ("n_trials", "most_trees"))


def test_training_run_takes_the_defaults(spark, data, monkeypatch):
    def run(rows, cfg):
        raise Seen(cfg)

    monkeypatch.setattr(training, "run", run)
    with pytest.raises(Seen) as seen:
        queries.training_run(spark, data)
    assert (seen.value.args[0].n_trials, seen.value.args[0].most_trees) == (training.Config.n_trials, training.Config.most_trees)
