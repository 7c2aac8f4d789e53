"""Training runs: targets × feature sets, search, baselines, selection with retraining, and their report tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators import boosting as B
from pagelens.operators import matrix as M
from pagelens.runtime import durable


@dataclass
class Config:
    targets: Sequence[str]
    sets: Sequence[str] = ("full",)
    key: str = "page_id"
    val_size: float = 0.2
    seed: int = 42
    n_trials: int = 20
    most_trees: int | None = None  # at most so many trees a trial; None: as many as the grid says
    correlation: float | None = None  # over the training rows
    usable_in_train: bool = False  # columns must vary in the training rows, not only in all
    select: str | None = None  # "permutation" or "stability"
    select_sets: Sequence[str] = ("full",)
    top_k: int = 60
    retrain: str = "refit_best_params"  # or "small_hpo": a search of its own over the chosen features
    small_trials: int = 30
    exclude: Sequence[str] = field(default_factory=tuple)


#: Presets of earlier trainers: one fixed point of the grid, with or without a search.
PRESETS: dict[str, dict] = {
    "fixed": {"n_trials": 0},
    "importance": {"n_trials": 0, "select": "permutation"},
    "search": {},
    "search_and_select": {"select": "permutation"},
    "stable": {"select": "stability"},
}


def config(preset: str, targets: Sequence[str], **options) -> Config:
    """The configuration of a preset, changed by ``options``; unknown names are errors."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset} (one of {', '.join(PRESETS)})")
    return Config(targets, **{**PRESETS[preset], **options})


SUMMARY = "target string, model_name string, feature_set string, n_features int, n_train long, n_val long, val_mae double, val_wmae double, best_iteration int, params_json string, notes string"


def run(df: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """Tables of a run: summary, trials, importances, predictions and selection.

    ``df`` has the key, features and targets, and column split if the evaluation rows are given (train,
    eval); otherwise a seeded hash sets ceil(n · val_size) rows aside, the same for every model. Targets
    with fewer than ten values are left out. Models are named xgb_hpo_<set>[_fs]_<target>.
    """
    spark = df.sparkSession
    rows = df if "split" in df.columns else M.holdout(df, cfg.key, cfg.val_size, cfg.seed)
    rows = durable(rows.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("val")), "training")
    seen = rows.filter("split = 'train'")
    columns = M.usable_columns(seen if cfg.usable_in_train else rows, [cfg.key, *cfg.exclude])
    sets = {}
    for name in cfg.sets:
        found = M.feature_set(name, columns)
        sets[name] = M.prune_correlated(seen, found, cfg.correlation) if cfg.correlation and len(found) > 1 else found
    every = sorted({c for found in sets.values() for c in found})
    shared = B.matrices(rows, every, cfg.targets, cfg.key)
    trials = durable(B.search(rows, sets, cfg.targets, cfg.key, cfg.n_trials, cfg.most_trees, cfg.seed, shared=shared), "trials")
    # Models are fetched one at a time.
    best = B.best_trials(trials.drop("model_json")).collect()
    summary, importances, selection, scored, work, held = [], [], [], None, [], {}
    for target in cfg.targets:
        base = M.constant_baseline(rows, target).first()
        if base.mean_used is None:
            continue
        n = rows.filter((F.col("split") == "train") & F.col(target).isNotNull() & ~F.isnan(target)).count()
        summary.append((target, "baseline_constant_mean", "none", 0, n, base.n_val, base.val_mae, None, None, None, f"mean={base.mean_used}"))
    for r in best:
        row = trials.filter((F.col("target") == r.target) & (F.col("feature_set") == r.feature_set) & (F.col("trial") == r.trial)).select("model_json").first()
        p = json.loads(r.params_json)
        params = B.Params(**{**p, "n_trees": min(p["n_trees"], cfg.most_trees or p["n_trees"]), "seed": cfg.seed + r.trial})
        model, parts = B.sent(spark, row.model_json, sets[r.feature_set], params, r.best_iteration, r.val_mae if r.n_val else None)
        del row
        name = f"xgb_hpo_{r.feature_set}_{r.target}"
        if r.target not in held:
            held[r.target] = _held(rows, r.target)
        wmae = _weighted(held[r.target], model, r.target)
        summary.append((r.target, name, r.feature_set, r.n_features, r.n_train, r.n_val, r.val_mae, wmae, r.best_iteration, r.params_json, ""))
        importances += [(name, r.target, *(i[k] for k in ("feature", "gain", "gain_norm", "weight", "weight_norm", "cover", "cover_norm"))) for i in parts]
        part = B.score(rows.filter("split = 'val'"), model, "pred").select(F.col(cfg.key), F.lit(name).alias("model_name"), F.lit(r.target).alias("target"), F.col(r.target).cast("double").alias("gt"), "pred")
        scored = part if scored is None else scored.unionByName(part)
        if cfg.select and r.feature_set in cfg.select_sets and r.n_val:
            chosen = B.selected(spark, model, shared[r.target], every, cfg.select, cfg.top_k, cfg.seed)
            selection += [(name, cfg.select, i, f) for i, f in enumerate(chosen)]
            work.append((len(summary), r, model.params, chosen))
    if work and cfg.retrain not in ("refit_best_params", "small_hpo"):
        raise ValueError(f"unknown way of retraining: {cfg.retrain}")
    if work and cfg.retrain == "refit_best_params":
        again = durable(B.refitted(spark, [(r.target, r.feature_set, p, chosen) for _, r, p, chosen in work], shared, every), "refitted")
    for at, r, _, chosen in reversed(work):
        if cfg.retrain == "small_hpo":
            found = B.best_trials(B.search(rows, {"fs": chosen}, [r.target], cfg.key, cfg.small_trials, cfg.most_trees, cfg.seed + 1)).first()
            params = found.params_json
        else:
            found = again.filter((F.col("target") == r.target) & (F.col("feature_set") == r.feature_set)).first()
            params = r.params_json
        model, _ = B.sent(spark, found.model_json, chosen, B.Params(), found.best_iteration, found.val_mae)
        wmae = _weighted(held[r.target], model, r.target)
        summary.insert(at, (r.target, f"xgb_hpo_{r.feature_set}_fs_{r.target}", f"{r.feature_set}_fs", len(chosen), r.n_train, r.n_val, found.val_mae, wmae, found.best_iteration, params, f"{cfg.select}, {cfg.retrain}"))
    return {
        "summary": spark.createDataFrame(summary, SUMMARY),
        "trials": trials.drop("model_json"),
        "importances": spark.createDataFrame(
            importances, "model_name string, target string, feature string, gain double, gain_norm double, weight double, weight_norm double, cover double, cover_norm double"
        ),
        "predictions": scored if scored is not None else spark.createDataFrame([], f"{cfg.key} string, model_name string, target string, gt double, pred double"),
        "selection": spark.createDataFrame(selection, "model_name string, method string, rank int, feature string"),
    }


def _held(rows: DataFrame, target: str) -> tuple[DataFrame, float, float]:
    """Validation rows with the target, dealt out to all cores, and the target's range over all rows."""
    y = F.col(target).cast("double")
    known = rows.filter(y.isNotNull() & ~F.isnan(y))
    low, high = known.agg(F.min(y), F.max(y)).first()
    return durable(known.filter("split = 'val'").repartition(rows.sparkSession.sparkContext.defaultParallelism), "held"), low, high


def _weighted(held: tuple[DataFrame, float, float], model: B.Model, target: str) -> float | None:
    rows, low, high = held
    y = F.col(target).cast("double")
    weight = M.sample_weight(y, target, F.lit(low), F.lit(high))
    return B.score(rows, model, "pred").agg(M.mae(y, F.col("pred"), weight)).first()[0]
