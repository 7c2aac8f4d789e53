"""Command line: build a dataset, train on datasets, score a test set.

    python -m pagelens.cli build --dataset TAG GT_DIR PRED_DIR [--dataset …] --out PATH
    python -m pagelens.cli train --train-csv PATH [--eval-csv PATH] --out PATH
    python -m pagelens.cli score --model PATH --name NAME --test-csv PATH --target NAME --out PATH

Arguments are checked before a session starts; what is wrong with them is said and the exit code is 2.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagelens.operators import boosting
from pagelens.operators.evaluate import TARGETS
from pagelens.plans import dataset, training
from pagelens.plans.features import GROUPS
from pagelens.sources import files, sinks

#: Groups that need a language model or n-gram sets besides a page's JSON.
WITH_MODEL, WITH_SETS = ("lm", "interaction"), ("ngram",)
ALL_GROUPS = (*GROUPS, *WITH_SETS, *WITH_MODEL)


def values(given: Sequence[str] | None) -> list[str] | None:
    """Items of repeated arguments that may each hold several, parted by commas; None without any."""
    found = [x.strip() for g in given or () for x in g.split(",") if x.strip()]
    return found or None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagelens", description="Page quality datasets, training and scores on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="one wide table of features and targets from ground truth and recogniser pages")
    b.add_argument("--dataset", action="append", nargs=3, metavar=("TAG", "GT_DIR", "PRED_DIR"))
    b.add_argument("--out", help="folder of the CSV; pages that failed go to OUT_errors")
    b.add_argument("--bin-config", help="fitted bin edges (JSON)")
    b.add_argument("--char-lm", help="table of n-gram counts (context, token, cnt); needed for lm and interaction")
    b.add_argument("--ngram-sets", help="table of n-gram sets (n, gram); needed for ngram")
    b.add_argument("--lambda-ins", type=float, default=1.0, help="cost of a character of an extra line in the strict error rate")
    b.add_argument("--feature", action="append", metavar="GROUP[,GROUP…]")
    b.add_argument("--target", action="append", metavar="NAME[,NAME…]")
    b.add_argument("--list-features", action="store_true")
    b.add_argument("--list-targets", action="store_true")
    t = sub.add_parser("train", help="search, baselines and selection over dataset CSVs")
    t.add_argument("--train-csv", action="append", required=True)
    t.add_argument("--eval-csv", action="append", default=[])
    t.add_argument("--out", required=True, help="folder of the reports")
    t.add_argument("--targets", default="", help="by default all columns target_*")
    t.add_argument("--feature-sets", default="single_htr_line_score_mean,confidence_only,ngram_only,full")
    t.add_argument("--preset", choices=sorted(training.PRESETS), default="search")
    t.add_argument("--key", default="page_id")
    t.add_argument("--val-size", type=float, default=0.1)
    t.add_argument("--n-trials", type=int, default=100)
    t.add_argument("--most-trees", type=int)
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--fs-apply-to", default="full,json_model_only")
    t.add_argument("--fs-top-k", type=int, default=100)
    t.add_argument("--fs-corr-threshold", type=float)
    t.add_argument("--fs-retrain-mode", choices=["refit_best_params", "small_hpo"], default="refit_best_params")
    t.add_argument("--fs-retrain-trials", type=int, default=30)
    s = sub.add_parser("score", help="predictions of a trained model and their error on a test set")
    for name in ("--model", "--name", "--test-csv", "--target", "--out"):
        s.add_argument(name, required=True)
    s.add_argument("--key", default="page_id")
    return top


def check_build(ap: argparse.ArgumentParser, args: argparse.Namespace) -> tuple[list[str] | None, list[str] | None]:
    """The chosen feature groups and targets; wrong arguments end the program."""
    if not args.out:
        ap.error("--out is required")
    if not args.dataset:
        ap.error("at least one --dataset TAG GT_DIR PRED_DIR is required")
    groups, targets = values(args.feature), values(args.target)
    if unknown := set(groups or ()) - set(ALL_GROUPS):
        ap.error(f"unknown feature groups: {', '.join(sorted(unknown))}")
    if any(g in WITH_MODEL for g in groups or ()) and not args.char_lm:
        ap.error("--char-lm is required for lm and interaction features")
    if any(g in WITH_SETS for g in groups or ()) and not args.ngram_sets:
        ap.error("--ngram-sets is required for ngram features")
    if unknown := set(targets or ()) - set(TARGETS):
        ap.error(f"unknown targets: {', '.join(sorted(unknown))}")
    return groups, targets


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = parser()
    args = ap.parse_args(argv)
    if args.command == "build" and (args.list_features or args.list_targets):
        print("\n".join([*(ALL_GROUPS if args.list_features else ()), *(TARGETS if args.list_targets else ())]))
        return 0
    if args.command == "build":
        groups, targets = check_build(ap, args)
    spark = spark or SparkSession.builder.appName("pagelens").getOrCreate()
    if args.command == "build":
        edges = sinks.load_edges(spark, args.bin_config) if args.bin_config else None
        resources = {}
        if args.ngram_sets:
            resources["ngram"] = spark.read.parquet(args.ngram_sets)
        if args.char_lm:
            counts = spark.read.parquet(args.char_lm)
            resources["lm"] = (counts, counts.groupBy("context").agg(F.sum("cnt").alias("total"), F.count("*").alias("vocab")))
        wide, failed = dataset.build(spark, [tuple(d) for d in args.dataset], groups, targets, edges, args.lambda_ins, resources)
        if not sinks.wide_csv(wide, args.out, ["page_id", "source_page_id", "dataset_tag"]):
            print("no pages")
        failed.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}_errors")
    elif args.command == "train":
        rows = files.training_table(spark, args.train_csv, args.eval_csv)
        rows = rows if args.eval_csv else rows.drop("split")
        targets = values([args.targets]) or [c for c in rows.columns if c.startswith("target_")]
        options = {
            "sets": tuple(values([args.feature_sets]) or ()), "key": args.key, "val_size": args.val_size, "seed": args.seed, "most_trees": args.most_trees,
            "correlation": args.fs_corr_threshold, "select_sets": tuple(values([args.fs_apply_to]) or ()), "top_k": args.fs_top_k, "retrain": args.fs_retrain_mode, "small_trials": args.fs_retrain_trials,
        }
        if "n_trials" not in training.PRESETS[args.preset]:
            options["n_trials"] = args.n_trials
        done = training.run(rows, training.config(args.preset, targets, **options))
        for name, table in done.items():
            table.write.mode("overwrite").csv(f"{args.out.rstrip('/')}/{name}", header=True)
    else:
        models = sinks.load_models(spark, args.model)
        if args.name not in models:
            ap.error(f"no model {args.name}; there are {', '.join(sorted(models))}")
        scored, error = boosting.score_test_set(files.csv_tables(spark, [args.test_csv]), models[args.name], args.target, args.key)
        scored.write.mode("overwrite").csv(f"{args.out.rstrip('/')}/predictions", header=True)
        error.write.mode("overwrite").csv(f"{args.out.rstrip('/')}/error", header=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
