"""The dataset builder: ground truth and recogniser pages of several datasets to one wide table, with the pages that failed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.evaluate import TARGETS, evaluate
from pagelens.plans import language
from pagelens.plans.features import GROUPS, page_features
from pagelens.runtime import durable
from pagelens.sources import files, ground_truth, page_json


def build(
    spark: SparkSession, specs: Sequence[tuple[str, str, str]], groups: Iterable[str] | None = None, targets: Sequence[str] | None = None, edges: dict[str, Sequence[float]] | None = None,
    insertion: float = 1.0, resources: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(wide table, errors) of datasets given as (tag, ground-truth folder, prediction folder).

    Pages are paired by file stem, read once, and joined as one row per page. The wide table has
    page_id (tag__stem), source_page_id, dataset_tag, then features and targets in order of name; a page
    that fails anywhere is in errors (page_id, stage, message) instead. Unknown targets are a ValueError.
    ``insertion`` is the cost of a character of an extra line in the strict error rate. ``resources`` adds the
    groups that need more than a page: ``ngram`` (sets: n, gram) and ``lm`` (counts, totals of one order);
    with ``groups`` given they are added only if named there (``interaction`` comes with ``lm``).
    """
    chosen = list(targets or TARGETS)
    if unknown := set(chosen) - set(TARGETS):
        raise ValueError(f"unknown targets: {sorted(unknown)}")

    def side(folder: int, pattern: str) -> DataFrame:
        parts = []
        for s in specs:
            rows = files.indexed(spark, s[folder], pattern).select("stem", "content")
            parts.append(rows.select(F.concat(F.lit(f"{s[0]}__"), "stem").alias("page_id"), F.col("stem").alias("source_page_id"), F.lit(s[0]).alias("dataset_tag"), "content"))
        return reduce(DataFrame.unionByName, parts)

    truth_files, read_files = side(1, "*.xml"), side(2, "*.json")
    ids = durable(truth_files.select("page_id", "source_page_id", "dataset_tag").join(read_files.select("page_id"), "page_id"), "pairs")
    truth = durable(ground_truth.pages(truth_files.join(ids.select("page_id"), "page_id", "left_semi"), "page_id"), "truth")
    read = durable(page_json.pages(read_files.join(ids.select("page_id"), "page_id", "left_semi").select("page_id", F.decode("content", "UTF-8").alias("body")), "page_id"), "read")
    scored = durable(evaluate(truth.filter("error IS NULL"), read.filter("error IS NULL"), "page_id", insertion), "scored")
    own = [g for g in groups or GROUPS if g in GROUPS]
    features = page_features(read, own, edges, "page_id") if own else read.filter("error IS NULL").select("page_id")
    if unknown := set(groups or ()) - {*GROUPS, "ngram", "lm", "interaction"}:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    wanted = lambda *names: not groups or any(g in names for g in groups)
    if "ngram" in (resources or {}) and wanted("ngram"):
        features = features.join(language.ngram_features(read, resources["ngram"], "page_id"), "page_id")
    if "lm" in (resources or {}) and wanted("lm", "interaction"):
        counts, totals = resources["lm"]
        first = counts.select(F.length("context") + F.length("token")).first()
        features = features.join(language.model_features(read, counts, totals, first[0] if first else 1, "page_id"), "page_id")
    wide = ids.join(features, "page_id").join(scored.filter("error IS NULL").select("page_id", *chosen), "page_id")
    keys = ["page_id", "source_page_id", "dataset_tag"]
    wide = wide.select(*keys, *sorted(c for c in wide.columns if c not in keys))
    failed = (
        ground_truth.errors(truth, "page_id").unionByName(page_json.errors(read, "page_id"))
        .unionByName(scored.filter("error IS NOT NULL").select("page_id", F.lit("targets").alias("stage"), F.col("error").alias("message")))
    )
    return wide, failed
