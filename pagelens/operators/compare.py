"""Pairing, comparing, summarising and ranking tables of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.stats import finite


def stem(path: Column) -> Column:
    """File name without directories and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def first_per_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """stem and the first path by spelling of every stem."""
    return files.groupBy(stem(F.col(path)).alias("stem")).agg(F.min(path).alias(path))


def paired(truth: DataFrame, read: DataFrame) -> DataFrame:
    """Stems that both sides have: stem, gt_path, pred_path."""
    return first_per_stem(truth).withColumnRenamed("path", "gt_path").join(first_per_stem(read).withColumnRenamed("path", "pred_path"), "stem")


def first_existing(wanted: DataFrame, files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Per wanted stem the file with the first extension there is; null where none exists."""
    rank = F.coalesce(*(F.when(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)) == e, i) for i, e in enumerate(extensions)))
    found = files.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return wanted.join(found, "stem", "left")


def all_existing(wanted: DataFrame, files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Every file of each wanted stem with one of the extensions: stem, path (null where none exists)."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    found = files.filter(extension.isin([e.lower() for e in extensions])).select(stem(F.col("path")).alias("stem"), "path").distinct()
    return wanted.join(found, "stem", "left")


def unique_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Each file once by its canonical path (slashes one way, no doubled or dotted segments, case aside), with the name it is copied to.

    A name that several files share gets twelve digits of the canonical path's hash.
    """
    canonical = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/(\./)+", "/"), r"/{2,}", "/"))
    once = files.withColumn("canonical", canonical).groupBy("canonical").agg(F.min(path).alias("path"))
    named = once.withColumn("name", F.regexp_extract("path", r"([^/\\]*)$", 1))
    shared = named.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n"))
    many = named.join(shared, F.lower("name") == F.col("low"))
    suffix = F.substring(F.sha2("canonical", 256), 1, 12)
    unique = F.regexp_replace("name", r"(\.[^.]*)?$", "")
    return many.select("path", "canonical", F.when(F.col("n") > 1, F.concat(unique, F.lit("_"), suffix, F.regexp_extract("name", r"(\.[^.]*)$", 1))).otherwise(F.col("name")).alias("name"))


def without(paths: DataFrame, excluded: DataFrame, path: str = "rel_path") -> DataFrame:
    """Paths not on the list, whether or not either side has an ``alto/`` segment; case aside."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\\", "/"))), r"(^|/)alto/", "$1")
    banned = excluded.select(norm(F.col(path)).alias("norm")).filter("norm <> ''").distinct()
    return paths.withColumn("norm", norm(F.col(path))).join(banned, "norm", "left_anti").drop("norm")


def compare(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Full outer comparison: key, side (``both``, ``left``, ``right``), and per metric left, right and delta."""
    a = left.select(key, F.lit(True).alias("in_left"), *(F.col(m).alias(f"{m}_left") for m in metrics))
    b = right.select(key, F.lit(True).alias("in_right"), *(F.col(m).alias(f"{m}_right") for m in metrics))
    both = a.join(b, key, "full")
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left").otherwise("right")
    return both.select(key, side.alias("side"), *(c for m in metrics for c in (F.col(f"{m}_left"), F.col(f"{m}_right"), (F.col(f"{m}_right") - F.col(f"{m}_left")).alias(f"{m}_delta"))))


def summarise(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per metric (and group): count, mean, median and population deviation of its finite values."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("value")) for m in metrics))).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std")
    )


def ranks(rows: DataFrame, truth: str, predicted: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """gt_rank (ties share the lowest) and pred_rank (1..N, ties by key), both from the largest down, within ``by``."""
    w = Window.partitionBy(*by)
    return rows.withColumn("gt_rank", F.rank().over(w.orderBy(F.desc(truth)))).withColumn("pred_rank", F.row_number().over(w.orderBy(F.desc(predicted), key)))


def top_bottom(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k largest and k smallest rows by score (ties by key), marked ``top`` or ``bottom``; limits run per partition first."""
    top = rows.orderBy(F.desc(score), key).limit(k).withColumn("part", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc(score), key).limit(k).withColumn("part", F.lit("bottom")))


def largest_differences(compared: DataFrame, metric: str, key: str, k: int) -> DataFrame:
    """The k matched pages whose metric differs most, ties by key."""
    return compared.filter("side = 'both'").withColumn("abs_delta", F.abs(f"{metric}_delta")).orderBy(F.desc("abs_delta"), key).limit(k)
