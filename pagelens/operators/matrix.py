"""Feature matrices: cleaning, named sets, splits, weights, errors and correlations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions.stats import finite

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType, T.DecimalType)

#: Patterns of the named feature sets, over lower-case column names.
SETS = {
    "confidence_only": (r"conf", r"confidence", r"htr_line_score", r"htr_token_score", r"region_conf", r"line_conf", r"_score_hist", r"_conf_hist"),
    "ngram_only": (r"gram", r"char_\d+gram_ratio_present", r"page_ppl", r"line_ppl_"),
    "image_only": (r"^img_", r"^blur_score_", r"^noise_", r"^fg_ratio$", r"^stroke_width_", r"^cc_count$", r"^skew_angle_deg$"),
    "lexical_only": (r"^lex_", r"^lexicality_"),
}
DIT_PREFIX = "dit_emb"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def usable_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns with more than one distinct value besides null and NaN, found in one pass by minimum and maximum.

    Give the training rows alone where validation must not count.
    """
    names = [c for c in numeric_columns(df) if c not in exclude and not c.startswith("target_")]
    if not names:
        return []
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*(F.struct(F.min(value(c)), F.max(value(c))).alias(c) for c in names)).first()
    return [c for c in names if row[c][0] is not None and row[c][0] != row[c][1]]


def feature_set(name: str, columns: Sequence[str], single: str = "htr_line_score_mean", dit_prefix: str = DIT_PREFIX) -> list[str]:
    """Columns of a named set; a set without columns and an unknown name are errors."""
    low = {c: c.lower() for c in columns}
    if name == "full":
        found = list(columns)
    elif name == f"single_{single}":
        found = [c for c in columns if c == single]
    elif name == "dit_only":
        found = [c for c in columns if low[c].startswith(dit_prefix)]
    elif name == "json_model_only":
        other = [p for k in ("image_only", "lexical_only", "ngram_only") for p in SETS[k]]
        found = [c for c in columns if not low[c].startswith(dit_prefix) and not any(re.search(p, low[c]) for p in other)]
    elif name in SETS:
        found = [c for c in columns if any(re.search(p, low[c]) for p in SETS[name])]
    else:
        raise ValueError(f"unknown feature set: {name}")
    if not found:
        raise ValueError(f"feature set {name} has no columns here")
    return found


def aligned(df: DataFrame, columns: Sequence[str], fill: float = float("nan")) -> DataFrame:
    """The wanted columns as doubles; a missing column is filled."""
    return df.select(*(F.col(c).cast("double").alias(c) if c in df.columns else F.lit(fill).alias(c) for c in columns))


def holdout(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Column ``split``: ``val`` for ceil(n * share) rows by the order of a seeded hash, else ``train``.

    The order is global, but only the rows at the cut need it: the hash value of that rank is found
    first, so no task sorts the table.
    """
    h = F.xxhash64(F.lit(seed), key)
    hashed = df.withColumn("_h", h)
    n = hashed.count()
    wanted = -(-n * int(share * 1_000_000) // 1_000_000)
    if not wanted:
        return hashed.withColumn("split", F.lit("train")).drop("_h")
    # Counts per 2**16 hash ranges lead to the range of the cut, which is then ordered by itself.
    span = F.floor(F.col("_h") / F.lit(1 << 48))
    ranges = sorted((r[0], r[1]) for r in hashed.groupBy(span).count().collect())
    at = 0
    for bucket, k in ranges:
        if at + k >= wanted:
            break
        at += k
    inside = hashed.filter(span == bucket).select("_h", key).orderBy("_h", key).limit(wanted - at)
    last = inside.agg(F.max(F.struct("_h", key)).alias("m")).first().m
    cut = (F.col("_h") < last[0]) | ((F.col("_h") == last[0]) & (F.col(key) <= F.lit(last[1])))
    return hashed.withColumn("split", F.when(cut, "val").otherwise("train")).drop("_h")


def folds(key: Column, k: int = 5, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def sample_weight(y: Column, target: str, low: Column, high: Column, alpha: float = 2.0, power: float = 2.0, least: float = 1.0, most: float = 5.0, enabled: bool = True) -> Column:
    """Weight that grows as a bag-of-words target falls; 1 unless enabled and the target's range (low, high) lies in -0.05..1.05."""
    if not enabled or "bow" not in target:
        return F.lit(1.0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    weight = F.greatest(F.lit(least), F.least(F.lit(most), 1 + alpha * F.pow(1 - bounded, F.lit(power))))
    return F.when((low >= -0.05) & (high <= 1.05), weight).otherwise(1.0)


def mae(truth: Column, predicted: Column, weight: Column | None = None) -> Column:
    """Mean absolute error; weighted if weights are given and sum to more than 0."""
    e = F.abs(truth - predicted)
    plain = F.avg(e)
    return plain if weight is None else F.when(F.sum(weight) > 0, F.sum(weight * e) / F.sum(weight)).otherwise(plain)


def constant_baseline(df: DataFrame, target: str) -> DataFrame:
    """Mean of all finite targets, and its absolute error over the validation rows (column split)."""
    mean = df.agg(F.avg(finite(F.col(target))).alias("mean_used"))
    value = mean.first().mean_used
    return df.filter(finite(F.col(target)).isNotNull() & (F.col("split") == "val")).agg(
        F.lit(value).alias("mean_used"), F.count("*").alias("n_val"), mae(F.col(target), F.lit(value)).alias("val_mae")
    )


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target over rows where both are finite: feature, n, corr (null if undefined).

    All columns in one pass, from sums of centred values.
    """
    y = finite(F.col(target))
    parts = []
    for c in columns:
        x = F.when(y.isNotNull(), finite(F.col(c)))
        z = F.when(x.isNotNull(), y)
        parts.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.covar_pop(x, z).alias("cov"), F.stddev_pop(x).alias("sx"), F.stddev_pop(z).alias("sy")))
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("x")).select(
        "x.feature", "x.n", F.when((F.col("x.n") > 1) & (F.col("x.sx") > 0) & (F.col("x.sy") > 0), F.col("x.cov") / (F.col("x.sx") * F.col("x.sy"))).alias("corr")
    )


def prune_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.98) -> list[str]:
    """Columns left when, in order of name, each one too correlated with a kept one is dropped; gaps are filled by the median first.

    The matrix is columns by columns, at most a few hundred, and is computed in one pass.
    """
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.stat import Correlation

    names = sorted(columns)
    filled = [f"_{c}" for c in names]
    data = df.select(*(finite(F.col(c)).alias(c) for c in names))
    model = Imputer(strategy="median", inputCols=names, outputCols=filled, relativeError=0.0).fit(data)
    vectors = VectorAssembler(inputCols=filled, outputCol="v").transform(model.transform(data)).select("v")
    m = Correlation.corr(vectors, "v").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(names)):
        if not any(abs(m[i][j]) > threshold for j in kept):
            kept.append(i)
    return [names[i] for i in kept]


def widest_first(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Columns in the published order: keys, then all others by name."""
    return df.select(*key, *sorted(c for c in df.columns if c not in key))


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key by time (re-delivered rows once)."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
