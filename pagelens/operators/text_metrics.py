"""Relational forms of the text metrics: bag of words and line error rates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import text as T


def token_counts(lines: DataFrame, key: str, text: str = "text") -> DataFrame:
    return lines.select(key, F.explode(T.word_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def bag_of_words(truth: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Multiset precision, recall and F1 per key of either side.

    Both sides have key and text. Counts combine before the shuffle; both sides are partitioned by key
    and token, so a hot page spreads over its tokens.
    """
    a = token_counts(truth, key).withColumnRenamed("n", "n_truth")
    b = token_counts(read, key).withColumnRenamed("n", "n_read")
    keys = truth.select(key).union(read.select(key)).distinct()
    sums = (
        a.join(b, [key, "token"], "full")
        .groupBy(key)
        .agg(F.sum("n_truth").alias("truth"), F.sum("n_read").alias("read"), F.sum(F.when(F.col("n_truth").isNotNull() & F.col("n_read").isNotNull(), F.least("n_truth", "n_read"))).alias("both"))
    )
    zero = F.lit(0)
    s = keys.join(sums, key, "left").select(key, *(F.coalesce(c, zero).alias(c) for c in ("truth", "read", "both")))
    p = F.when((F.col("truth") == 0) & (F.col("read") == 0), 1.0).when((F.col("truth") == 0) | (F.col("read") == 0), 0.0).otherwise(F.col("both") / F.col("read"))
    r = F.when(F.col("truth") == 0, 1.0).when(F.col("read") == 0, 0.0).otherwise(F.col("both") / F.col("truth"))
    return s.select(key, p.alias("bow_precision"), r.alias("bow_recall")).withColumn(
        "bow_f1", F.when(F.col("bow_precision") + F.col("bow_recall") > 0, 2 * F.col("bow_precision") * F.col("bow_recall") / (F.col("bow_precision") + F.col("bow_recall"))).otherwise(0.0)
    )


def linewise_cer(truth: DataFrame, read: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Per key of the truth: mean line error rate in stored order, and shares of missing and extra lines."""
    t = truth.select(key, pos, F.coalesce("text", F.lit("")).alias("t"))
    r = read.select(key, pos, F.coalesce("text", F.lit("")).alias("r"))
    rate = F.when(F.col("r").isNull(), 1.0).otherwise(T.line_cer(F.col("t"), F.col("r")))
    both = t.join(r, [key, pos], "full").groupBy(key).agg(
        F.avg(F.when(F.col("t").isNotNull(), rate)).alias("avg_line_cer"), F.count("t").alias("gt_num_lines"), F.count("r").alias("pred_num_lines")
    )
    one = F.lit(1)
    m, n = F.col("gt_num_lines"), F.col("pred_num_lines")
    return both.select(
        key,
        F.coalesce("avg_line_cer", F.lit(0.0)).alias("avg_line_cer"),
        (F.greatest(m - n, F.lit(0)) / F.greatest(m, one)).alias("missing_ratio"),
        (F.greatest(n - m, F.lit(0)) / F.greatest(n, one)).alias("halluc_ratio"),
    )


def page_order(lines: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``order_no`` from 0: by (ymin, xmin) on pages where every line has a box, else as stored."""
    page = Window.partitionBy(key)
    boxed = F.bool_and(F.col("xmin").isNotNull()).over(page)
    flow = page.orderBy(F.when(F.col("boxed"), F.col("ymin")), F.when(F.col("boxed"), F.col("xmin")), pos)
    return lines.withColumn("boxed", boxed).withColumn("order_no", F.row_number().over(flow) - 1).drop("boxed")


def spacing(lines: DataFrame, key: list[str], centre: Column, pos: str) -> DataFrame:
    """Positive gaps between neighbouring line centres of a group: key, gap."""
    order = Window.partitionBy(*key).orderBy("cy", pos)
    return lines.withColumn("cy", centre).withColumn("gap", F.lead("cy").over(order) - F.col("cy")).filter("gap > 0").select(*key, "gap")


def inversions(lines: DataFrame, key: list[str], centre: Column, pos: str) -> DataFrame:
    """Per group how often a line lies above the line stored before it."""
    order = Window.partitionBy(*key).orderBy(pos)
    return lines.withColumn("cy", centre).withColumn("up", F.lag("cy").over(order) > F.col("cy")).groupBy(*key).agg(F.count_if("up").alias("n_inversions"))
