"""Exact quantiles per group without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.runtime import discard, durable

#: Equal ranges of a group's values whose sums lead to the ranges that hold the quantiles.
RANGES = 4096


def exact_quantiles(rows: DataFrame, group: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """The group, i (place in ``quantiles``) and edge: quantiles with linear interpolation between the values beside the rank.

    Null and NaN are no values; groups without values give no row, a null in a group column is a value
    like any other. Equal values are counted before anything moves. Counts per range of a group say which
    ranges hold the wanted ranks, and only the distinct values of those are put in order.
    """
    keys = [f"_group_{i}" for i in range(len(group))]
    v = F.col(value).cast("double")
    named = rows.select(*(F.col(g).alias(k) for g, k in zip(group, keys)), (v + F.lit(0.0)).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = durable(named.groupBy(*keys, "v").agg(F.count("*").alias("n")), "counts")
    same = lambda a, b, *more: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, *more)]
    # Two halves, so that the width of a range is finite for any doubles.
    spans = counts.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(RANGES - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES))).otherwise(0).cast("int")
    placed = counts.alias("a").join(spans.alias("b"), same("a", "b")).select(*(F.col(f"a.{k}").alias(k) for k in keys), "v", "n", place.alias("place"))
    sums = placed.groupBy(*keys, "place").agg(F.sum("n").alias("m"))
    # At most RANGES rows a group.
    line = Window.partitionBy(*keys).orderBy("place")
    sums = sums.withColumn("start", F.sum("m").over(line) - F.col("m")).withColumn("total", F.sum("m").over(Window.partitionBy(*keys)))
    at = lambda q: (F.col("total") - 1) * F.lit(float(q))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank"), at(q).alias("at")) for i, q in enumerate(quantiles) for r in (F.floor(at(q)), F.ceil(at(q))))))
    asked = durable(
        sums.select(*keys, "place", "m", "start", wanted.alias("w")).filter("w.rank >= start AND w.rank < start + m").select(*keys, "place", "start", "w.*").distinct(), "asked"
    )
    inside = placed.alias("a").join(asked.select(*keys, "place", "start").distinct().alias("b"), same("a", "b", "place")).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.place").alias("place"), "v", "n", "start")
    upto = F.col("start") + F.sum("n").over(Window.partitionBy(*keys, "place").orderBy("v"))
    found = asked.alias("a").join(inside.withColumn("upto", upto).alias("b"), same("a", "b", "place")).filter("a.rank < upto AND a.rank >= upto - n")
    picked = found.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.i").alias("i"), F.col("a.at").alias("at")).agg(F.min("b.v").alias("x"), F.max("b.v").alias("y"))
    edge = F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at"))
    done = durable(picked.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), "i", edge.alias("edge")), "quantiles")
    discard(counts)
    discard(asked)
    return done
