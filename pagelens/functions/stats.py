"""Statistics as Column builders: over groups (aggregates) and over array columns (one row per page, no shuffle).

Population deviations; missing values are NaN, never null; non-finite values are left out before
anything is computed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Suffixes of the five statistics, and the default quantiles and edges of confidence bins.
STATS = ("mean", "std", "min", "max", "cv")
BIN_QUANTILES = (0.0, 0.01, 0.05, 0.10, 0.20, 0.35, 0.50, 0.70, 0.85, 0.93, 0.97, 0.99, 1.0)
FALLBACK_EDGES = (0.0, 0.60, 0.75, 0.85, 0.92, 0.96, 0.985, 0.995, 1.0 + 1e-6)
EPSILON = 1e-6


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def or_nan(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(NAN))


def finite(x: Column) -> Column:
    """The value as double if it is finite, else null (aggregates skip it)."""
    d = x.cast("double")
    return F.when(is_finite(d), d)


# --- aggregates over groups ---------------------------------------------------------------------


def group_stats(x: Column, prefix: str) -> list[Column]:
    """mean, std (population), min, max and cv of the finite values of a group; NaN for an empty group, cv NaN at mean 0."""
    v = finite(x)
    mean, std = F.avg(v), F.stddev_pop(v)
    return [
        or_nan(mean).alias(f"{prefix}_mean"),
        or_nan(std).alias(f"{prefix}_std"),
        or_nan(F.min(v)).alias(f"{prefix}_min"),
        or_nan(F.max(v)).alias(f"{prefix}_max"),
        or_nan(F.when(mean != 0, std / mean)).alias(f"{prefix}_cv"),
    ]


def linspace(lo: float, hi: float, bins: int) -> list[float]:
    """Edges of equal bins, computed as lo + i * step with the last edge exact."""
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def group_histogram(x: Column, edges: Sequence[float], prefix: str) -> list[Column]:
    """Share of in-range values per bin (right-open, the last closed); zeros for a group without any."""
    v = finite(x)
    n = F.count_if((v >= edges[0]) & (v <= edges[-1]))
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        upper = v <= b if i == len(edges) - 2 else v < b
        out.append(F.when(n > 0, F.count_if((v >= a) & upper) / n).otherwise(0.0).alias(f"{prefix}_hist_bin_{i}"))
    return out


def sanitize_edges(edges: Sequence[float] | None, lo: float = 0.0, hi: float = 1.0) -> list[float]:
    """Strictly increasing edges from lo to beyond hi: non-finite ones go, equal ones move up by 1e-6; the fallback edges if fewer than two remain."""
    wanted = sorted(float(e) for e in edges or () if math.isfinite(e))
    out: list[float] = []
    for e in wanted:
        out.append(max(e, out[-1] + EPSILON) if out and e <= out[-1] else e)
    if len(out) >= 2:
        out[0] = lo
        if out[-1] <= hi:
            out[-1] = hi + EPSILON
        if all(x < y for x, y in zip(out, out[1:])):
            return out
    return [lo, *FALLBACK_EDGES[1:-1], hi + EPSILON]


# --- over array columns -------------------------------------------------------------------------


def finite_of(values: Column) -> Column:
    """The finite elements of an array of numbers."""
    return F.filter(F.transform(values, lambda x: x.cast("double")), is_finite)


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, total_of(values) / F.size(values)).otherwise(F.lit(NAN))


def std_of(values: Column) -> Column:
    """Population deviation in two passes."""
    m = mean_of(values)
    return F.when(
        F.size(values) > 0,
        F.sqrt(F.get(F.transform(F.array(m), lambda c: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - c) * (x - c))), F.lit(0)) / F.size(values)),
    ).otherwise(F.lit(NAN))


def summary_of(values: Column) -> Column:
    """mean, std, min, max and cv of an array's finite elements as one struct, all NaN without any."""
    v = finite_of(F.coalesce(values, F.array().cast("array<double>")))
    # One element arrays bind intermediate values, so each is computed once.
    with_mean = F.transform(F.array(F.struct(v.alias("v"))), lambda s: F.struct(s["v"].alias("v"), mean_of(s["v"]).alias("mean")))
    with_std = F.transform(
        with_mean,
        lambda s: F.struct(
            s["v"].alias("v"),
            s["mean"].alias("mean"),
            F.when(F.size(s["v"]) > 0, F.sqrt(F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"])) / F.size(s["v"]))).otherwise(F.lit(NAN)).alias("std"),
        ),
    )
    done = F.transform(
        with_std,
        lambda s: F.struct(
            s["mean"].alias("mean"),
            s["std"].alias("std"),
            or_nan(F.array_min(s["v"])).alias("min"),
            or_nan(F.array_max(s["v"])).alias("max"),
            F.when((F.size(s["v"]) > 0) & (s["mean"] != 0), s["std"] / s["mean"]).otherwise(F.lit(NAN)).alias("cv"),
        ),
    )
    return F.get(done, F.lit(0))


def array_stats(values: Column, prefix: str) -> dict[str, Column]:
    """The five statistics of an array's finite elements, by column name."""
    summary = summary_of(values)
    return {f"{prefix}_{k}": summary[k] for k in STATS}


def array_histogram(values: Column, edges: Sequence[float], prefix: str) -> dict[str, Column]:
    """Histogram shares of an array's finite elements, by column name."""
    v = F.filter(finite_of(F.coalesce(values, F.array().cast("array<double>"))), lambda x: (x >= edges[0]) & (x <= edges[-1]))

    def share(a: float, b: float, last: bool) -> Column:
        inside = F.size(F.filter(v, lambda x: (x >= a) & ((x <= b) if last else (x < b))))
        return F.when(F.size(v) > 0, inside / F.size(v)).otherwise(F.lit(0.0))

    return {f"{prefix}_hist_bin_{i}": share(a, b, i == len(edges) - 2) for i, (a, b) in enumerate(zip(edges, edges[1:]))}


def array_entropy(values: Column) -> Column:
    """Entropy (base 2) of an array shifted to minimum 0 and normalised; 0 for constant input, NaN without finite elements."""
    v = finite_of(F.coalesce(values, F.array().cast("array<double>")))
    # One element arrays bind the minimum and the total, so each is computed once and not once per element.
    low = F.transform(F.array(F.struct(v.alias("v"))), lambda s: F.struct(s["v"].alias("v"), F.array_min(s["v"]).alias("low")))
    shifted = F.transform(low, lambda s: F.struct(F.transform(s["v"], lambda x: x - s["low"]).alias("v")))
    summed = F.transform(shifted, lambda s: F.struct(s["v"].alias("v"), total_of(s["v"]).alias("total")))
    done = F.transform(
        summed,
        lambda s: F.when(F.size(s["v"]) == 0, F.lit(NAN))
        .when(s["total"] > 0, F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + F.when(x > 0, -(x / s["total"]) * F.log2(x / s["total"])).otherwise(0.0)))
        .otherwise(F.lit(0.0)),
    )
    return F.get(done, F.lit(0))


def array_percentile(values: Column, q: float) -> Column:
    """Percentile with linear interpolation of an array's finite elements; null without any."""
    v = F.array_sort(finite_of(values))
    at = (F.size(v) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    a, b = F.get(v, lo), F.get(v, F.ceil(at).cast("int"))
    return F.when(F.size(v) > 0, a + (b - a) * (at - lo))
