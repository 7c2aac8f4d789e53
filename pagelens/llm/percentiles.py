"""Percentiles of very large numeric columns by exact bisection.

For each group and percentile an interval holds the target rank. Every pass counts the rows below the
midpoints of the current intervals and narrows them; a pass takes several bisection steps at once
(:data:`STEPS`), that is, counts the cells between the midpoints of those steps. Bisection runs over
an order-preserving 64-bit key, so it works alike for any double – negative, tiny or huge – and ends
after 64 steps at most with the exact value; an interval whose rows all have one value ends early. A
row finds its interval by an equi-join on the cell, counts combine before the shuffle, and what moves
grows with groups, not with rows.

Days combine through :func:`cells`: counts per group and dyadic cell, which add up over any set of
days; :func:`from_cells` reads percentiles from such sums with half a cell as error bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.runtime import discard, durable

#: Bisection steps done after each pass: the first covers sign, exponent and six bits, the last ends at single values.
STEPS = (18, 26, 34, 42, 50, 58, 64)
#: Bits of the mergeable cells: their width is 2**-10, the error bound half of it.
CELL_BITS = 10
MEASURES = ("htr_score", "line_conf", "region_conf")
#: Percentiles in thousandths.
PERMILLE = (50, 250, 500, 750, 950)
GROUP = ("dataset_tag", "day", "measure")


def sort_key(value: Column) -> Column:
    """A long that orders as the doubles do (-0.0 as 0.0), one value a key; value must not be null or NaN.

    Exponent and mantissa are put side by side, as in the stored form of a double. The logarithm only
    guesses the exponent; comparisons with exact powers of two correct it.
    """
    a = F.abs(value)
    guess = F.floor(F.log2(a)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = guess + (a >= power(guess + 1)).cast("int") - (a < power(guess)).cast("int")
    mantissa = ((a / power(exponent) - 1.0) * float(1 << 52)).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + mantissa
    tiny = (a * float(1 << 537) * float(1 << 537)).cast("long")
    size = F.when(a < 2.0**-1022, tiny).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(value < 0, -size).otherwise(size)


def from_key(key: Column) -> Column:
    """The double of a :func:`sort_key`."""
    size = F.abs(key)
    exponent = F.shiftright(size, 52).cast("int")
    mantissa = (size.bitwiseAND(F.lit((1 << 52) - 1))).cast("double")
    a = (
        F.when(exponent == 0, mantissa * 2.0**-537 * 2.0**-537)
        .when(exponent == 2047, F.lit(float("inf")))
        .otherwise((mantissa / float(1 << 52) + 1.0) * F.pow(F.lit(2.0), exponent - 1023))
    )
    return F.when(key < 0, -a).otherwise(a)


def values(lines: DataFrame, measures: tuple[str, ...] = MEASURES, lowest: float | None = 0.0, highest: float | None = 1.0) -> DataFrame:
    """dataset_tag, day (of scored_at, UTC session), measure, value: the finite values from lowest to highest of each line once.

    ``lines`` has line_no (the key; repeated rows count once), dataset_tag, scored_at and the measures;
    other columns are ignored. Null, NaN, infinite values and those outside the bounds (None: no bound)
    are no values of a measure; null tags and days are groups of their own.
    """
    once = lines.select("line_no", "dataset_tag", F.to_date("scored_at").alias("day"), *measures).dropDuplicates(["line_no"])
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
    v = F.col("value")
    keep = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    keep = keep if lowest is None else keep & (v >= lowest)
    keep = keep if highest is None else keep & (v <= highest)
    return (
        once.select("dataset_tag", "day", named.alias("x")).select("dataset_tag", "day", "x.measure", "x.value")
        .filter(keep).withColumn("value", v + F.lit(0.0))
    )


def percentiles(rows: DataFrame, permille: tuple[int, ...] = PERMILLE, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The percentiles of ``value`` per group: the group's columns, permille, n, value, error_bound.

    The percentile of n values is the one of rank ceil(n * permille / 1000), at least 1, in ascending
    order (ties count each, infinities are the ends). It is exact for any doubles, so error_bound is 0.
    Null and NaN are no values; groups without values give no row. Nulls in group columns are a value
    like any other.
    """
    # Names of their own, so that group columns may be called anything.
    keys = [f"_group_{i}" for i in range(len(group))]
    keyed = rows.select(*(F.col(g).alias(k) for g, k in zip(group, keys)), F.col("value").cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = durable(keyed.select(*keys, sort_key(F.col("value")).alias("key")), "values")
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("permille"), F.greatest(F.lit(1), F.expr(f"(n * {p} + 999) div 1000")).alias("rank")) for p in permille)))
    open_targets = None
    results: list[DataFrame] = []
    done_bits = 0
    for bits in STEPS:
        fine = rows.withColumn("fine", F.shiftright("key", 64 - bits))
        if open_targets is None:
            fine = fine.withColumn("coarse", F.lit(0).cast("long"))
        else:
            intervals = open_targets.select(*keys, "coarse").distinct()
            fine = fine.withColumn("coarse", F.shiftright("fine", bits - done_bits))
            a, b = fine.alias("a"), intervals.alias("b")
            fine = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "coarse"]], "left_semi")
        counts = durable(fine.groupBy(*keys, "coarse", "fine").agg(F.count("*").alias("k"), F.min("key").alias("least"), F.max("key").alias("most")), "counts")
        if open_targets is None:
            totals = counts.groupBy(*keys, "coarse").agg(F.sum("k").alias("n"))
            open_targets = totals.withColumn("t", ranks).select(*keys, "coarse", "n", "t.permille", "t.rank")
        # Within an interval there are at most 2**18 cells.
        below = Window.partitionBy(*keys, "coarse").orderBy("fine")
        summed = counts.withColumn("upto", F.sum("k").over(below))
        a, b = open_targets.alias("a"), summed.alias("b")
        found = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "coarse"]]).filter("rank <= upto AND rank > upto - k")
        found = durable(
            found.select(*(F.col(f"a.{k}") for k in keys), "n", "permille", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "fine", "least", "most"), "narrowed"
        )
        results.append(found.filter("least = most").select(*keys, "permille", "n", from_key(F.col("least")).alias("value"), F.lit(0.0).alias("error_bound")))
        open_targets = found.filter("least <> most").select(*keys, F.col("fine").alias("coarse"), "n", "permille", "rank")
        discard(counts)
        done_bits = bits
        if open_targets.isEmpty():
            break
    discard(rows)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), "permille", "n", "value", "error_bound")


def cells(rows: DataFrame, bits: int = CELL_BITS, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The mergeable form: per group and dyadic cell of 2**-bits the number of values. Rows of several days add up.

    Values may lie anywhere; one too large for a cell number (above 2**53) is an error, not a wrong cell.
    """
    return rows.groupBy(*group, F.floor(F.col("value") * float(1 << bits)).cast("long").alias("cell")).agg(F.count("*").alias("n"))


def from_cells(counts: DataFrame, group: tuple[str, ...], permille: tuple[int, ...] = PERMILLE, bits: int = CELL_BITS) -> DataFrame:
    """Percentiles over any union of groups from the mergeable form: group, permille, n, lo, hi, value, error_bound.

    The exact percentile lies in [lo, hi]; value is the middle, error_bound half the cell.
    """
    keys = [f"_group_{i}" for i in range(len(group))]
    sums = counts.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys)), F.col("cell").alias("_cell")).agg(F.sum("n").alias("_k"))
    line = Window.partitionBy(*keys).orderBy("_cell")
    whole = Window.partitionBy(*keys)
    summed = sums.withColumn("_upto", F.sum("_k").over(line)).withColumn("n", F.sum("_k").over(whole))
    targets = F.explode(F.array(*(F.struct(F.lit(p).alias("permille"), F.greatest(F.lit(1), F.expr(f"(n * {p} + 999) div 1000")).alias("rank")) for p in permille)))
    width = 1.0 / (1 << bits)
    return (
        summed.withColumn("_t", targets).filter("_t.rank <= _upto AND _t.rank > _upto - _k")
        .select(*(F.col(k).alias(g) for k, g in zip(keys, group)), "_t.permille", "n", (F.col("_cell") * width).alias("lo"), ((F.col("_cell") + 1) * width).alias("hi"),
                ((F.col("_cell") + 0.5) * width).alias("value"), F.lit(width / 2).alias("error_bound"))
    )


def bin_edges(combined: DataFrame, group: tuple[str, ...], first: float = 0.0, last: float = 1.0 + 1e-6) -> DataFrame:
    """Edges of confidence bins: the group, i and edge – first, the distinct percentile values between in order, and last."""
    inner = F.array_sort(F.collect_set(F.when((F.col("value") > first) & (F.col("value") < last), F.col("value"))))
    edges = F.concat(F.array(F.lit(first)), inner, F.array(F.lit(last)))
    return combined.groupBy(*group).agg(edges.alias("edges")).select(*group, F.posexplode("edges").alias("i", "edge"))
