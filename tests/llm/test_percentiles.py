import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from pagelens.llm import percentiles as P

SCHEMA = "line_no long, dataset_tag string, scored_at timestamp, htr_score double, line_conf double, region_conf double, value double, day string, cell long"


def lines(spark, rows):
    day = lambda d: None if d is None else datetime.datetime(2024, 1, d, 12)
    return spark.createDataFrame([(i, t, day(d), *v, 1.0, "clash", 3) for i, (t, d, *v) in enumerate(rows)], SCHEMA)


def brute(values, permille):
    v = sorted(values)
    return v[max(1, -(-len(v) * permille // 1000)) - 1]


def test_exact_against_sorting(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([rng.random(), round(rng.random(), 2), 0.0, 1.0, None, math.nan, -0.5, 1.5, math.inf, 90.7])
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), value(), value(), value()) for _ in range(900)]
    df = lines(spark, rows)
    got = P.percentiles(P.values(df.union(df.limit(100))), (0, 1, 500, 999, 1000)).collect()
    groups = {}
    for t, d, *v in rows:
        for m, x in zip(P.MEASURES, v):
            if x is not None and 0 <= x <= 1:
                groups.setdefault((t, None if d is None else datetime.date(2024, 1, d), m), []).append(x)
    assert len(got) == 5 * len(groups)
    for r in got:
        v = groups[r.dataset_tag, r.day, r.measure]
        assert (r.n, r.value, r.error_bound) == (len(v), brute(v, r.permille), 0.0)


def test_close_values_and_ties(spark):
    v = [0.5, 0.5 + 2**-52, 0.5 + 2**-50, 0.25, 0.25]
    df = lines(spark, [("a", 1, x, None, None) for x in v])
    got = {r.permille: r for r in P.percentiles(P.values(df), (400, 600, 1000)).collect()}
    assert got[400].value == 0.25 and got[400].error_bound == 0
    for p in (600, 1000):
        assert got[p].value == brute(v, p) and got[p].error_bound == 0


def test_any_doubles_are_exact(spark):
    rng = random.Random(3)
    odd = [5e-324, -5e-324, 2.0**-1022, 2.0**-1023, -(2.0**-1022), 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.0, -0.0, 8.0, 7.999999999999999, 0.125]
    v = [*odd, *(float(x) for x in range(1, 101)), *(rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(300))]
    df = spark.createDataFrame([("g", x) for x in v] + [("g", None), ("g", math.nan), ("ints", 5.0)], "k string, value double")
    steps = tuple(range(0, 1001, 50))
    got = {(r.k, r.permille): r for r in P.percentiles(df, steps, ("k",)).collect()}
    for p in steps:
        assert got["g", p].value == brute(v, p) and got["g", p].n == len(v) and got["g", p].error_bound == 0
    assert got["ints", 500].value == 5.0
    whole = spark.createDataFrame([("g", float(x)) for x in range(1, 101)], "k string, value double")
    assert {r.permille: r.value for r in P.percentiles(whole, (500,), ("k",)).collect()} == {500: 50.0}
    cells = P.from_cells(P.cells(whole.withColumn("value", F.col("value") - 50.5), group=("k",)), ("k",), (500,)).first()
    assert cells.lo <= -0.5 <= cells.hi


def test_keys_order_and_return(spark):
    rng = random.Random(5)
    v = sorted({math.ldexp(rng.random() - 0.5, rng.randint(-1074, 1024)) for _ in range(2000)} | {math.ldexp(1.0, e) for e in range(-1074, 1024)})
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, value double").select("i", "value", P.sort_key(F.col("value")).alias("key")).withColumn("back", P.from_key(F.col("key")))
    got = rows.orderBy("i").collect()
    assert all(a.key < b.key for a, b in zip(got, got[1:])) and all(r.back == r.value for r in got)


def test_bounds_are_a_parameter(spark):
    df = lines(spark, [("a", 1, x, None, None) for x in (-3.0, 0.5, 90.7, math.inf, math.nan)])
    assert sorted(r.value for r in P.values(df).collect()) == [0.5]
    assert sorted(r.value for r in P.values(df, lowest=None, highest=None).collect()) == [-3.0, 0.5, 90.7]


def test_days_combine_within_the_bound(spark):
    rng = random.Random(8)
    rows = [("a", rng.randint(1, 5), rng.random() ** 3, None, 1.0) for _ in range(500)]
    values = P.values(lines(spark, rows))
    cells = P.cells(values)
    parts = cells.filter("day <= '2024-01-02'").unionByName(cells.filter("day > '2024-01-02'"))
    for r in P.from_cells(parts, ("measure",)).collect():
        v = [x[2] for x in rows] if r.measure == "htr_score" else [1.0] * 500
        assert abs(r.value - brute(v, r.permille)) <= r.error_bound == pytest.approx(2**-11) and r.lo <= brute(v, r.permille) <= r.hi
    edges = P.bin_edges(P.from_cells(parts, ("measure",)), ("measure",)).filter("measure = 'htr_score'").orderBy("i").collect()
    edges = [r.edge for r in edges]
    assert edges == sorted(set(edges)) and edges[0] == 0 and edges[-1] > 1


def test_empty(spark):
    empty = P.values(lines(spark, []))
    assert P.percentiles(empty).count() == 0 and P.cells(empty).count() == 0 and P.from_cells(P.cells(empty), ("measure",)).count() == 0
