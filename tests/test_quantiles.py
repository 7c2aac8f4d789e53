import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators.quantiles import exact_quantiles
from pagelens.plans import language


def test_against_numpy(spark):
    rng = random.Random(1)
    values = {
        "uniform": [rng.random() for _ in range(500)], "ties": [rng.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(200)], "one": [3.5], "same": [7.0] * 9, "two": [1.0, 2.0],
        "huge": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0, 3.0], None: [-5.0, 2.0, 9.0],
    }
    rows = [(g, x, 1) for g, v in values.items() for x in v] + [("uniform", None, 1), ("uniform", math.nan, 1), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "v string, x double, n int")
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {}
    for r in exact_quantiles(df, ["v"], "x", qs).collect():
        got.setdefault(r.v, {})[r.i] = r.edge
    assert got.keys() == values.keys()
    for g, v in values.items():
        if g != "huge":
            assert [got[g][i] for i in range(len(qs))] == pytest.approx(np.quantile(v, qs).tolist(), abs=1e-12)
    assert got["huge"][0] == -1.7e308 and got["huge"][3] == 1.5 and got["huge"][5] == 1.7e308
    assert exact_quantiles(df.limit(0), ["v"], "x", qs).count() == 0


def test_any_scorer_can_be_given(spark):
    line = "array<struct<region_pos:int,text:string,score:double,seg_conf:double,xmin:double,ymin:double,xmax:double,ymax:double,tokens:array<double>>>"
    rows = [(1, [(None, t, 0.5, c, 0.0, 0.0, 1.0, 1.0, [])for t, c in (("ab", 0.1), ("abcd", 0.2), ("abcdef", 0.3))], None)]
    pages = spark.createDataFrame(rows, f"page_no long, lines {line}, error string")
    r = language.scored_features(pages, lambda texts, key: texts.select(key, F.length("text").cast("double").alias("ppl"))).first()
    assert r.page_ppl == 14 and r.line_ppl_mean == 4 and r.corr_line_conf_vs_ppl == pytest.approx(1.0)
