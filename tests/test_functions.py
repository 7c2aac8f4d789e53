import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.functions import image
from pagelens.functions import text as T
from pagelens.operators import layout


def test_reading_order_grids(spark):
    def rows(jitter):
        return [(1, i, float(10 * (i // 2)), float(jitter * (i % 2)), float(10 * (i // 2) + 8), float(jitter * (i % 2) + 10)) for i in range(20)]

    schema = "page int, pos int, xmin double, ymin double, xmax double, ymax double"
    one = layout.left_right_top_down(spark.createDataFrame(rows(1), schema), ["page"], "pos").orderBy("order_no").collect()
    assert [r.pos for r in one] == list(range(20))
    two = layout.left_right_top_down(spark.createDataFrame(rows(20), schema), ["page"], "pos").orderBy("order_no").collect()
    assert [r.pos for r in two] == [*range(0, 20, 2), *range(1, 20, 2)]


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0), (5.0, 0.0, 15.0, 10.0), (3.0, 3.0, 3.0, 3.0))], f"a {G.BOX}, b {G.BOX}, c {G.BOX}, z {G.BOX}")
    r = df.select(
        G.overlaps(F.col("a"), F.col("b")).alias("o"), G.intersects(F.col("a"), F.col("b")).alias("i"), G.iou(F.col("a"), F.col("c")).alias("u"), G.iou(F.col("z"), F.col("z")).alias("e"),
        G.polygon_box(F.lit("1,2;3,4 bad 5 -1,0")).alias("p"), G.polygon_box(F.lit("x")).alias("n"), G.union_box(F.array("a", "b")).alias("w"),
    ).first()
    assert not r.o and r.i and r.u == pytest.approx(1 / 3) and r.e == 0 and tuple(r.p) == (-1, 0, 3, 4) and r.n is None and tuple(r.w) == (0, 0, 20, 10)


def test_text_functions(spark):
    df = spark.createDataFrame([("aa bbb c", 80), ("", 5)], "t string, w int")
    r = df.select(T.word_boxes(F.col("t"), F.col("w")).alias("b"), T.word_count(F.col("t")).alias("n"), T.char_ngrams(F.col("t"), 3).alias("g")).collect()
    assert [tuple(x) for x in r[0].b] == [("aa", 0, 30), ("bbb", 30, 70), ("c", 70, 80)] and r[1].b == [] and [x.n for x in r] == [3, 0] and r[1].g == []
    s = spark.createDataFrame([(["a", " ", "b", ""], [math.log(0.9), math.log(0.8), math.log(0.7), 0.0], [1.0, 1.0])], "t array<string>, p array<double>, l array<double>")
    r = s.select(T.token_confidences(F.col("t"), F.col("p")).alias("c"), T.sequence_confidence(F.col("p"), 1.0).alias("s"), T.softmax(F.col("l")).alias("m")).first()
    assert [(x.token, round(x.score, 6)) for x in r.c] == [("a", 0.9), (" ", 0.8), ("b", 0.7)] and r.s == pytest.approx((0.9 * 0.8 * 0.7) ** 0.25) and r.m == [0.5, 0.5]
    n = spark.createDataFrame([(" «Wｉd  år». ",), (None,)], "t string").select(T.normalize_token(True)("t").alias("n")).collect()
    assert [x.n for x in n] == ["vid år", None]


def test_image_features():
    g = np.zeros((20, 20))
    g[5:15, 5:15] = 200
    f = image.features(g)
    assert f["img_mean_intensity"] == 50 and f["img_contrast"] == 200 and f["fg_ratio"] == 0.75 and f["cc_count"] >= 2
    assert image.grey(1, 1, 3, bytes([10, 20, 30]))[0, 0] == round(0.114 * 10 + 0.587 * 20 + 0.299 * 30)
