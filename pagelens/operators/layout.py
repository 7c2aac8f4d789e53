"""Reading orders and box relations over long tables of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.functions import polygons


def as_box() -> Column:
    return G.box(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def _numbered(boxes: DataFrame, key: list[str], order: list, name: str) -> DataFrame:
    return boxes.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def printspace_order(boxes: DataFrame, key: list[str], printspace: Column, pos: str, two_page: bool = False) -> DataFrame:
    """``order_no``: right page last (of a spread), then place relative to the printspace, then top down; ties as stored."""
    place = G.region_location(printspace, as_box())
    rank = F.coalesce(*(F.when(place == name, n) for name, n in G.LOCATIONS.items()))
    # Centres of whole-pixel boxes are whole pixels, rounded down.
    right = F.when(F.lit(two_page) & (F.floor((F.col("xmin") + F.col("xmax")) / 2) > F.floor((printspace["xmin"] + printspace["xmax"]) / 2)), 1).otherwise(0)
    return _numbered(boxes.withColumn("location", place), key, [right, rank, "ymin", pos], "order_no")


def left_right_top_down(boxes: DataFrame, key: list[str], pos: str, line_spacing: float | None = 1.0) -> DataFrame:
    """``order_no``: rows of ``line_spacing`` mean box heights from the top, each from left to right; ties as stored."""
    step = F.avg(F.col("ymax") - F.col("ymin")).over(Window.partitionBy(*key)) * F.lit(line_spacing or 0.0)
    banded = boxes.withColumn("band", F.when(step > 0, F.floor(F.col("ymin") / step).cast("double")).otherwise(F.col("ymin").cast("double")))
    return _numbered(banded, key, ["band", "xmin", pos], "order_no").drop("band")


def top_down(boxes: DataFrame, key: list[str], pos: str) -> DataFrame:
    """``order_no`` by the whole-pixel centre; ties as stored."""
    return _numbered(boxes, key, [F.floor((F.col("ymin") + F.col("ymax")) / 2), pos], "order_no")


def overlap_counts(boxes: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Overlapping pairs of boxes per key; boxes of a key form one array, so no pairs are shuffled."""
    items = F.array_sort(F.collect_list(F.struct(pos, as_box().alias("b"))))
    return boxes.groupBy(*key).agg(items.alias("items")).select(*key, G.overlap_pairs(F.transform("items", lambda x: x["b"])).cast("long").alias("n_overlaps"))


def best_polygon_iou(outlines: Column) -> Column:
    """For each polygon (text) of an array its largest intersection over union with another; null where there is no other."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for items in batch:
                items = list(items)
                m = polygons.iou_matrix(items, items, np.zeros((len(items), len(items))))
                np.fill_diagonal(m, -1.0)
                out.append([None if len(items) < 2 else float(x) for x in m.max(axis=1)])
            yield pd.Series(out)

    return run(outlines)


def contained(boxes: DataFrame, key: list[str], pos: str, threshold: float = 0.5) -> DataFrame:
    """Boxes to remove: those of which a larger box of the same key covers more than ``threshold``.

    For suppression per class the class is one of the columns in ``key``.
    """
    items = F.collect_list(F.struct(pos, as_box().alias("b")))
    removed = F.filter(
        F.col("items"),
        lambda a: F.exists(
            F.col("items"),
            lambda o: (o[pos] != a[pos]) & (G.area(o["b"]) > G.area(a["b"])) & (G.area(a["b"]) > 0) & (G.intersection_area(a["b"], o["b"]) > threshold * G.area(a["b"])),
        ),
    )
    return boxes.groupBy(*key).agg(items.alias("items")).select(*key, F.explode(F.transform(removed, lambda r: r[pos])).alias(pos))
