"""Boxes and polygons as Column functions. A box is a struct or a prefix of four double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((xmin, "xmin"), (ymin, "ymin"), (xmax, "xmax"), (ymax, "ymax"))))


def width(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def height(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, width(b)) * F.greatest(zero, height(b))


def center_x(b: Column) -> Column:
    return b["xmin"] + width(b) / 2


def center_y(b: Column) -> Column:
    return b["ymin"] + height(b) / 2


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share area; touching edges don't count."""
    return (a["xmin"] < b["xmax"]) & (b["xmin"] < a["xmax"]) & (a["ymin"] < b["ymax"]) & (b["ymin"] < a["ymax"])


def intersects(a: Column, b: Column) -> Column:
    """Whether two boxes meet; touching edges count."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def intersection_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])) * F.greatest(
        zero, F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def union_box(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    low = lambda n: F.array_min(F.transform(boxes, lambda b: b[n]))
    high = lambda n: F.array_max(F.transform(boxes, lambda b: b[n]))
    return F.when(F.size(boxes) > 0, F.struct(low("xmin").alias("xmin"), low("ymin").alias("ymin"), high("xmax").alias("xmax"), high("ymax").alias("ymax")))


def points(polygon: Column) -> Column:
    """Points of an ``x,y x,y`` string (blanks or semicolons between); tokens that are no pair of numbers are skipped."""
    parts = F.split(F.trim(F.translate(polygon, ";", " ")), r"\s+")
    pairs = F.transform(parts, lambda p: F.struct(F.get(F.split(p, ","), 0).try_cast("double").alias("x"), F.get(F.split(p, ","), 1).try_cast("double").alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def polygon_box(polygon: Column) -> Column:
    """Box around a polygon string; null if no point can be read."""
    p = points(polygon)
    side = lambda f, n: f(F.transform(p, lambda q: q[n]))
    return F.when(
        F.size(p) > 0,
        F.struct(side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax")),
    )


def contains_center(parent: Column, child: Column) -> Column:
    """Whether a child's centre lies in its parent, edges included."""
    x, y = center_x(child), center_y(child)
    return (x >= parent["xmin"]) & (x <= parent["xmax"]) & (y >= parent["ymin"]) & (y <= parent["ymax"])


def translated(b: Column, dx: Column, dy: Column) -> Column:
    return F.struct((b["xmin"] + dx).alias("xmin"), (b["ymin"] + dy).alias("ymin"), (b["xmax"] + dx).alias("xmax"), (b["ymax"] + dy).alias("ymax"))


def absolute_children(parent: Column, children: Column) -> Column:
    """Child boxes in page coordinates: moved by the parent's corner if strictly more centres then lie inside it; all or none."""
    moved = F.transform(children, lambda c: translated(c, parent["xmin"], parent["ymin"]))
    inside = lambda boxes: F.size(F.filter(boxes, lambda c: contains_center(parent, c)))
    return F.when(inside(moved) > inside(children), moved).otherwise(children)


def overlap_pairs(boxes: Column) -> Column:
    """Number of pairs i < j of an array of boxes that overlap."""
    return F.aggregate(
        F.transform(boxes, lambda a, i: F.size(F.filter(boxes, lambda b, j: (j > i) & overlaps(a, b)))), F.lit(0), lambda acc, n: acc + n
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rescaled(b: Column, factor: Column) -> Column:
    """Integer box scaled and cut to whole pixels."""
    return F.struct(*((b[n] * factor).cast("int").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")))


#: Reading-order rank of each place relative to the printspace.
LOCATIONS = {"MARGIN_TOP": 0, "PRINTSPACE": 1, "MARGIN_BOTTOM": 2, "MARGIN_LEFT": 3, "MARGIN_RIGHT": 4}


def region_location(printspace: Column, region: Column) -> Column:
    """Where a region lies: in the printspace if more than half of it does, else in a margin; side margins go before top and bottom."""
    share = F.try_divide(intersection_area(printspace, region), area(region))
    tests = (
        ("PRINTSPACE", share > 0.5),
        ("MARGIN_RIGHT", region["xmax"] >= printspace["xmax"]),
        ("MARGIN_LEFT", region["xmin"] <= printspace["xmin"]),
        ("MARGIN_TOP", region["ymin"] <= printspace["ymin"]),
        ("MARGIN_BOTTOM", region["ymax"] >= printspace["ymax"]),
    )
    return F.coalesce(*(F.when(test, place) for place, test in tests), F.lit("PRINTSPACE"))
