"""Steps over document trees kept as adjacency tables: doc_id, node_id, parent_id (null at the root), pos, depth, and the node's fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.functions import text as T
from pagelens.runtime import durable

#: Levels beyond which the parents are taken for a cycle, which is an error.
MAX_DEPTH = 10_000


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.select("doc_id", F.col("parent_id").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    return nodes.join(parents, ["doc_id", "node_id"], "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id, distance) of every node and itself; one join per level of the deepest tree."""
    up = nodes.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("above"))
    level = nodes.select("doc_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    found = level
    d = 0
    while True:
        d += 1
        if d > MAX_DEPTH:
            raise ValueError(f"parents go on over {MAX_DEPTH} levels: they form a cycle")
        level = durable(
            level.join(up, ["doc_id", "ancestor_id"]).filter("above IS NOT NULL").select("doc_id", "node_id", F.col("above").alias("ancestor_id"), F.lit(d).alias("distance")), "level"
        )
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def prune(nodes: DataFrame, condition: Column) -> DataFrame:
    """The tree without the nodes that meet the condition and everything below them; the root stays."""
    cut = nodes.filter(condition & F.col("parent_id").isNotNull()).select("doc_id", F.col("node_id").alias("ancestor_id"))
    below = ancestors(nodes).join(cut, ["doc_id", "ancestor_id"], "left_semi").select("doc_id", "node_id").distinct()
    return nodes.join(below, ["doc_id", "node_id"], "left_anti")


def low_confidence_lines(nodes: DataFrame, threshold: float) -> DataFrame:
    """Drop leaves whose best text confidence (column conf; null counts as 0) is below the threshold."""
    bad = leaves(nodes).filter(F.coalesce("conf", F.lit(0.0)) < threshold).select("doc_id", "node_id", F.lit(True).alias("bad"))
    return nodes.join(bad, ["doc_id", "node_id"], "left_anti")


def mean_confidence(nodes: DataFrame) -> DataFrame:
    """Per node the mean confidence over itself and everything below it; nodes without text count as 0."""
    conf = nodes.select("doc_id", "node_id", F.coalesce("conf", F.lit(0.0)).alias("c"))
    return ancestors(nodes).join(conf, ["doc_id", "node_id"]).groupBy("doc_id", F.col("ancestor_id").alias("node_id")).agg(F.avg("c").alias("mean_conf"))


def low_confidence_regions(nodes: DataFrame, threshold: float, depth: int = 1) -> DataFrame:
    """Drop the nodes of a depth, with all below, whose mean confidence is below the threshold (depth 0: whole documents)."""
    scored = durable(nodes.join(mean_confidence(nodes), ["doc_id", "node_id"]), "scored")
    if depth == 0:
        bad = scored.filter(F.col("parent_id").isNull() & (F.col("mean_conf") < threshold)).select("doc_id")
        return nodes.join(bad, "doc_id", "left_anti")
    return prune(scored, (F.col("depth") == depth) & (F.col("mean_conf") < threshold)).drop("mean_conf")


def by_size(nodes: DataFrame, min_height: float = 0, min_width: float = 0, max_height: float = float("inf"), max_width: float = float("inf")) -> DataFrame:
    """Drop leaves whose height and width are not strictly within the limits."""
    h, w = F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin")
    keep = (h > min_height) & (h < max_height) & (w > min_width) & (w < max_width)
    return nodes.join(leaves(nodes).filter(~F.coalesce(keep, F.lit(False))).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def by_shape(nodes: DataFrame, min_ratio: float = 0, max_ratio: float = float("inf")) -> DataFrame:
    """Drop leaves whose width to height is not strictly within the limits; a height of 0 never is."""
    ratio = F.try_divide(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    keep = (ratio > min_ratio) & (ratio < max_ratio)
    return nodes.join(leaves(nodes).filter(~F.coalesce(keep, F.lit(False))).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


# --- results attached to nodes ----------------------------------------------------------------------


def attach_texts(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Readings added to their nodes: ``texts`` (array of conf, text) with the most confident first, ties as they came, nulls last.

    ``found`` has doc_id, node_id and texts; readings that a node has already are kept before new ones.
    """
    new = found.select("doc_id", "node_id", F.col("texts").alias("_new"))
    none = F.lit(None).cast(dict(found.dtypes)["texts"])
    old = F.col("texts") if "texts" in nodes.columns else none
    every = F.concat(F.coalesce(old, F.array().cast(dict(found.dtypes)["texts"])), F.coalesce("_new", F.array().cast(dict(found.dtypes)["texts"])))
    numbered = F.transform(every, lambda x, i: F.struct((-F.coalesce(x["conf"], F.lit(float("-inf")))).alias("c"), i.alias("i"), x.alias("x")))
    return nodes.join(new, ["doc_id", "node_id"], "left").withColumn("texts", F.transform(F.array_sort(numbered), lambda y: y["x"])).drop("_new")


def attach_annotations(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Annotations (map) merged into their nodes'; a new value takes the place of an old one."""
    new = found.select("doc_id", "node_id", F.col("annotations").alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    old = F.coalesce(F.col("annotations"), empty) if "annotations" in nodes.columns else empty
    fresh = F.coalesce("_new", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k))
    return nodes.join(new, ["doc_id", "node_id"], "left").withColumn("annotations", F.map_concat(kept, fresh)).drop("_new")


def attach_regions(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Regions added below their parents, after the children there are: ``found`` has doc_id, parent_id, node_id, pos (from 0) and fields."""
    there = nodes.filter("parent_id IS NOT NULL").groupBy("doc_id", "parent_id").agg((F.max("pos") + 1).alias("_from"))
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"))
    new = found.drop("depth").join(above, ["doc_id", "parent_id"]).join(there, ["doc_id", "parent_id"], "left").withColumn("pos", F.col("pos") + F.coalesce("_from", F.lit(0))).drop("_from")
    return nodes.unionByName(new, allowMissingColumns=True)


def attach(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Results of a model, by what they are: texts, annotations, or regions."""
    if "texts" in found.columns:
        return attach_texts(nodes, found)
    return attach_annotations(nodes, found) if "annotations" in found.columns else attach_regions(nodes, found)


def inference(nodes: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A model's results over the leaves, attached to the nodes they came from; ``model`` maps leaf rows to results."""
    return attach(nodes, model(leaves(nodes)))


def order_lines(nodes: DataFrame) -> DataFrame:
    """``pos`` of every node among its siblings: top down by the whole-pixel centre, ties as stored; roots keep theirs."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy(F.floor((F.col("ymin") + F.col("ymax")) / 2), "pos", "node_id")
    return nodes.withColumn("pos", F.when(F.col("parent_id").isNull(), F.col("pos").cast("long")).otherwise((F.row_number().over(order) - 1).cast("long")))


def reading_order(nodes: DataFrame, printspace: Column, two_page: bool | Column = False) -> DataFrame:
    """``pos`` of regions (depth 1) and their lines (depth 2) around the printspace; only regions follow a fold."""
    place = G.region_location(printspace, G.box(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))
    rank = F.coalesce(*(F.when(place == name, n) for name, n in G.LOCATIONS.items()))
    spread = (F.lit(two_page) if isinstance(two_page, bool) else two_page) & (F.col("depth") == 1)
    right = F.when(spread & (F.floor((F.col("xmin") + F.col("xmax")) / 2) > F.floor((printspace["xmin"] + printspace["xmax"]) / 2)), 1).otherwise(0)
    order = Window.partitionBy("doc_id", "parent_id").orderBy(right, rank, "ymin", "pos", "node_id")
    return nodes.withColumn("pos", F.when(F.col("depth").isin(1, 2), (F.row_number().over(order) - 1).cast("long")).otherwise(F.col("pos").cast("long")))


def word_segmentation(nodes: DataFrame) -> DataFrame:
    """Leaves with a text cut into words below them: equal pixels per character, the leaf's confidence and height."""
    best = F.get("texts", 0)["text"] if "texts" in nodes.columns else F.col("text")
    words = leaves(nodes).withColumn("_t", best).filter("length(_t) > 0").select("doc_id", F.col("node_id").alias("parent_id"), "conf", "xmin", "ymin", "ymax", F.posexplode(T.word_boxes(F.col("_t"), F.floor(F.col("xmax") - F.col("xmin")))).alias("pos", "w"))
    named = words.select(
        "doc_id", "parent_id", F.xxhash64("parent_id", "pos").alias("node_id"), F.col("pos").cast("long").alias("pos"), "conf",
        (F.col("xmin") + F.col("w.x0")).alias("x0"), "ymin", (F.col("xmin") + F.col("w.x1")).alias("xmax"), "ymax", F.col("w.word").alias("text"),
    ).withColumnRenamed("x0", "xmin")
    return attach_regions(nodes, named)


def export(nodes: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Hand the tree as it is to a writer, and go on with it."""
    write(nodes)
    return nodes


def annotate(nodes: DataFrame, predictions: DataFrame, target: str = "quality") -> DataFrame:
    """A prediction per document (doc_id, pred) as an annotation of its root."""
    roots = nodes.filter("parent_id IS NULL").select("doc_id", "node_id")
    found = roots.join(predictions.select("doc_id", "pred"), "doc_id").select("doc_id", "node_id", F.create_map(F.lit(f"quality_prediction.{target}"), F.col("pred").cast("string")).alias("annotations"))
    return attach_annotations(nodes, found)


def logged(nodes: DataFrame, name: str) -> DataFrame:
    """The step's name at the end of column ``steps``."""
    empty = F.array().cast("array<string>")
    before = F.coalesce("steps", empty) if "steps" in nodes.columns else empty
    return nodes.withColumn("steps", F.array_append(before, F.lit(name)))


def fail(_: DataFrame, message: str = "deliberate failure") -> DataFrame:
    raise RuntimeError(message)


#: Named steps, applied with :func:`run`.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "Inference": inference,
    "Segmentation": inference,
    "TextRecognition": inference,
    "QualityPrediction": annotate,
    "WordSegmentation": word_segmentation,
    "Export": export,
    "ReadingOrderMarginalia": reading_order,
    "OrderLines": order_lines,
    "Prune": prune,
    "RemoveLowTextConfidenceLines": low_confidence_lines,
    "RemoveLowTextConfidenceRegions": low_confidence_regions,
    "RemoveLowTextConfidencePages": lambda nodes, threshold: low_confidence_regions(nodes, threshold, 0),
    "FilterRegionsBySize": by_size,
    "FilterRegionsByShape": by_shape,
    "Break": fail,
}


def run(nodes: DataFrame, steps: list[tuple[str, dict]], log: bool = False) -> DataFrame:
    """The tree after named steps, in order; an unknown name is a KeyError before anything runs. ``log`` keeps their names in ``steps``."""
    chosen = [(name, STEPS[name], options) for name, options in steps]
    for name, step, options in chosen:
        nodes = step(nodes, **options)
        nodes = logged(nodes, name) if log else nodes
    return nodes
