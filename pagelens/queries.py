"""Queries of the core operators over the driver's tables, with the SQL that must give the same rows.

Doubles are rounded on both sides and NaN becomes null at the outermost select, so values compare exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.functions import stats as S
from pagelens.functions import text as T
from pagelens.operators import boosting, compare, drift, evaluate, layout, matrix, nested, ngrams, quantiles, text_metrics, tree
from pagelens.plans import features, language, training
from pagelens.runtime import durable, shared_dir, table
from pagelens.sources import files, ground_truth, page_json, sinks
from pagelens.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]

#: Digits that doubles are rounded to.
DIGITS = 9


def _r(c: Column | str, digits: int = DIGITS) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# --- inputs ---------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines once, with their text as stored; null counts as empty."""
    rows = table(spark, sf_dir, "text_lines").select("line_no", "rec_no", "line_pos", "text").dropDuplicates(["line_no"])
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


_LINES = "lines AS (SELECT DISTINCT line_no, rec_no, line_pos, coalesce(text, '') AS text FROM text_lines)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even lines of a page as its truth, odd ones as what was read."""
    rows = _lines(spark, sf_dir).select("rec_no", F.floor(F.col("line_pos") / 2).cast("long").alias("pos"), "text", (F.col("line_pos") % 2).alias("odd"))
    return rows.filter("odd = 0").drop("odd"), rows.filter("odd = 1").drop("odd")


_SIDES = f"""{_LINES},
truth AS (SELECT rec_no, CAST(line_pos // 2 AS BIGINT) AS pos, text FROM lines WHERE line_pos % 2 = 0),
readl AS (SELECT rec_no, CAST(line_pos // 2 AS BIGINT) AS pos, text FROM lines WHERE line_pos % 2 = 1)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"))
    b = rows.agg(F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    x, y = (F.floor(F.col("pos") / 10) % 97) * 10.0, (F.col("s") % 53) * 8.0
    return b.select("page", "pos", x.alias("xmin"), y.alias("ymin"), (x + 20 + F.col("q") * 3).alias("xmax"), (y + 15 + (F.col("pos") % 10) * 4).alias("ymax"))


_BOXES = """boxes AS (SELECT page, pos, x AS xmin, y AS ymin, x + 20 + q * 3 AS xmax, y + 15 + (pos % 10) * 4 AS ymax FROM (
  SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS pos, CAST((l_partkey % 97) * 10 AS DOUBLE) AS x, CAST((min(l_suppkey) % 53) * 8 AS DOUBLE) AS y, max(l_quantity) AS q
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_json.pages(table(spark, sf_dir, "page_documents"))


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "train_rows").dropDuplicates(["row_no"])


_TRAIN = "train AS (SELECT DISTINCT ON (row_no) * FROM train_rows)"
FEATURES = ("htr_line_score_mean", "htr_line_score_std", "line_conf_mean", "region_conf_mean", "n_lines")

# --- problems 3 and 6 -----------------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.bridges(table(spark, sf_dir, "page_documents")).select("page_no", "kind", "node_path", "parent_path")


def p3_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nested object of every page once, whatever its member."""
    return nested.objects(table(spark, sf_dir, "page_documents"), polygons=("region", "line", "word"), rest=True)


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_table(table(spark, sf_dir, "page_documents"), "line", {"confidence": "$.segmentation_confidence", "text": "$.transcription[0].text"}).select(
        "page_no", "node_path", "parent_path", F.col("ordinal").cast("long").alias("ordinal"), F.col("confidence").try_cast("double").alias("confidence"), "text"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "htr_json")).select("stream_no", "export_no", "drift_kind", "old_path", "new_path")


def p6_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes at any depth, in arrays of objects too, with whole and other numbers told apart."""
    return drift.changes(table(spark, sf_dir, "htr_json"), depth=None, arrays=True, split_numbers=True)


def p6_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = drift.records(table(spark, sf_dir, "htr_json"))
    return drift.fingerprints(recs, drift.layouts(drift.fields(recs)))


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = table(spark, sf_dir, "htr_json")
    return drift.unified(exports, drift.changes(exports))


# --- statistics -----------------------------------------------------------------------------------


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(*S.group_stats(F.col("value"), "value")))


def hist_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "text_lines").dropDuplicates(["line_no"])
    return _rounded(lines.groupBy("dataset_tag").agg(*S.group_histogram(F.col("htr_score"), S.linspace(0.0, 1.0, 10), "htr")))


def shifted_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return values.select("o_custkey", _r(S.array_entropy(F.col("v")), 5).alias("entropy"))


def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "text_lines").dropDuplicates(["line_no"])
    v = F.when((F.col("line_conf") >= 0) & (F.col("line_conf") <= 1), S.finite(F.col("line_conf")))
    return quantiles.exact_quantiles(lines.select("dataset_tag", v.alias("v")), ["dataset_tag"], "v", S.BIN_QUANTILES).select("dataset_tag", F.col("i").cast("long").alias("i"), _r("edge").alias("edge"))


def array_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array forms of the statistics, against the same SQL aggregates."""
    values = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    stats = S.array_stats(F.col("v"), "price")
    return values.select("o_custkey", *(_r(c, 3 if n.endswith("_std") else 9 if n.endswith("_cv") else 6).alias(n) for n, c in stats.items()), _r(S.array_percentile(F.col("v"), 0.2), 4).alias("p20"))


# --- text -----------------------------------------------------------------------------------------


def line_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("chars", F.length("text")).withColumn("words", T.word_count(F.col("text")))
    shares = rows.groupBy("rec_no").agg(
        F.count("*").alias("n_lines"), F.sum("chars").alias("total_chars"), F.sum("words").alias("total_words"), F.percentile("chars", [0.2, 0.8]).alias("p"), F.collect_list("chars").alias("c")
    )
    part = lambda test: F.size(F.filter("c", test)) / F.size("c")
    return _rounded(shares.select("rec_no", "n_lines", "total_chars", "total_words", part(lambda x: x < F.col("p")[0]).alias("frac_short_lines"), part(lambda x: x > F.col("p")[1]).alias("frac_long_lines")))


def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in T.char_classes(F.col("text")).items())))


def no_alpha_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lines(spark, sf_dir).groupBy("rec_no").agg((F.count_if(~T.has_letter(F.col("text"))) / F.count("*")).alias("frac_no_alpha_lines")))


def repetition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.long_runs(F.col("text"), 3).cast("long").alias("n_runs"))


def word_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.word_tokens(F.col("text"))).alias("w")).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("w").alias("n_words"))


def ngram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.frequent(_lines(spark, sf_dir), 4, 5, 200).select(F.col("n").cast("long").alias("n"), "gram", "cnt")


def ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = durable(_lines(spark, sf_dir), "lines")
    return _rounded(ngrams.ratio_present(lines, ngrams.frequent(lines, 3, 50), 3, "line_no"))


def lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perplexity for every line, by a model of all lines."""
    lines = durable(_lines(spark, sf_dir), "lines")
    counts = durable(ngrams.model(lines, 3)[0], "counts")
    totals = counts.groupBy("context").agg(F.sum("cnt").alias("total"), F.count("*").alias("vocab"))
    return ngrams.perplexity(lines, counts, durable(totals, "totals"), 3, "line_no").select("line_no", _r("ppl", 4).alias("ppl"))


def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _lines(spark, sf_dir).select("rec_no", F.explode_outer(T.word_tokens(F.col("text"))).alias("token"))
    words = table(spark, sf_dir, "lexicon").select("lexicon_name", F.lower("word").alias("word"))
    return _rounded(ngrams.lexicon_match(tokens, words, "rec_no"))


# --- error rates ----------------------------------------------------------------------------------


def bow_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(text_metrics.bag_of_words(*_sides(spark, sf_dir), "rec_no"))


def linewise_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(text_metrics.linewise_cer(*_sides(spark, sf_dir), "rec_no"))


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full target kernel, pages against themselves with their lines reversed and boxes moved a little."""
    pages = _pages(spark, sf_dir).filter("error IS NULL")
    own = lambda items: F.transform(items, lambda x: G.box(x["xmin"], x["ymin"], x["xmax"], x["ymax"]))
    truth = pages.select("page_no", "lines", own("lines").alias("boxes"), own("regions").alias("regions"))
    read = pages.select("page_no", F.reverse("lines").alias("lines"), F.transform("detections", lambda d: d.withField("xmax", d["xmax"] + 7)).alias("detections"))
    return evaluate.evaluate(truth, read, "page_no")


# --- boxes ----------------------------------------------------------------------------------------


def geom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumn("xmin", F.when((F.col("page") % 7 == 0) & (F.col("pos") % 3 == 0), None).otherwise(F.col("xmin")))
    return text_metrics.page_order(boxes, "page").select("page", "pos", F.col("order_no").cast("long").alias("order_no"))


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlap_counts(_boxes(spark, sf_dir), ["page"], "pos")


def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best overlap of each box with another of its page; pages hold a few boxes."""
    boxes = _boxes(spark, sf_dir).select("page", "pos", layout.as_box().alias("b"))
    items = boxes.groupBy("page").agg(F.collect_list(F.struct("pos", "b")).alias("items"))
    best = F.transform("items", lambda a: F.struct(a["pos"].alias("pos"), F.array_max(F.transform(F.filter("items", lambda o: o["pos"] != a["pos"]), lambda o: G.iou(a["b"], o["b"]))).alias("best_iou")))
    return items.select("page", F.explode(best).alias("x")).select("page", "x.pos", _r("x.best_iou").alias("best_iou"))


def polygon_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best overlap of each skewed outline with another of its page. Every page is skewed by itself, which changes no ratio of areas."""
    boxes = _boxes(spark, sf_dir)
    skew = (F.col("page") % 5) / F.lit(4.0)
    corner = lambda x, y: F.concat_ws(",", (F.col(x) + F.col(y) * skew), F.col(y))
    outline = F.concat_ws(" ", corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", outline.alias("p")))).alias("items"))
    best = layout.best_polygon_iou(F.transform("items", lambda x: x["p"]))
    return pages.select("page", F.explode(F.arrays_zip(F.transform("items", lambda x: x["pos"]).alias("pos"), best.alias("best"))).alias("x")).select("page", "x.pos", _r("x.best").alias("best_iou"))


def contained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.contained(_boxes(spark, sf_dir), ["page"], "pos")


def printspace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = G.box(*(F.lit(v) for v in (150.0, 60.0, 700.0, 350.0)))
    return layout.printspace_order(_boxes(spark, sf_dir), ["page"], space, "pos", True).select("page", "pos", "location", F.col("order_no").cast("long").alias("order_no"))


def left_right_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.left_right_top_down(_boxes(spark, sf_dir), ["page"], "pos").select("page", "pos", F.col("order_no").cast("long").alias("order_no"))


def top_down_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.top_down(_boxes(spark, sf_dir), ["page"], "pos").select("page", "pos", F.col("order_no").cast("long").alias("order_no"))


def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = text_metrics.spacing(_boxes(spark, sf_dir), ["page"], G.center_y(layout.as_box()), "pos")
    return _rounded(gaps.groupBy("page").agg(*S.group_stats(F.col("gap"), "line_spacing")))


def order_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_metrics.inversions(_boxes(spark, sf_dir), ["page"], G.center_y(layout.as_box()), "pos")


def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    p = F.concat_ws(" ", *(F.concat_ws(",", x, y) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))))
    return boxes.select("page", "pos", G.polygon_box(F.concat(p, F.lit(" ;x,1"))).alias("b")).select("page", "pos", "b.*")


def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    b = boxes.select(
        F.col("page").alias("doc_id"), (F.col("pos") + 1).alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(1).alias("depth"), ((F.col("pos") % 100) / 100.0).alias("conf"),
        "xmin", "ymin", "xmax", "ymax",
    )
    none = F.lit(None).cast("double")
    roots = boxes.select("page").distinct().select(
        F.col("page").alias("doc_id"), F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), none.alias("conf"), *(none.alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    )
    steps = [("RemoveLowTextConfidenceLines", {"threshold": 0.3}), ("Prune", {"condition": F.col("xmin") > 900}), ("FilterRegionsByShape", {"min_ratio": 1.0})]
    return tree.run(roots.unionByName(b), steps).filter("parent_id IS NOT NULL").select("doc_id", "node_id")


# --- pairing and comparing --------------------------------------------------------------------------


def stem_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "dataset_pages")
    return compare.paired(pages.select(F.col("gt_path").alias("path")).filter("path IS NOT NULL"), pages.select(F.col("pred_path").alias("path")).filter("path IS NOT NULL"))


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "dataset_pages").filter("gt_path IS NOT NULL")
    listed = pages.filter("rec_no % 3 = 0").select(F.upper(F.concat(F.lit("alto/"), F.col("gt_path"))).alias("rel_path"))
    return compare.without(pages.select(F.col("gt_path").alias("rel_path")).distinct(), listed)


def existing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "dataset_pages")
    files = pages.select(F.col("image_path").alias("path")).filter("path IS NOT NULL").distinct()
    more = files.select(F.regexp_replace("path", r"jpg$", "png").alias("path")).filter("length(path) % 2 = 0")
    wanted = pages.select(F.col("source_page_id").alias("stem")).distinct()
    return compare.first_existing(wanted, files.unionByName(more), (".png", ".jpg"))


def _pipelines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _train(spark, sf_dir).withColumn("y", F.nanvl("target_bow_f1", F.lit(None).cast("double"))).withColumn("c", F.nanvl("target_perm_cer_strict", F.lit(None).cast("double")))
    side = lambda p: rows.filter(F.col("dataset_tag").startswith(p)).groupBy("source_page_id").agg(F.max("y").alias("bow_f1"), F.max("c").alias("perm_cer"))
    return side("lines"), side("rl")


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.compare(*_pipelines(spark, sf_dir), "source_page_id", ["bow_f1", "perm_cer"]))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(compare.summarise(_train(spark, sf_dir), ["target_bow_f1", "target_perm_cer_strict", "n_lines"], ["split"]))


def page_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train(spark, sf_dir).filter("target_bow_f1 IS NOT NULL AND NOT isnan(target_bow_f1) AND line_conf_mean IS NOT NULL AND NOT isnan(line_conf_mean)")
    rows = rows.withColumn("truth", F.round("target_bow_f1", 2))
    return compare.ranks(rows, "truth", "line_conf_mean", "row_no", ["csv_file"]).select("row_no", F.col("gt_rank").cast("long").alias("gt_rank"), F.col("pred_rank").cast("long").alias("pred_rank"))


def top_bottom_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train(spark, sf_dir).filter("line_conf_mean IS NOT NULL AND NOT isnan(line_conf_mean)")
    return compare.top_bottom(rows, "line_conf_mean", "row_no", 25).select("row_no", "part")


def once_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.latest(table(spark, sf_dir, "htr_json").select("json_no", "stream_no", "export_no", "received_at"), "json_no", "received_at").groupBy("stream_no").agg(F.count("*").alias("n_records"))


# --- matrices and models ------------------------------------------------------------------------------


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train(spark, sf_dir).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("val"))


def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.correlations(_train(spark, sf_dir), FEATURES, "target_bow_f1"))


def usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train(spark, sf_dir).withColumn("flat", F.lit(1.0)).withColumn("empty", F.lit(float("nan")))
    return spark.createDataFrame([(c,) for c in matrix.usable_columns(rows, ["row_no"])], "feature string")


def weighted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p = S.finite(F.col("target_bow_f1")), S.finite(F.col("line_conf_mean"))
    rows = _train(spark, sf_dir).select("csv_file", y.alias("y"), p.alias("p")).filter("y IS NOT NULL AND p IS NOT NULL")
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    w = matrix.sample_weight(F.col("y"), "target_bow_f1", F.lit(low), F.lit(high))
    return _rounded(rows.groupBy("csv_file").agg(matrix.mae(F.col("y"), F.col("p")).alias("mae"), matrix.mae(F.col("y"), F.col("p"), w).alias("wmae")))


def constant_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.constant_baseline(_clean(spark, sf_dir), "target_bow_f1"))


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.holdout(_train(spark, sf_dir), "row_no", 0.2).groupBy("split").agg(F.count("*").alias("n_rows"))


def correlated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _train(spark, sf_dir).withColumn("z_copy", F.col("n_lines") * 2 + 1)
    return spark.createDataFrame([(c,) for c in matrix.prune_correlated(rows, [*FEATURES, "z_copy"])], "feature string")


def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {"full": list(FEATURES), "confidence_only": matrix.feature_set("confidence_only", FEATURES)}
    found = boosting.search(_clean(spark, sf_dir), sets, ["target_bow_f1", "target_perm_cer_strict"], "row_no", models=False)
    return boosting.best_trials(durable(found)).drop("model_json")


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)
    m = boosting.matrix(rows, FEATURES, "target_bow_f1", "row_no")
    train = m[m["split"] == "train"]
    model = boosting.train(train[list(FEATURES)].to_numpy(float), train["target_bow_f1"].to_numpy(float), FEATURES, boosting.Params(n_trees=40))
    return boosting.score(rows, model, "predicted").select("row_no", "predicted")


def embedding_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return boosting.pca_transform(rows, "embedding", *boosting.pca_fit(rows, "embedding", 8)).drop("embedding")


# --- pages and streams ----------------------------------------------------------------------------------


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.page_features(_pages(spark, sf_dir))


def _made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the scanned lines, ten lines a region, with boxes from their numbers and lengths."""
    rows = table(spark, sf_dir, "text_lines").select("line_no", "rec_no", "line_pos", "text", "htr_score", "line_conf", "region_conf").dropDuplicates(["line_no"])
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("region", F.floor(F.col("line_pos") / 10).cast("int"))
    x, y = (F.col("line_pos") % 10) * 10.0, F.col("line_pos") * 25.0 + F.col("line_no") % 7
    b = G.box(x, y, x + 9 * F.length("text") + 1, y + 20 + F.col("line_no") % 11)
    none = F.lit(None).cast("string")
    line = F.struct(
        "line_pos", "line_no", F.col("region").alias("region_pos"), "text", F.col("htr_score").alias("score"), F.col("line_conf").alias("seg_conf"),
        *(b[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")), F.array().cast("array<double>").alias("tokens"), none.alias("polygon"), S.finite(F.col("region_conf")).alias("rc"),
    )
    pages = rows.groupBy("rec_no").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    of = lambda i: F.filter("lines", lambda x: x["region_pos"] == i)
    side = lambda i, f, k: f(F.transform(of(i), lambda x: x[k]))
    region = lambda i: F.struct(
        F.lit("r").alias("label"), side(i, F.array_max, "rc").alias("seg_conf"), side(i, F.array_min, "xmin").alias("xmin"), side(i, F.array_min, "ymin").alias("ymin"),
        side(i, F.array_max, "xmax").alias("xmax"), side(i, F.array_max, "ymax").alias("ymax"), F.size(of(i)).alias("n_lines"), none.alias("polygon"),
    )
    numbers = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["region_pos"])))
    return pages.select("rec_no", F.transform(numbers, region).alias("regions"), "lines", none.alias("error"))


def made_page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all five groups that SQL can follow, over all scanned lines."""
    from pagelens.queries_sql import FEATURE_COLUMNS, feature_digits

    found = features.page_features(durable(_made_pages(spark, sf_dir), "pages"), key="rec_no")
    return found.select("rec_no", *(_r(c, feature_digits(c)).alias(c) for c in FEATURE_COLUMNS))


def page_layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page top down, through the document tree's steps."""
    lines = _made_pages(spark, sf_dir).select("rec_no", F.explode("lines").alias("x"))
    nodes = lines.select(
        F.col("rec_no").alias("doc_id"), (F.col("x.line_no") + 1).alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(1).alias("depth"), F.col("x.line_pos").cast("long").alias("pos"),
        F.col("x.score").alias("conf"), "x.xmin", "x.ymin", "x.xmax", "x.ymax",
    )
    return tree.run(nodes, [("OrderLines", {})]).select("doc_id", (F.col("node_id") - 1).alias("line_no"), F.col("pos").cast("long").alias("order_no"))


def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as PAGE XML into the shared folder, and its lines read back from there."""
    # Written first: the exports are Python functions, and arrays must be columns for them.
    pages = durable(_made_pages(spark, sf_dir).withColumn("name", F.col("rec_no").cast("string")), "pages")
    path = f"{shared_dir(spark)}/pagelens/xml-{uuid.uuid4().hex}"
    pages.select(sinks.page_xml("name").alias("xml"), "rec_no").write.parquet(path)
    read = ground_truth.pages(spark.read.parquet(path), "rec_no", "xml")
    return read.select("rec_no", F.posexplode("lines").alias("i", "x")).select(
        "rec_no", F.col("i").cast("long").alias("i"), T.collapsed(F.col("x.text")).alias("text"), *(F.col(f"x.{k}").cast("long").alias(k) for k in ("xmin", "ymin", "xmax", "ymax"))
    )


def alto_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as ALTO XML into the shared folder; words and lines with text, as read back."""
    # Written first: the exports are Python functions, and arrays must be columns for them.
    pages = durable(_made_pages(spark, sf_dir).withColumn("name", F.col("rec_no").cast("string")), "pages")
    path = f"{shared_dir(spark)}/pagelens/xml-{uuid.uuid4().hex}"
    pages.select(sinks.alto("name").alias("xml"), "rec_no").write.parquet(path)
    written = spark.read.parquet(path)
    words = written.select("rec_no", F.size(F.expr("xpath(xml, '//*[local-name()=\"String\"]/@CONTENT')")).cast("long").alias("n_words"))
    read = ground_truth.pages(written, "rec_no", "xml").select("rec_no", F.size("lines").cast("long").alias("n_text_lines"), F.size("geoms").cast("long").alias("n_lines"), F.size("regions").cast("long").alias("n_regions"))
    return read.join(words, "rec_no")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows written as CSV with sorted columns, and read back with their types."""
    rows = _train(spark, sf_dir).select("row_no", "split", *FEATURES, "target_bow_f1")
    path = f"{shared_dir(spark)}/pagelens/csv-{uuid.uuid4().hex}"
    sinks.wide_csv(rows, path, ["row_no"])
    read = files.training_table(spark, [path])
    return _rounded(read.groupBy(F.col("row_no").cast("long").alias("row_no")).agg(*(F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in (*FEATURES, "target_bow_f1"))))


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' texts exported as one corpus with headers, and its lines counted as a corpus reader sees them."""
    rows = _lines(spark, sf_dir).select("rec_no", "line_pos", "line_no", T.collapsed(F.col("text")).alias("text"))
    pages = rows.groupBy("rec_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    path = f"{shared_dir(spark)}/pagelens/corpus-{uuid.uuid4().hex}"
    sinks.corpus(pages.select(F.lit("v").alias("volume"), F.concat(F.lit("p"), F.col("rec_no")).alias("rel_path"), "text"), path)
    return files.corpus_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence statistics of top-level regions, which SQL can follow."""
    pages = _pages(spark, sf_dir)
    return _rounded(pages.select("page_no", F.size(F.filter("detections", lambda d: d["kind"] == "region")).alias("n_regions"), F.size("lines").alias("n_lines")))


def language_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram, language-model, interaction and lexicon groups of every page, with resources from the scanned lines."""
    pages = durable(_pages(spark, sf_dir))
    lines = durable(table(spark, sf_dir, "text_lines").dropDuplicates(["line_no"]).select("text").filter("text IS NOT NULL"))
    sets = None
    for n in language.ORDERS:
        part = ngrams.frequent(lines, n, 5, 5000).select("n", "gram")
        sets = part if sets is None else sets.unionByName(part)
    counts, totals = ngrams.model(lines, 4)
    words = table(spark, sf_dir, "lexicon").select("lexicon_name", F.lower("word").alias("word"))
    parts = (language.ngram_features(pages, durable(sets)), language.model_features(pages, counts, totals, 4), language.lexicon_features(pages, words, ["main", "court"]))
    return parts[0].join(parts[1], "page_no").join(parts[2], "page_no")


def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a training run with baselines, search and selection."""
    rows = _train(spark, sf_dir).select("row_no", "split", *FEATURES, "target_bow_f1", "target_perm_cer_strict")
    cfg = training.Config(("target_bow_f1", "target_perm_cer_strict"), ("full", "confidence_only"), "row_no", select="permutation", top_k=3)
    return training.run(rows, cfg)["summary"]


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).filter("length(text) > 0").withColumn("width", F.length("text") * 9 + F.col("line_pos") % 7)
    return rows.select("line_no", F.explode(T.word_boxes(F.col("text"), F.col("width"))).alias("w")).groupBy("line_no").agg(F.count("*").alias("n_words"), F.max("w.x1").alias("x1"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per type by Structured Streaming: windows that the watermark has closed."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    base = f"{shared_dir(spark)}/pagelens/stream-{id(stream):x}-{spark.sparkContext.startTime}"
    query = (
        scoring.windowed_counts(stream, "ts", "event_type").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{base}/out")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p3_found, p3_objects, p3_lines, p6_found, p6_deep, p6_versions, p6_unified, group_stats, hist_equal, shifted_entropy, quantile_edges, array_features,
            line_shape, char_classes, no_alpha_lines, repetition_runs, word_token_counts, ngram_top, ngram_ratio, lm_perplexity, lexicon_match,
            bow_prf, linewise_cer, page_targets, geom_order, box_overlap, box_iou, polygon_iou, contained_boxes, printspace_order, left_right_order, top_down_order,
            line_spacing, order_inversions, polygon_boxes, pruned_tree, stem_pairing, excluded_paths, existing_images, paired_compare, metric_summary,
            page_ranks, top_bottom_pages, once_per_key, target_correlation, usable_features, weighted_errors, constant_baseline, holdout_split,
            correlated_features, boosted_search, boosted_scores, embedding_pca, page_features, made_page_features, page_layout_order, page_round_trip, alto_round_trip, csv_round_trip, corpus_round_trip, page_counts, language_features, training_run, word_boxes, streamed_events,
        )
    }


def oracle_sql() -> dict[str, str]:
    from pagelens.queries_sql import ORACLES

    return ORACLES


