"""Queries of the training-data operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm import leakage, lookalike, mixing, overlap, percentiles, repair, repetition, splits
from pagelens.runtime import durable, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups(table(spark, sf_dir, "dataset_pages")).filter("group_volume_no IS NOT NULL").select("rec_no", "group_volume_no")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = splits.proportions(table(spark, sf_dir, "xgb_summary_metrics"))
    return splits.assign(durable(splits.groups(table(spark, sf_dir, "dataset_pages"))), shares)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = splits.proportions(table(spark, sf_dir, "xgb_summary_metrics"))
    return splits.report(p1_splits(spark, sf_dir), shares)


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset tag whether groups stay whole and the shares aimed at are reached.

    A share may miss its aim by two in a hundred and by what the tag's largest group holds.
    """
    shares = splits.proportions(table(spark, sf_dir, "xgb_summary_metrics"))
    rows = durable(p1_splits(spark, sf_dir), "splits")
    apart = rows.groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n <> 1").select("group_id")
    torn = rows.join(apart, "group_id", "left_semi").groupBy("dataset_tag").agg(F.count("*").alias("n_torn"))
    largest = rows.groupBy("dataset_tag", "group_id").agg(F.count("*").alias("n")).groupBy("dataset_tag").agg(F.max("n").alias("largest"), F.sum("n").alias("n_records"))
    missed = splits.report(rows, shares).groupBy("dataset_tag").agg(F.max(F.abs(F.col("share") - F.col("target_share"))).alias("missed"))
    return largest.join(missed, "dataset_tag").join(torn, "dataset_tag", "left").select(
        "dataset_tag", "n_records", F.coalesce("n_torn", F.lit(0).cast("long")).alias("n_torn"), (F.col("missed") <= 0.02 + F.col("largest") / F.col("n_records")).alias("shares_reached")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(table(spark, sf_dir, "text_lines"), table(spark, sf_dir, "lexicon"))
    return found.filter("kind IN ('running_header', 'page_number', 'split_word', 'misread')").select("line_no", "kind").distinct()


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.paragraphs(durable(repair.repair(table(spark, sf_dir, "text_lines"), table(spark, sf_dir, "lexicon")), "lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking(table(spark, sf_dir, "text_lines"), table(spark, sf_dir, "ref_lines"))


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical(table(spark, sf_dir, "text_lines"), table(spark, sf_dir, "ref_lines"), table(spark, sf_dir, "lexicon"))


def p4_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon word nearest to each distinct token of the lines, with at most one edit besides look-alikes."""
    return lookalike.spellings(table(spark, sf_dir, "text_lines"), table(spark, sf_dir, "lexicon"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(percentiles.values(table(spark, sf_dir, "text_lines")))


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.cells(percentiles.values(table(spark, sf_dir, "text_lines")))


def p5_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.from_cells(p5_cells(spark, sf_dir), ("dataset_tag", "measure"))


def p5_bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.bin_edges(p5_combined(spark, sf_dir), ("dataset_tag", "measure")).select("dataset_tag", "measure", F.col("i").cast("long").alias("i"), F.round("edge", 9).alias("edge"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members, _ = overlap.matches(table(spark, sf_dir, "train_rows"))
    return overlap.row_pairs(pairs, members).select("row_no_a", "row_no_b").distinct()


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members, _ = overlap.matches(table(spark, sf_dir, "train_rows"))
    return overlap.counts(pairs, members)


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members, _ = overlap.matches(table(spark, sf_dir, "train_rows"))
    return overlap.row_pairs(pairs, members).select("train_row", "eval_row", "covered", "n_changed")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation row how much of it stands in training texts."""
    _, members, coverage = overlap.matches(table(spark, sf_dir, "train_rows"))
    return overlap.record_coverage(members, coverage)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("item_no", "doc_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p8_found with the kind of match: phrase or proximity."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_found(spark, sf_dir).groupBy("item_no").agg(F.count("*").alias("n_documents"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(durable(mixing.sizes(table(spark, sf_dir, "documents")), "sizes"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p9_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source whether its share of all tokens is reached and no document is used too often.

    A share may miss its aim by two in a hundred and by what two of the largest documents hold.
    """
    picked = durable(p9_selection(spark, sf_dir), "selection")
    rows = mixing.report(picked, table(spark, sf_dir, "mix_targets"))
    present = table(spark, sf_dir, "documents").filter("trim(text) <> ''").select(F.col("source").alias("source_name")).distinct().withColumn("there", F.lit(True))
    largest, total = picked.agg(F.max("n_tokens"), F.sum(F.col("n_uses") * F.col("n_tokens"))).first()
    rows = rows.join(present, "source_name", "left").withColumn("aim", F.when(F.col("there") & (F.col("target_share") > 0), F.col("target_share")).otherwise(0.0))
    # One window over as many rows as there are sources.
    aim = F.col("aim") / F.sum("aim").over(Window.partitionBy(F.lit(1)))
    near = 0.02 + 2 * (largest or 0) / (total or 1)
    return rows.select("source_name", F.round(aim, 6).alias("share"), (F.abs(F.col("actual_share") - aim) <= near).alias("share_reached"), (F.col("most_uses") <= F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("cap_kept"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents")).select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents"), exact="all", byte_ratios=False).select("doc_id", "n_words", "repeated_words", F.round("repeated_share", 9).alias("repeated_share"))


def p10_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_splits, p1_report, p1_kept, p2_found, p2_paragraphs, p4_found, p4_normalised, p4_spellings, p5_percentiles, p5_cells, p5_combined, p5_bin_edges, p7_found, p7_counts, p7_pairs, p7_coverage, p8_found, p8_matches, p8_items, p9_selection, p9_shares, p9_kept, p10_found, p10_shares, p10_bands,
    )}


_VALUES = """
WITH once AS (SELECT DISTINCT line_no, dataset_tag, CAST(scored_at AT TIME ZONE 'UTC' AS DATE) AS day, htr_score, line_conf, region_conf FROM text_lines),
vals AS (SELECT dataset_tag, day, m.measure AS measure, m.value AS value FROM once, LATERAL (VALUES ('htr_score', htr_score), ('line_conf', line_conf), ('region_conf', region_conf)) m(measure, value)
  WHERE m.value >= 0 AND m.value <= 1 AND NOT isnan(m.value))
"""
_PERMILLE = "(VALUES " + ", ".join(f"({p})" for p in percentiles.PERMILLE) + ") p(permille)"


def oracle_sql() -> dict[str, str]:
    combined = f"""{_VALUES},
cells AS (SELECT dataset_tag, measure, CAST(floor(value * 1024) AS BIGINT) AS cell, count(*) AS k FROM vals GROUP BY 1, 2, 3),
summed AS (SELECT *, CAST(sum(k) OVER (PARTITION BY dataset_tag, measure ORDER BY cell) AS BIGINT) AS upto, CAST(sum(k) OVER (PARTITION BY dataset_tag, measure) AS BIGINT) AS n FROM cells),
picked AS (SELECT dataset_tag, measure, permille, n, cell FROM summed, {_PERMILLE}
  WHERE greatest(1, (n * permille + 999) // 1000) <= upto AND greatest(1, (n * permille + 999) // 1000) > upto - k)
"""
    # Single characters that stand for another one, and the characters that don't count, as SQL lists.
    wide = [chr(c) for c in (*range(0xFF01, 0xFF5F), *range(0x2160, 0x2180), 0x212A, 0x212B, *lookalike.LOOK_ALIKES)]
    plain = {c: lookalike.plain(c) for c in wide if len(lookalike.plain(c)) == 1 and lookalike.plain(c) != c}
    quoted = [("".join(x)).replace("'", "''") for x in (plain, plain.values())]
    form = f"""trim(nfc_normalize(translate(regexp_replace(regexp_replace(text, '[\\p{{Cf}}]', '', 'g'), '[\\s\\p{{Z}}]', ' ', 'g'), '{quoted[0]}', '{quoted[1]}')))"""
    fold = "translate({0}, 'wW', 'vV')"
    unknown = ", ".join(f"'{p}'" for p in splits.PLACEHOLDERS)
    return {
        "p1_found": f"""
WITH RECURSIVE once AS (SELECT DISTINCT rec_no, source_page_id, volume_no, regexp_replace(lower(scribe_ref), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') AS w FROM dataset_pages),
k AS (SELECT rec_no, 's' || source_page_id AS key FROM once WHERE source_page_id IS NOT NULL UNION SELECT rec_no, 'v' || volume_no FROM once WHERE volume_no IS NOT NULL
  UNION SELECT rec_no, 'w' || w FROM once WHERE w IS NOT NULL AND w NOT IN ({unknown})),
kk AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (rec_no)),
reach AS (SELECT DISTINCT key AS a, key AS b FROM k UNION SELECT r.a, kk.b FROM reach r JOIN kk ON kk.a = r.b)
SELECT k.rec_no, min(CAST(substr(r.b, 2) AS BIGINT)) AS group_volume_no FROM k JOIN reach r ON r.a = k.key WHERE r.b LIKE 'v%' GROUP BY k.rec_no""",
        "p4_found": f"""
WITH l AS (SELECT DISTINCT line_no, text, {form} AS f FROM text_lines WHERE text IS NOT NULL), r AS (SELECT DISTINCT ref_no, text, map_w_to_v AS m, {form} AS f FROM ref_lines WHERE text IS NOT NULL)
SELECT DISTINCT line_no, ref_no FROM l JOIN r ON CASE WHEN r.m THEN {fold.format('l.f')} = {fold.format('r.f')} ELSE l.f = r.f END WHERE l.text <> r.text""",
        "p1_kept": "SELECT dataset_tag, count(DISTINCT rec_no) AS n_records, CAST(0 AS BIGINT) AS n_torn, true AS shares_reached FROM dataset_pages WHERE dataset_tag IS NOT NULL GROUP BY dataset_tag",
        "p9_kept": """
WITH a AS (SELECT t.source_name, CASE WHEN d.source IS NOT NULL AND t.target_share > 0 THEN t.target_share ELSE 0.0 END AS aim FROM mix_targets t LEFT JOIN (SELECT DISTINCT source FROM documents WHERE trim(text) <> '') d ON d.source = t.source_name)
SELECT source_name, round(aim / sum(aim) OVER (), 6) AS share, true AS share_reached, true AS cap_kept FROM a""",
        "p4_normalised": f"""
WITH l AS (SELECT DISTINCT line_no, text FROM text_lines), r AS (SELECT DISTINCT ref_no, text, coalesce(map_w_to_v, false) AS m FROM ref_lines),
e AS (SELECT line_no, CAST(NULL AS BIGINT) AS ref_no, m.m AS m, text FROM l, (VALUES (false), (true)) m(m) UNION ALL SELECT NULL, ref_no, m, text FROM r), f AS (SELECT *, {form} AS f FROM e)
SELECT line_no, ref_no, m AS map_w_to_v, CASE WHEN m THEN {fold.format('f')} ELSE f END AS norm FROM f""",
        "p10_shares": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)),
h AS (SELECT doc_id, i FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, g) AS first FROM g) WHERE i > first),
c AS (SELECT doc_id, count(DISTINCT i + d) AS k FROM h, (SELECT unnest(range(8)) AS d) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(k, 0) AS repeated_words, round(CASE WHEN len(ws) > 0 THEN coalesce(k, 0) / len(ws) ELSE 0.0 END, 9) AS repeated_share FROM w LEFT JOIN c USING (doc_id)""",
        "p10_found": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g, len(ws) AS n FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)),
h AS (SELECT doc_id, n, i FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, g) AS first FROM g) WHERE i > first),
c AS (SELECT DISTINCT doc_id, n, i + d AS p FROM h, (SELECT unnest(range(8)) AS d))
SELECT doc_id FROM c GROUP BY doc_id, n HAVING count(*) >= 0.3 * n""",
        "p5_percentiles": f"""{_VALUES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_tag, day, measure ORDER BY value) AS r, count(*) OVER (PARTITION BY dataset_tag, day, measure) AS n FROM vals)
SELECT dataset_tag, day, measure, permille, n, value, 0.0::DOUBLE AS error_bound FROM ranked, {_PERMILLE} WHERE r = greatest(1, (n * permille + 999) // 1000)""",
        "p5_cells": f"""{_VALUES}
SELECT dataset_tag, day, measure, CAST(floor(value * 1024) AS BIGINT) AS cell, count(*) AS n FROM vals GROUP BY 1, 2, 3, 4""",
        "p5_combined": f"""{combined}
SELECT dataset_tag, measure, permille, n, cell / 1024.0::DOUBLE AS lo, (cell + 1) / 1024.0::DOUBLE AS hi, (cell + 0.5::DOUBLE) / 1024.0::DOUBLE AS value, 0.00048828125::DOUBLE AS error_bound FROM picked""",
        "p5_bin_edges": f"""{combined},
every AS (SELECT DISTINCT dataset_tag, measure, (cell + 0.5::DOUBLE) / 1024.0::DOUBLE AS edge FROM picked
  UNION SELECT DISTINCT dataset_tag, measure, x::DOUBLE FROM picked, (VALUES (0.0), (1.000001)) v(x))
SELECT dataset_tag, measure, row_number() OVER (PARTITION BY dataset_tag, measure ORDER BY edge) - 1 AS i, round(edge, 9) AS edge FROM every""",
    }
