"""File readers: directories by stem, CSV tables, lexicons, corpora, exclude lists, images."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.compare import stem


def indexed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """stem, path and content of the files below ``root`` that match, one per stem: the first path by spelling."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    first = files.select("path").groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path"))
    return files.join(first, "path").select("stem", "path", F.col("content"))


def csv_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files with headers as one table, columns matched by name; a missing file is an error."""
    parts = [spark.read.csv(p, header=True, inferSchema=True) for p in paths]
    if not parts:
        raise ValueError("no CSV files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def training_table(spark: SparkSession, train: Sequence[str], evaluation: Sequence[str] = ()) -> DataFrame:
    """Training and evaluation CSVs with column ``split``."""
    df = csv_tables(spark, train).withColumn("split", F.lit("train"))
    return df.unionByName(csv_tables(spark, evaluation).withColumn("split", F.lit("eval")), allowMissingColumns=True) if evaluation else df


def dmlex_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct written forms of a DMLex XML lexicon, at any depth."""
    body = spark.read.text(path, wholetext=True)
    forms = F.expr("xpath(value, '//*[local-name()=\"feat\"][@att=\"writtenForm\"]/@val')")
    return body.select(F.explode(forms).alias("word")).distinct()


def table_words(spark: SparkSession, path: str, column: str, delimiter: str = "\t", comment: str = "#") -> DataFrame:
    """Distinct words of one column of a delimited table, whose header is its first line, behind the comment mark or not."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    head = lines.first()
    names = [c.strip() for c in (head[0] if head else "").lstrip(comment).split(delimiter)]
    if column not in names:
        raise ValueError(f"{path} has no column {column}")
    field = F.get(F.split("value", f"\\Q{delimiter}\\E"), names.index(column))
    return lines.filter((~F.col("value").startswith(comment)) & (F.col("value") != F.lit(head[0]))).select(F.trim(field).alias("word")).filter("word <> ''").distinct()


def dictionary_hits(spark: SparkSession, path: str, lemgram: int = 1, dash: str = "–") -> DataFrame:
    """Distinct words of a white-space table whose column ``lemgram`` is no dash."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(parts, 0).alias("word"), F.get(parts, lemgram).alias("hit")).filter(F.col("hit").isNotNull() & (F.col("hit") != dash)).select("word").distinct()


def lexicons(spark: SparkSession, manifest: str) -> DataFrame:
    """lexicon_name and word of all lexicons of a JSON manifest: a list of {name, type, path, …}."""
    with open(manifest, encoding="utf-8") as f:
        entries = json.load(f)
    entries = entries.get("lexicons", []) if isinstance(entries, dict) else entries
    parts = []
    for e in entries:
        path = os.path.join(os.path.dirname(manifest), e["path"])
        if e["type"] == "dmlex_xml":
            words = dmlex_words(spark, path)
        elif e["type"] == "table":
            words = table_words(spark, path, e["word_col"], e.get("delimiter", "\t"), e.get("comment_prefix", "#"))
        elif e["type"] == "saol_matches":
            words = dictionary_hits(spark, path, e.get("lemgram_idx", 1), e.get("dash_token", "–"))
        else:
            raise ValueError(f"unknown lexicon type: {e['type']}")
        parts.append(words.select(F.lit(e["name"]).alias("lexicon_name"), "word"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "lexicon_name string, word string")


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text corpus (column text) without blank lines and those that begin with #."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter((F.trim("text") != "") & ~F.col("text").startswith("#"))


def volumes(files: DataFrame) -> DataFrame:
    """``files`` with volume, the folder each file lies in."""
    return files.withColumn("volume", F.element_at(F.split("path", "/"), -2))


def inputs(given: Sequence[str] = (), listed: str | None = None) -> list[str]:
    """Input paths from arguments or from a file with one per line; exactly one of both."""
    if bool(given) == bool(listed):
        raise ValueError("give either inputs or a file that lists them")
    if given:
        return list(given)
    with open(listed, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


def images(spark: SparkSession, path: str) -> DataFrame:
    """Images by Spark's image source; unreadable ones are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path)
