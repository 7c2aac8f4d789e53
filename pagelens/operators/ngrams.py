"""Character and word n-grams: frequent sets, hit ratios, add-k language models and perplexity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.runtime import collect_small

SEPARATOR = "\x1f"
#: Named lexicons of one search.
MAX_LEXICONS = 10_000
#: n-grams of a set, or contexts of a model, and their characters, up to which they are sent to all workers.
SMALL_SET, SMALL_CHARS = 200_000, 4_000_000
#: Places that the rows of one frequent n-gram are spread over in a join.
SALTS = 16


def grams(texts: DataFrame, n: int, text: str = "text", level: str = "char") -> DataFrame:
    """The rows with one n-gram each (column gram), besides the other columns."""
    source = T.char_ngrams(T.collapsed(F.col(text)), n) if level == "char" else T.array_ngrams(T.mark_tokens(F.col(text)), n)
    return texts.withColumn("gram", F.explode(source)).drop(text)


def frequent(texts: DataFrame, n: int, min_count: int = 5, top: int | None = None, text: str = "text", level: str = "char") -> DataFrame:
    """n-grams that stand at least ``min_count`` times: n, gram, cnt; with ``top`` the most frequent ones (ties by gram)."""
    counted = grams(texts.select(text), n, text, level).groupBy("gram").agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= min_count)
    if top is not None:
        counted = counted.orderBy(F.desc("cnt"), "gram").limit(top)
    return counted.select(F.lit(n).alias("n"), "gram", "cnt")


def _small(table: DataFrame, column: str) -> bool:
    """Whether a table is within SMALL_SET rows and SMALL_CHARS characters of a column, found out before it is fetched."""
    n, chars = table.agg(F.count("*"), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    return n <= SMALL_SET and chars <= SMALL_CHARS


def ratio_present(texts: DataFrame, allowed: DataFrame, n: int, key: str, text: str = "text") -> DataFrame:
    """Per row the share of its n-grams that are in ``allowed`` (column gram); NaN for a text shorter than n.

    ``key`` is unique. A set of a checked size goes to the workers and no text moves; a larger one is joined, with
    the n-grams counted per key before they move and frequent ones spread by key.
    """
    name = f"char_{n}gram_ratio_present"
    if _small(allowed, "gram"):
        known = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in allowed.select("gram").collect()))

        @F.pandas_udf("double")
        def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            grams = known.value
            for batch in batches:
                out = []
                for t in batch.tolist():
                    found = [t[i : i + n] in grams for i in range(len(t or "") - n + 1)]
                    out.append(sum(found) / len(found) if found else float("nan"))
                yield pd.Series(out, dtype="float64")

        return texts.select(key, share(T.collapsed(F.col(text))).alias(name))
    rows = grams(texts.select(key, text), n, text).groupBy(key, "gram").agg(F.count("*").alias("cnt"))
    # A frequent n-gram stands in very many texts: its rows go to SALTS places.
    salted = allowed.select("gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(1).alias("hit"))
    hit = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"], "left").groupBy(key).agg(F.sum(F.col("hit") * F.col("cnt")).alias("hits"), F.sum("cnt").alias("total"))
    return texts.select(key).distinct().join(hit, key, "left").select(
        key, F.when(F.col("total") > 0, F.coalesce("hits", F.lit(0)) / F.col("total")).otherwise(F.lit(float("nan"))).alias(name)
    )


def model(texts: DataFrame, order: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A character model as two tables: counts(context, token, cnt) and totals(context, total, vocab)."""
    windows = texts.select(F.explode(T.char_ngrams(F.col(text), order)).alias("w"))
    counts = windows.groupBy(F.substring("w", 1, order - 1).alias("context"), F.substring("w", order, 1).alias("token")).agg(F.count("*").alias("cnt"))
    totals = counts.groupBy("context").agg(F.sum("cnt").alias("total"), F.count("*").alias("vocab"))
    return counts, totals


def perplexity(texts: DataFrame, counts: DataFrame, totals: DataFrame, order: int, key: str, k: float = 0.1, text: str = "text") -> DataFrame:
    """Per row exp of the mean negative log probability of its characters under add-k smoothing; NaN if shorter than the order.

    ``key`` is unique. White space is removed before windows are cut. The vocabulary is that of the
    context; an unseen context has probability 1. A model of a checked size goes to the workers and no
    text moves; a larger one is joined, with windows counted per key and frequent ones spread by key.
    """
    bare = F.regexp_replace(text, T.SPACE, "")
    table = counts.join(totals, "context").select(F.concat("context", "token").alias("w"), "context", "cnt", "total", "vocab")
    if _small(table, "w"):
        rows = table.collect()
        floor = 1e-12
        known = {r.w: math.log(max((r.cnt + k) / (r.total + k * r.vocab), floor)) for r in rows}
        unseen = {r.context: math.log(max(k / (r.total + k * r.vocab), floor)) for r in rows}
        shared = texts.sparkSession.sparkContext.broadcast((known, unseen))

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            seen, context = shared.value
            for batch in batches:
                out = []
                for t in batch.tolist():
                    windows = [t[i : i + order] for i in range(len(t or "") - order + 1)]
                    logs = [seen[w] if w in seen else context.get(w[:-1], 0.0) for w in windows]
                    out.append(math.exp(-math.fsum(logs) / len(logs)) if logs else float("nan"))
                yield pd.Series(out, dtype="float64")

        return texts.select(key, run(bare).alias("ppl"))
    windows = texts.select(key, F.explode(T.char_ngrams(bare, order)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("times"))
    split = windows.withColumn("context", F.substring("w", 1, order - 1)).withColumn("token", F.substring("w", order, 1)).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    p = (F.coalesce("cnt", F.lit(0)) + F.lit(k)) / (F.coalesce("total", F.lit(0)) + F.lit(k) * F.coalesce("vocab", F.lit(1)))
    scored = (
        split.join(counts.select("*", every), ["context", "token", "salt"], "left").join(totals.select("*", every), ["context", "salt"], "left")
        .withColumn("logp", F.ln(F.greatest(p, F.lit(1e-12))))
    )
    done = scored.groupBy(key).agg((F.sum(F.col("logp") * F.col("times")) / F.sum("times")).alias("mean_logp"))
    return texts.select(key).distinct().join(done, key, "left").select(key, F.coalesce(F.exp(-F.col("mean_logp")), F.lit(float("nan"))).alias("ppl"))


def lexicon_match(tokens: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Per key and lexicon: match_ratio, match_count, unique_match_count; ratio 0 for a key without tokens.

    ``tokens`` has key and token (null token: a key without tokens), ``lexicon`` lexicon_name and word.
    The lexicon named ``combined`` is the union of all.
    """
    words = lexicon.select("lexicon_name", "word").filter("word IS NOT NULL").distinct()
    every = words.unionByName(words.select(F.lit("combined").alias("lexicon_name"), "word").distinct())
    counted = tokens.groupBy(key, "token").agg(F.count("token").alias("n"))
    totals = counted.groupBy(key).agg(F.sum("n").alias("n_tokens"))
    names = every.select("lexicon_name").distinct()
    hits = counted.join(every.withColumnRenamed("word", "token"), "token").groupBy(key, "lexicon_name").agg(F.sum("n").alias("match_count"), F.count("*").alias("unique_match_count"))
    named = totals.withColumn("lexicon_name", F.explode(F.lit([r[0] for r in collect_small(names, MAX_LEXICONS, "lexicons")] or ["combined"])))
    return named.join(hits, [key, "lexicon_name"], "left").select(
        key,
        "lexicon_name",
        F.when(F.col("n_tokens") > 0, F.coalesce("match_count", F.lit(0)) / F.col("n_tokens")).otherwise(0.0).alias("match_ratio"),
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.coalesce("unique_match_count", F.lit(0)).alias("unique_match_count"),
    )


def ranked(rows: DataFrame, key: list[str], count: str, item: str) -> DataFrame:
    """Rank of each item within its key by falling count, ties by item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(count), item)))
