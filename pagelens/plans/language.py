"""Page features that need resources: n-gram hits, language-model perplexity, lexicon matches, and their interaction with confidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.stats import NAN, finite, or_nan
from pagelens.operators import ngrams
from pagelens.plans.features import page_text
from pagelens.sources import page_json

ORDERS = (2, 3, 4, 5, 6, 7)


def ngram_features(page_rows: DataFrame, sets: DataFrame, key: str = "page_no") -> DataFrame:
    """char_{n}gram_ratio_present for n = 2..7; ``sets`` has n and gram. NaN for a text shorter than n."""
    texts = page_rows.filter("error IS NULL").select(key, page_text(F.col("lines")).alias("text"))
    parts = [ngrams.ratio_present(texts, sets.filter(F.col("n") == n).select("gram"), n, key) for n in ORDERS]
    return reduce(lambda a, b: a.join(b, key), parts)


class Scorer(Protocol):
    """What the language group asks of a model: key and ppl of each text (columns key and text), NaN where there is none."""

    def __call__(self, texts: DataFrame, key: str) -> DataFrame: ...


@dataclass
class NgramScorer:
    """The n-gram model as a scorer: tables of :func:`pagelens.operators.ngrams.model`."""

    counts: DataFrame
    totals: DataFrame
    order: int
    k: float = 0.1

    def __call__(self, texts: DataFrame, key: str) -> DataFrame:
        return ngrams.perplexity(texts, self.counts, self.totals, self.order, key, self.k)


def model_features(page_rows: DataFrame, counts: DataFrame, totals: DataFrame, order: int, key: str = "page_no", k: float = 0.1) -> DataFrame:
    """:func:`scored_features` by an n-gram model."""
    return scored_features(page_rows, NgramScorer(counts, totals, order, k), key)


def scored_features(page_rows: DataFrame, scorer: Scorer, key: str = "page_no") -> DataFrame:
    """page_ppl, mean, std and var of the lines' perplexities, and their correlation with line confidence (NaN below two pairs or without spread)."""
    pages = page_rows.filter("error IS NULL").select(key, page_text(F.col("lines")).alias("text"))
    lines = page_json.lines(page_rows, key).select(F.struct(key, "line_pos").alias("id"), key, "text", "seg_conf")
    whole = scorer(pages, key).withColumnRenamed("ppl", "page_ppl")
    each = scorer(lines.select("id", "text"), "id").join(lines.select("id", key, "seg_conf"), "id")
    p, c = finite(F.col("ppl")), finite(F.col("seg_conf"))
    x, y = F.when(c.isNotNull(), p), F.when(p.isNotNull(), c)
    spread = (F.count(x) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    stats = each.groupBy(key).agg(
        F.avg(p).alias("line_ppl_mean"),
        F.stddev_pop(p).alias("line_ppl_std"),
        F.var_pop(p).alias("line_ppl_var"),
        F.when(spread, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))).alias("corr_line_conf_vs_ppl"),
    )
    out = whole.join(stats, key, "left")
    return out.select(key, *(or_nan(F.col(n)).alias(n) for n in out.columns if n != key))


def lexicon_features(page_rows: DataFrame, lexicon: DataFrame, names: list[str], key: str = "page_no") -> DataFrame:
    """Match ratio, count and unique count per lexicon, of all together, and the share of words in none (lex_combined_oov_ratio)."""
    pages = page_rows.filter("error IS NULL").select(key, page_text(F.col("lines")).alias("text"))
    tokens = pages.select(key, F.explode_outer(T.word_tokens(F.col("text"))).alias("token"))
    long = ngrams.lexicon_match(tokens, lexicon, key)
    pick = lambda name, column: F.max(F.when(F.col("lexicon_name") == name, F.col(column)))
    columns = [F.coalesce(pick(n, c), F.lit(0)).cast("double").alias(f"lex_{n}_{c}") for n in names for c in ("match_ratio", "match_count", "unique_match_count")]
    both = pick("combined", "match_ratio")
    return long.groupBy(key).agg(*columns, both.alias("lex_combined_match_ratio"), (1 - both).alias("lex_combined_oov_ratio"), both.alias("lexicality_word_ratio"))


def metadata_features(century: float | None, script_type: Column | None) -> dict[str, Column]:
    """Columns only for what is known; the code of a script is a stable hash below 1000."""
    out = {} if century is None else {"century": F.lit(float(century))}
    return out if script_type is None else out | {"script_type_code": F.coalesce(F.pmod(F.xxhash64(script_type), F.lit(1000)).cast("double"), F.lit(NAN))}
