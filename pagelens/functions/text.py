"""Text functions of the page features and error rates, on JVM expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as Unicode text tools split it.
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]+"
WORD = r"([\p{L}\p{N}_]+)"
WORD_OR_MARK = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"


def word_tokens(text: Column) -> Column:
    """Runs of word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def mark_tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_OR_MARK), 1)


def collapsed(text: Column) -> Column:
    """Trimmed text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def word_count(text: Column) -> Column:
    """Number of pieces between white space."""
    c = collapsed(text)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def line_cer(truth: Column, read: Column) -> Column:
    """Edit distance over the length of the truth; an empty truth costs 0 against nothing, else 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(read) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, read) / F.length(truth))


def count_matching(text: Column, pattern: str) -> Column:
    """Characters of a class, given as a regular expression class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def char_classes(text: Column, prefix: str = "char") -> dict[str, Column]:
    """Shares of digits, punctuation, upper case and characters outside printable ASCII and Latin letters; the line break counts as such."""
    n = F.length(text)
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(float("nan")))
    return {
        f"{prefix}_digit_ratio": share(count_matching(text, r"\p{Nd}")),
        f"{prefix}_punct_ratio": share(count_matching(text, r"[^\p{L}\p{N}\s\p{Z}]")),
        f"{prefix}_upper_ratio": share(count_matching(text, r"\p{Lu}")),
        f"{prefix}_unknown_ratio": share(count_matching(text, r"[^\x20-\x7EÀ-ſ]")),
    }


def long_runs(text: Column, least: int = 5) -> Column:
    """Runs of one character of at least that length."""
    return F.regexp_count(text, F.lit(rf"(?s)(.)\1{{{least - 1},}}"))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def char_ngrams(text: Column, n: int) -> Column:
    """All windows of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def array_ngrams(tokens: Column, n: int) -> Column:
    """All windows of n tokens, joined by the unit separator."""
    return F.when(
        F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))
    ).otherwise(F.array().cast("array<string>"))


def normalize_token(fold_w: bool = False):
    """Arrow UDF: compatibility form, case folded, punctuation at the ends gone, inner white space collapsed, optionally w as v."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(s: str | None) -> str | None:
            if s is None:
                return None
            s = unicodedata.normalize("NFKC", s).casefold().strip()
            a, b = 0, len(s)
            while a < b and not s[a].isalnum():
                a += 1
            while b > a and not s[b - 1].isalnum():
                b -= 1
            s = " ".join(s[a:b].split())
            return s.replace("w", "v") if fold_w else s

        for batch in batches:
            yield batch.map(one, na_action="ignore")

    return run


def word_boxes(text: Column, width: Column) -> Column:
    """Words of a line with their left and right edge, from equal pixels per character; a word takes one character more, cut at the width."""
    step = F.floor(F.try_divide(width, F.length(text)))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<word:string,x0:long,x1:long>>").alias("out"))
    walked = F.aggregate(
        words, start,
        lambda a, w: F.struct(
            (a["at"] + step * (F.length(w) + 1)).cast("long").alias("at"),
            F.concat(a["out"], F.array(F.struct(w.alias("word"), a["at"].alias("x0"), F.least(a["at"] + step * (F.length(w) + 1), width).cast("long").alias("x1")))).alias("out"),
        ),
    )
    return walked["out"]


def sequence_confidence(log_probs: Column, penalty: float = 1.0) -> Column:
    """exp of the sum of log probabilities over the length to the power of the penalty; 1 for an empty sequence."""
    total = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(log_probs) > 0, F.exp(total / F.pow(F.size(log_probs), F.lit(penalty)))).otherwise(F.lit(1.0))


def token_confidences(tokens: Column, log_probs: Column) -> Column:
    """(token, probability) of every token that is not empty."""
    pairs = F.zip_with(tokens, log_probs, lambda t, p: F.struct(t.alias("token"), F.exp(p).alias("score")))
    return F.filter(pairs, lambda x: x["token"] != "")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def best_label(labels: list[str], logits: Column) -> Column:
    """The label with the highest logit, the first of equals; null for an empty array."""
    return F.get(F.lit(labels), F.array_position(logits, F.array_max(logits)).cast("int") - 1)


def unique_name(path: Column, name: Column) -> Column:
    """A file name made unique by twelve digits of its path's hash."""
    return F.concat_ws("_", F.regexp_replace(name, r"\.[^.]*$", ""), F.substring(F.sha2(path, 256), 1, 12))
