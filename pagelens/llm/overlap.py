"""Same or near-same records across splits: Aho–Corasick automata over sharded evaluation passages.

Each evaluation text is normalised to its words and cut into passages, one more than the changes that
are allowed; a training text with no more changes then holds at least one passage unchanged. Passages
belong to shards by their first words, each shard becomes automata over word codes, and training texts
run through the automata of the shards they can have passages of. A training and an evaluation text that
share a passage are compared at once, where both are at hand: by length, by a count of words in buckets
(which rules out all but texts of nearly the same words, so that wording shared by very many records
costs no comparison of each pair), and then by an exact word-level edit distance. Matched intervals are
merged into coverage per pair and per evaluation record.

Texts that are equal after normalising are compared once and expanded to rows at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import words
from pagelens.runtime import durable

#: One word in so many may be changed, missing or added.
ONE_IN = 8
#: Evaluation texts of an automaton, and training texts that run through it in one task at most.
PART_TEXTS = 50_000
BLOCK_TEXTS = 100_000
#: Passages of a shard; beyond it texts are routed by the first words of their passages.
SHARD_PASSAGES = 200_000
#: Buckets of the word counts that are compared before texts are.
COUNT_BUCKETS = 32


def normalised(rows: DataFrame, text: str = "page_text") -> DataFrame:
    """row_no, split, csv_file and norm (the words of the text, parted by blanks) of each row once; rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [" ".join(words(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(norm, pa.string())], names=["row_no", "split", "csv_file", "norm"])

    once = rows.select("row_no", "split", "csv_file", text).filter(F.col(text).isNotNull()).dropDuplicates(["row_no"])
    return once.mapInArrow(run, "row_no long, split string, csv_file string, norm string").filter("norm <> ''")


def passages(norm: list[str], one_in: int = ONE_IN) -> list[tuple[int, int]]:
    """(start, end) of the passages of a text: one more than the changes it may have.

    With e changes in texts of n and at most n + e words, e <= (n + e) / one_in, so e <= n / (one_in - 1).
    """
    n = len(norm)
    count = min(n // (one_in - 1) + 1, n)
    cuts = [i * n // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None; by furthest-reaching points per diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    reach = {0: slide(0, 0)}
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        ahead = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -1))
            i = min(i, n, m - d)
            if i >= 0 and i + d >= 0:
                ahead[d] = slide(i, d)
        reach = ahead
    return None


class _Coder(dict):
    """Word codes, remembered while one block is scanned; equal codes of unequal words only cost a verification."""

    def __missing__(self, word: str) -> int:
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code

    def sequence(self, norm: str) -> tuple[int, ...]:
        return tuple([self[w] for w in norm.split(" ")])


def _heads(norm: Column) -> Column:
    """Hashes of the distinct heads (one word, and two words in a row) a text's passages can start with."""
    split = F.split(norm, " ")
    pairs = F.transform(F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(split, i + 1)))
    return F.transform(F.array_distinct(F.concat(pairs, split)), lambda h: F.xxhash64(h))


def _own_heads(one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads = [], []
            for tid, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = norm.split(" ")
                for head in {" ".join(found[a : min(b, a + 2)]) for a, b in passages(found, one_in)}:
                    ids.append(tid)
                    heads.append(head)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(heads, pa.string())], names=["text_id", "head"])

    return run


def _within(spans: list[tuple[int, int]], found: list[str], padded: str) -> list[tuple[int, int]]:
    """The passages that stand in a text (given with a blank at both ends)."""
    return [(a, b) for a, b in spans if f" {' '.join(found[a:b])} " in padded]


_HITS = "train_id string, eval_id string, covered int, n_changed int, spans array<int>"


def _scan(one_in: int, shards: int):
    """All passages of a shard, from a part of the evaluation texts, against a block of training texts.

    Gives the pairs within the limit, and without train_id each evaluation text's passages that stand in
    any training text of the block. A pair that shares passages of several shards comes from the shard of the
    first one it shares.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        out: dict[str, list] = {"train_id": [], "eval_id": [], "covered": [], "n_changed": [], "spans": []}
        shard = int(key[0])
        coder = _Coder()
        eval_ids, norms = left["text_id"].tolist(), left["norm"].tolist()
        texts, spans, numbers = [], [], {}
        owner: list[tuple[int, int]] = []
        owned: list[list[int]] = []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

        def counted(codes: tuple[int, ...]) -> np.ndarray:
            return np.bincount(np.array(codes, dtype=np.int64) % COUNT_BUCKETS, minlength=COUNT_BUCKETS)

        counts = np.zeros((len(norms), COUNT_BUCKETS), dtype=np.int32)
        for t, norm in enumerate(norms):
            found = norm.split(" ")
            codes = coder.sequence(norm)
            cut = passages(found, one_in)
            texts.append(found)
            spans.append(cut)
            counts[t] = counted(codes)
            for k, (a, b) in enumerate(cut):
                if shards > 1 and shard_of(" ".join(found[a : min(b, a + 2)]), shards) != shard:
                    continue
                passage = codes[a:b]
                n = numbers.setdefault(passage, len(owned))
                if n == len(owned):
                    owned.append([])
                    automaton.add_word(passage, n)
                owned[n].append(len(owner))
                owner.append((t, k))
        if not owned or not len(right):
            return pd.DataFrame(out, dtype=object)
        automaton.make_automaton()
        owners = [np.array(o, dtype=np.int64) for o in owned]
        owner_text = np.array([t for t, _ in owner], dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        seen = np.zeros(len(owner), dtype=bool)
        for train_id, norm in zip(right["text_id"], right["norm"]):
            codes = coder.sequence(norm)
            hit = {n for _, n in automaton.iter(codes)}
            if not hit:
                continue
            at = np.concatenate([owners[n] for n in hit])
            seen[at] = True
            likely = np.unique(owner_text[at])
            # Every change adds a word to one side's counts and takes one from the other's at most.
            most = np.maximum(lengths[likely], len(codes)) // one_in
            fits = np.abs(lengths[likely] - len(codes)) <= most
            likely, most = likely[fits], most[fits]
            fits = np.abs(counts[likely] - counted(codes)).sum(axis=1) <= 2 * most
            padded, mine = f" {norm} ", None
            for t, e in zip(likely[fits].tolist(), most[fits].tolist()):
                if eval_ids[t] == train_id:
                    continue
                if shards > 1:
                    first = _within(spans[t], texts[t], padded)[:1]
                    if not first:
                        continue
                    a, b = first[0]
                    if shard_of(" ".join(texts[t][a : min(b, a + 2)]), shards) != shard:
                        continue
                mine = mine or norm.split(" ")
                changed = distance_within(mine, texts[t], e)
                if changed is not None:
                    out["train_id"].append(train_id)
                    out["eval_id"].append(eval_ids[t])
                    out["covered"].append(sum(b - a for a, b in _within(spans[t], texts[t], padded)))
                    out["n_changed"].append(changed)
                    out["spans"].append(None)
        stood: dict[int, list[int]] = {}
        for k in np.flatnonzero(seen).tolist():
            t, n = owner[k]
            stood.setdefault(t, []).extend(spans[t][n])
        for t, found in stood.items():
            for name, value in zip(out, (None, eval_ids[t], None, None, found)):
                out[name].append(value)
        return pd.DataFrame(out, dtype=object)

    return run


def shard_of(head: str, shards: int) -> int:
    return zlib.crc32(head.encode("utf-8", "surrogatepass")) % shards


def scanned(texts: DataFrame, one_in: int = ONE_IN, shard_passages: int = SHARD_PASSAGES, part_texts: int = PART_TEXTS, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Pairs of different texts, one in train and one in evaluation, within the limit (train_id, eval_id, covered, n_changed), and rows
    with null train_id and the passages (spans) of an evaluation text that stand in any training text.

    ``texts`` has text_id, norm, in_train and in_eval. Up to ``shard_passages`` passages are one shard, and
    every training text runs through it. Beyond, a training text goes to the shards of those heads of
    its own that some passage has; only hashes and ids move until texts are fetched once per shard.
    """
    # New names for equal columns, since both sides come from one table.
    evaluation, train = (texts.filter(side).select(F.col("text_id").alias("text_id"), F.col("norm").alias("norm")) for side in ("in_eval", "in_train"))
    n = F.size(F.split("norm", " "))
    count = evaluation.agg(F.coalesce(F.sum(F.least(F.expr(f"size(split(norm, ' ')) div {one_in - 1}") + 1, n)), F.lit(0))).first()[0]
    shards = max(1, -(-count // shard_passages))
    if shards == 1:
        left, right = (t.select(F.lit(0).cast("long").alias("shard"), "text_id", "norm") for t in (evaluation, train))
    else:
        heads = durable(evaluation.mapInArrow(_own_heads(one_in), "text_id string, head string").select("text_id", F.pmod(F.crc32("head"), F.lit(shards)).alias("shard"), F.xxhash64("head").alias("h")), "heads")
        opened = heads.select("shard", "h").distinct()
        left = heads.select("text_id", "shard").distinct().join(evaluation, "text_id").select("shard", "text_id", "norm")
        asked = train.select("text_id", F.explode(_heads(F.col("norm"))).alias("h"))
        right = asked.join(opened, "h").select("text_id", "shard").distinct().join(train, "text_id").select("shard", "text_id", "norm")
        left, right = durable(left, "evaluation"), durable(right, "train")
    # An automaton is built once per block of its texts, so blocks are large; few shards get more of them, for all cores.
    least = -(-train.sparkSession.sparkContext.defaultParallelism // shards)
    if shards == 1:
        parts, blocks = F.lit(max(1, -(-evaluation.count() // part_texts))), F.lit(max(least, -(-train.count() // block_texts)))
    else:
        plan = left.groupBy("shard").agg(F.ceil(F.count("*") / part_texts).cast("int").alias("parts")).join(
            right.groupBy("shard").agg(F.greatest(F.ceil(F.count("*") / block_texts), F.lit(least)).cast("int").alias("blocks")), "shard"
        )
        # One row per shard.
        plan = F.broadcast(durable(plan, "shards"))
        left, right = left.join(plan, "shard"), right.join(plan, "shard")
        parts, blocks = F.col("parts"), F.col("blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("text_id"), n).cast("int")
    left = left.select("shard", mine(parts).alias("part"), every(blocks).alias("block"), "text_id", "norm")
    right = right.select("shard", every(parts).alias("part"), mine(blocks).alias("block"), "text_id", "norm")
    keys = ["shard", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scan(one_in, shards), _HITS)


def matches(rows: DataFrame, one_in: int = ONE_IN, **limits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matching pairs of texts, the rows of each text, and the coverage of each evaluation text.

    ``rows`` has row_no, split (``train`` or anything else), csv_file and page_text; other columns are
    ignored, repeated row_no count once. Result: (pairs, members, coverage): pairs has train_id, eval_id,
    covered (words of the evaluation text in matched passages), n_changed (edit distance in words, at
    most one in ``one_in`` of the longer text), and holds each text that is in both splits with itself;
    members has row_no, split, csv_file, text_id; coverage has text_id, n_words and covered, its words in
    passages that stand in any training text, merged over all of them. Null, blank and wordless texts are
    no case; rows with a null split are neither train nor evaluation. Empty tables give empty results.
    ``limits`` are those of :func:`scanned`.
    """
    members = durable(normalised(rows).filter("split IS NOT NULL").withColumn("text_id", F.md5("norm")), "rows")
    texts = durable(
        members.groupBy("text_id", "norm").agg(F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval")), "texts"
    )
    hits = durable(scanned(texts, one_in, **limits), "hits")
    n_words = F.size(F.split("norm", " "))
    same = texts.filter("in_train AND in_eval").select(F.col("text_id").alias("train_id"), F.col("text_id").alias("eval_id"), n_words.alias("covered"), F.lit(0).alias("n_changed"))
    pairs = same.unionByName(hits.filter("train_id IS NOT NULL").select("train_id", "eval_id", "covered", "n_changed"))
    merged = hits.filter("train_id IS NULL").groupBy("eval_id").agg(_coverage(F.flatten(F.collect_list("spans"))).alias("covered"))
    coverage = (
        texts.filter("in_eval").join(merged.withColumnRenamed("eval_id", "text_id"), "text_id", "left")
        .select("text_id", n_words.alias("n_words"), F.when(F.col("in_train"), n_words).otherwise(F.coalesce("covered", F.lit(0))).alias("covered"))
    )
    return durable(pairs, "pairs"), members.select("row_no", "split", "csv_file", "text_id"), coverage


def _coverage(spans: Column) -> Column:
    """Words of the evaluation text in matched passages; passages of a text never overlap, equal ones count once."""
    starts = F.filter(F.transform(spans, lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("a"), F.get(spans, i + 1).alias("b")))), lambda s: s.isNotNull())
    return F.aggregate(F.array_distinct(starts), F.lit(0), lambda acc, s: acc + s["b"] - s["a"])


def row_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of rows behind pairs of texts: row_no_a (smaller), row_no_b, train_row, eval_row, covered, n_changed."""
    train = members.filter("split = 'train'").select(F.col("row_no").alias("train_row"), F.col("text_id").alias("train_id"))
    evaluation = members.filter("split <> 'train'").select(F.col("row_no").alias("eval_row"), F.col("text_id").alias("eval_id"))
    return pairs.join(train, "train_id").join(evaluation, "eval_id").select(
        F.least("train_row", "eval_row").alias("row_no_a"), F.greatest("train_row", "eval_row").alias("row_no_b"), "train_row", "eval_row", "covered", "n_changed"
    )


def counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per split and csv_file: its evaluation rows, those that also stand in train, and those that do exactly."""
    best = pairs.groupBy(F.col("eval_id").alias("text_id")).agg(F.min("n_changed").alias("n_changed"))
    rows = members.filter("split <> 'train'").join(best, "text_id", "left")
    return rows.groupBy("split", "csv_file").agg(
        F.count("*").alias("n_rows"), F.count("n_changed").alias("n_overlapping"), F.count_if(F.col("n_changed") == 0).alias("n_exact")
    )


def record_coverage(members: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per evaluation row the share of its words that stand in training texts, passage by passage: row_no, split, csv_file, n_words, covered, share."""
    rows = members.filter("split <> 'train'").join(coverage, "text_id")
    return rows.select("row_no", "split", "csv_file", "n_words", "covered", (F.col("covered") / F.col("n_words")).alias("share"))
