"""Evaluation passages leaking into training text: a distributed positional inverted index.

The index is built once over whole documents (:func:`build_index`) and serves any number of searches. It
is parted by documents: a shard covers a run of documents and stores, for every term, the positions at
which it stands. A search (:func:`search`) asks every shard for all passages. For each window of
consecutive passage words it starts from the list of the window's rarest term and intersects it with the
offset-adjusted lists of the other terms, from rare to frequent; what is left are exact phrase matches.
A part of ``min_words`` or more words with at most one in ``one_in`` altered always holds such a window
unaltered (:func:`seed_words`: n words with e changes leave an unbroken run of at least (n - e) / (e + 1)).
Around the phrase matches a banded alignment over the same lists then decides on the proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import BREAK, batch_words, words
from pagelens.runtime import collect_small, durable

MIN_WORDS = 20
ONE_IN = 8
#: Passages, and characters of passages, that one search broadcasts; more are searched in blocks.
BLOCK_PASSAGES = 50_000
BLOCK_CHARS = 32_000_000
#: Characters of text in one shard of the index.
SHARD_CHARS = 8_000_000
#: Pairs of a passage word and a posting that are intersected at once.
PAIRS = 2_000_000

_INDEX = "doc_ids array<long>, ends array<int>, terms array<string>, offsets array<int>, positions array<int>"
_INDEX_ARROW = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.string())),
        ("offsets", pa.list_(pa.int32())),
        ("positions", pa.list_(pa.int32())),
    ]
)


def seed_words(min_words: int = MIN_WORDS, one_in: int = ONE_IN) -> int:
    """Words in a row that every part of ``min_words`` or more words keeps if at most one in ``one_in`` is altered.

    A longer part holds one of fewer than twice ``min_words`` words that keeps the proportion.
    """
    return max(1, min(-(-(n - n // one_in) // (n // one_in + 1)) for n in range(min_words, 2 * min_words)))


class Passages:
    """The evaluation passages as term codes: one array over all passages, with a break (code 0) after each."""

    def __init__(self, rows: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> None:
        self.terms: dict[str, int] = {}
        code, item, self.item_no, self.start, self.length = [], [], [], [], []
        for item_no, text in rows:
            found = words(text, join_lines=True)
            if len(found) < min_words:
                continue
            self.start.append(len(code))
            self.length.append(len(found))
            code += [self.terms.setdefault(w, len(self.terms) + 1) for w in found] + [0]
            item += [len(self.item_no)] * (len(found) + 1)
            self.item_no.append(item_no)
        self.code = np.array(code, dtype=np.int64)
        self.item = np.array(item, dtype=np.int64)


def build_index(documents: DataFrame) -> DataFrame:
    """The index shards: doc_ids, ends (position after each document), and the lists of all terms in CSR form.

    ``documents`` has doc_id and text; null texts are documents without words. No shuffle: a shard
    holds up to SHARD_CHARS characters of the documents of one partition, a longer text alone.
    """

    def shard(ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
        found = batch_words(texts, join_lines=True)
        code, terms = pd.factorize(np.array(found, dtype=object))
        stop = np.flatnonzero(terms == BREAK)[0]
        ends = np.flatnonzero(code == stop)
        order = np.argsort(code.astype(np.int32), kind="stable")
        offsets = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms))))
        # The break is no term: its list is empty.
        order = np.delete(order, np.s_[offsets[stop] : offsets[stop + 1]])
        offsets[stop + 1 :] -= len(ends)
        values = (ids, ends, terms, offsets, order)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX_ARROW)], schema=_INDEX_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and size + len(text or "") > SHARD_CHARS:
                    yield shard(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
        if ids:
            yield shard(ids, texts)

    return documents.select("doc_id", "text").mapInArrow(run, _INDEX)


class Lists:
    """The postings of a shard that passages ask for; terms are passage codes, lists ascend."""

    def __init__(self, p: Passages, row: dict) -> None:
        self.ends = np.asarray(row["ends"], dtype=np.int64)
        self.size = int(self.ends[-1]) + 1
        get = p.terms.get
        asked = np.fromiter((get(t, 0) for t in row["terms"].tolist()), dtype=np.int64, count=len(row["terms"]))
        at = np.flatnonzero(asked)
        at = at[np.argsort(asked[at])]
        offsets = np.asarray(row["offsets"], dtype=np.int64)
        many = offsets[at + 1] - offsets[at]
        #: Per passage code the length and the beginning of its list.
        self.count = np.zeros(len(p.terms) + 1, dtype=np.int64)
        self.count[asked[at]] = many
        self.first = np.cumsum(self.count) - self.count
        starts = np.repeat(offsets[at] - (np.cumsum(many) - many), many)
        self.positions = np.asarray(row["positions"])[starts + np.arange(len(starts))].astype(np.int64)
        #: Code and position as one ascending key, so that any number of (code, position) are looked up at once.
        self.keys = np.repeat(asked[at], many) * self.size + self.positions

    def hold(self, code: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its code; positions outside the shard are in none."""
        inside = (position >= 0) & (position < self.size) & (code > 0)
        wanted = np.where(inside, code * self.size + position, -1)
        slot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return inside & (self.keys[slot] == wanted) if len(self.keys) else np.zeros(wanted.shape, dtype=bool)


def _phrases(p: Passages, lists: Lists, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the passages, position in the shard) of every window of ``seed`` passage words that stands in the shard."""
    none = np.zeros(0, dtype=np.int64)
    if len(p.code) < seed:
        return none, none
    windows = np.lib.stride_tricks.sliding_window_view(lists.count[p.code], seed)
    start = np.flatnonzero((windows > 0).all(axis=1))
    if not len(start):
        return none, none
    rarity = np.argsort(windows[start], axis=1, kind="stable")
    rarest = start + rarity[:, 0]
    many = lists.count[p.code[rarest]]
    places, positions = [], []
    # Blocks of windows with a bounded number of postings; a longer list is cut as well.
    upto = np.cumsum(many)
    for lo in range(0, int(upto[-1]), PAIRS):
        hi = min(lo + PAIRS, int(upto[-1]))
        pair = np.arange(lo, hi)
        w = np.searchsorted(upto, pair, side="right")
        posting = lists.first[p.code[rarest[w]]] + pair - (upto[w] - many[w])
        at = lists.positions[posting] - rarity[w, 0]
        for k in range(1, seed):
            offset = rarity[w, k]
            ok = lists.hold(p.code[start[w] + offset], at + offset)
            w, at = w[ok], at[ok]
        places.append(start[w])
        positions.append(at)
    return np.concatenate(places), np.concatenate(positions)


def _aligned(same: np.ndarray, length: np.ndarray, min_words: int, one_in: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates hold a part of the passage of min_words or more words with at most one in ``one_in`` altered, and which without any.

    ``same[c, i, d]``: word i of the passage of candidate c equals the document's word on diagonal d of
    the band. A longer part always splits into parts of min_words to 2 * min_words - 1 words, one of
    which keeps the proportion, so only those lengths are tried, from every start.
    """
    n_cand, n_words, band = same.shape
    longest = 2 * min_words - 1
    found, exact = np.zeros(n_cand, dtype=bool), np.zeros(n_cand, dtype=bool)
    starts = n_words - min_words + 1
    if starts <= 0:
        return found, exact
    ramp = np.arange(band, dtype=np.int16)
    padded = np.zeros((n_cand, n_words + longest, band), dtype=bool)
    padded[:, :n_words] = same
    cost = np.zeros((n_cand, starts, band), dtype=np.int16)
    first = np.arange(starts)
    for t in range(1, longest + 1):
        step = cost + ~padded[:, t - 1 : t - 1 + starts]
        skip = np.full_like(cost, 99)
        skip[:, :, :-1] = cost[:, :, 1:] + 1
        cost = np.minimum(step, skip) - ramp
        cost = np.minimum.accumulate(cost, axis=2) + ramp
        if t >= min_words:
            fits = first[None, :] + t <= length[:, None]
            least = cost.min(axis=2)
            found |= (fits & (least <= t // one_in)).any(axis=1)
            if t == min_words:
                exact = (fits & (least == 0)).any(axis=1)
    return found, exact


def _search_shard(p: Passages, row: dict, min_words: int, one_in: int, seed: int) -> tuple[list, list, list]:
    """item_no, doc_id and whether min_words of the item stand there unaltered, once per pair."""
    if not len(row["ends"]) or not p.item_no:
        return [], [], []
    lists = Lists(p, row)
    place, at = _phrases(p, lists, seed)
    if not len(place):
        return [], [], []
    doc = np.searchsorted(lists.ends, at)
    triple = np.unique(np.stack([doc, p.item[place], at - place], axis=1), axis=0)
    start, length = np.asarray(p.start, dtype=np.int64), np.asarray(p.length, dtype=np.int64)
    reach = (2 * min_words - 1) // one_in
    band = np.arange(-reach, reach + 1)
    docs, items, exact = [], [], []
    block = max(1, 500_000 // (int(length.max()) * len(band)))
    for lo in range(0, len(triple), block):
        part = triple[lo : lo + block]
        d, i, shift = part[:, 0], part[:, 1], part[:, 2]
        longest = int(length[i].max())
        step = np.arange(longest)[None, :]
        words_at = start[i][:, None] + step
        want = np.where(step < length[i][:, None], p.code[np.minimum(words_at, len(p.code) - 1)], 0)
        there = words_at[:, :, None] + shift[:, None, None] + band[None, None, :]
        low = np.where(d > 0, lists.ends[np.maximum(d - 1, 0)] + 1, 0)
        same = lists.hold(np.broadcast_to(want[:, :, None], there.shape), there)
        same &= (there >= low[:, None, None]) & (there < lists.ends[d][:, None, None])
        likely = same.any(axis=2).sum(axis=1) >= min_words - min_words // one_in
        ok, whole = np.zeros(len(part), dtype=bool), np.zeros(len(part), dtype=bool)
        if likely.any():
            ok[likely], whole[likely] = _aligned(same[likely], length[i][likely], min_words, one_in)
        docs.append(d[ok])
        items.append(i[ok])
        exact.append(whole[ok])
    pairs: dict[tuple[int, int], bool] = {}
    for i, d, e in zip(np.concatenate(items).tolist(), np.concatenate(docs).tolist(), np.concatenate(exact).tolist()):
        pairs[i, d] = pairs.get((i, d), False) or e
    ids = row["doc_ids"]
    return [p.item_no[i] for i, _ in pairs], [int(ids[d]) for _, d in pairs], list(pairs.values())


def search(index: DataFrame, evaluation: DataFrame, min_words: int = MIN_WORDS, one_in: int = ONE_IN, block_passages: int = BLOCK_PASSAGES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_no, doc_id and match of every document that holds enough of a passage.

    ``index`` comes from :func:`build_index` (written to a table if it is used more than once),
    ``evaluation`` has item_no and text. match is ``phrase`` if ``min_words`` words stand there
    unaltered, else ``proximity``. Passages beyond one block are searched block by block, so neither
    their number nor their length is limited.
    """
    spark = index.sparkSession
    rows = evaluation.select("item_no", "text").filter("item_no IS NOT NULL AND text IS NOT NULL").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_passages), -(-chars // block_chars))
    seed = seed_words(min_words, one_in)

    def searched(passages: Passages) -> DataFrame:
        shared = spark.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {f.name: batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k, f in enumerate(batch.schema)}
                    items, docs, exact = _search_shard(shared.value, row, min_words, one_in, seed)
                    match = ["phrase" if e else "proximity" for e in exact]
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64()), pa.array(match, pa.string())], names=["item_no", "doc_id", "match"])

        return index.mapInArrow(run, "item_no long, doc_id long, match string")

    out = None
    for block in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_no", "text"), F.lit(blocks)) == block)
        # Blocks are equal but for chance; one with a very long passage may exceed its share.
        found = searched(Passages([tuple(r) for r in collect_small(part, 4 * block_passages, "passages of a block")], min_words))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("item_no", "doc_id").agg(F.min("match").alias("match"))


def leaks(documents: DataFrame, evaluation: DataFrame, min_words: int = MIN_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """Every document that holds at least ``min_words`` consecutive words of a passage: item_no, doc_id, match.

    At most one word in ``one_in`` of that part may be altered, missing or added; case, punctuation,
    line breaks and words hyphenated at them don't count. ``documents`` has doc_id and text,
    ``evaluation`` item_no and text; other columns are ignored. Null texts and passages shorter than
    ``min_words`` are no case; a repeated doc_id or item_no gives its pair once. Empty tables give an
    empty result. See :func:`search` for match.
    """
    return search(durable(build_index(documents), "index"), evaluation, min_words, one_in)
