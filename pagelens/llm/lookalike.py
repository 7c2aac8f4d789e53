"""Text that looks the same in one form: vocabulary tries walked by a weighted edit automaton.

A trie holds the vocabulary (the tokens of reference texts) in canonical spelling. The automaton reads a
token character by character. Its arcs without cost follow the plain letters a look-alike or another
form of a letter stands for, and stay where they are on ignorable characters; with w as v, w follows v.
All other replacements, insertions and deletions cost 1. Tokens that reach a word within the budget (0
where texts must look the same) get its canonical spelling; all others are normalised by table. Texts
then compare as plain strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.runtime import collect_small

#: Letters of other scripts and marks that look like the Latin or ASCII ones below them.
LOOK_ALIKES = str.maketrans(
    # Cyrillic
    "асеһіјӏкоԛрѕухԁԝѵүАВСЕНІЈКМОРЅТУХԚԜѴԌӀҮ"
    # Greek
    "αονρικυτχϲϳγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿͿ"
    # Armenian
    "օհոսցզյՍՕԼՏ"
    # Latin
    "ɑɡıȷᴏᴠᴡᴢᴄꜱ"
    # Cherokee
    "ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
    # punctuation
    "‐‑‒−⁃’‘ʼ′“”∕⁄‚",
    "acehijlkoqpsyxdwvyABCEHIJKMOPSTYXQWVGIY"
    "aovpikutxcjyABEZHIKMNOPTYXCCJ"
    "ohnugqjUOLS"
    "agijovwzcs"
    "ABCDEGHiJKLMPRSTVWZ"
    "-----''''\"\"//,",
)

#: Tokens, and characters, of a vocabulary whose tries are broadcast; with larger ones both sides are normalised
#: by table, which gives the same spellings where texts must look the same.
MAX_VOCABULARY = 500_000
MAX_CHARS = 16_000_000
#: Spellings a Python worker remembers.
CACHE_TOKENS = 500_000

#: Characters that need no treatment: printable ASCII and the Swedish and German letters.
_ODD = re.compile(r"[^ -~åäöÅÄÖüÜéß]")
_SPACE = re.compile(r"\s")


@lru_cache(maxsize=70_000)
def units(ch: str) -> str:
    """The plain characters one character stands for, decomposed; '' for an ignorable one."""
    category = unicodedata.category(ch)
    if category == "Cf" or (category == "Cc" and not ch.isspace()) or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ":
        return ""
    if ch.isspace():
        return " "
    flat = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch).translate(LOOK_ALIKES))
    return unicodedata.normalize("NFD", "".join(c.translate(LOOK_ALIKES) for c in flat))


def plain(text: str | None) -> str:
    """A text by table: ignorables gone, look-alikes and compatibility forms replaced, every space a blank, ends stripped, composed."""
    if not text:
        return ""
    if _ODD.search(text) is None:
        return text.strip()
    return unicodedata.normalize("NFC", "".join([units(c) for c in text])).strip()


@lru_cache(maxsize=2)
def arcs(fold_w: bool) -> Callable[[str], str]:
    """The letters that a character's arcs without cost follow, by way of folding."""
    fold = str.maketrans("wW", "vV") if fold_w else {}

    @lru_cache(maxsize=70_000)
    def follow(ch: str) -> str:
        return units(ch).translate(fold)

    return follow


def folded(text: str, fold_w: bool) -> str:
    """Canonical spelling of a token: the composed letters of its arcs without cost. Letters are folded before they are composed."""
    if not fold_w and _ODD.search(text) is None:
        return text
    follow = arcs(fold_w)
    return unicodedata.normalize("NFC", "".join([follow(c) for c in text]))


class Trie:
    """Vocabulary as a trie over plain decomposed characters; each end holds the canonical spelling.

    With ``fold_w`` w counts as v. The spelling of words that look the same is one (:func:`folded`).
    """

    __slots__ = ("follow", "fold_w", "root", "words")

    def __init__(self, words: Iterable[str], fold_w: bool = False) -> None:
        self.fold_w, self.follow, self.words = fold_w, arcs(fold_w), sorted(set(words))
        self.root: dict = {}
        for word in self.words:
            node = self.root
            for u in self.path(word):
                node = node.setdefault(u, {})
            node[""] = folded(word, fold_w)

    def __reduce__(self):
        # Workers get the words and build the trie themselves: nested nodes as deep as a word is long are no thing to send.
        return Trie, (self.words, self.fold_w)

    def path(self, token: str) -> str:
        """The letters on the way of a token without cost; marks of one letter come in canonical order."""
        found = "".join([self.follow(c) for c in token])
        return found if found.isascii() else unicodedata.normalize("NFD", found)

    def walk(self, token: str, budget: int = 0) -> tuple[str, int] | None:
        """(canonical spelling, cost) of the cheapest word within the budget (ties: the first by spelling), or None.

        States of the automaton are trie nodes with the cost so far. States that can pay for no more
        edits follow their one arc; the others branch.
        """
        path = self.path(token)
        states = self._close([(self.root, 0)], budget) if budget else [(self.root, 0)]
        for u in path:
            ahead: list[tuple[dict, int]] = []
            for node, cost in states:
                child = node.get(u)
                if child is not None:
                    ahead.append((child, cost))
                if cost < budget:
                    ahead += [(other, cost + 1) for key, other in node.items() if key and key != u]
                    ahead.append((node, cost + 1))
            if not ahead:
                return None
            states = self._close(ahead, budget) if budget else ahead
        ends = [(cost, node[""]) for node, cost in states if "" in node]
        return (min(ends)[1], min(ends)[0]) if ends else None

    @staticmethod
    def _close(states: list[tuple[dict, int]], budget: int) -> list[tuple[dict, int]]:
        """Cheapest cost per node, with skipped trie characters added."""
        best: dict[int, tuple[dict, int]] = {}
        queue = list(states)
        while queue:
            node, cost = queue.pop()
            known = best.get(id(node))
            if known is not None and known[1] <= cost:
                continue
            best[id(node)] = (node, cost)
            if cost < budget:
                queue += [(child, cost + 1) for key, child in node.items() if key]
        return list(best.values())


def tokens(text: str) -> list[str]:
    """Tokens between single spaces of any kind, after invisible characters and blanks at the ends are gone; a double space gives an empty token."""
    if _ODD.search(text) is None:
        return text.strip(" ").split(" ")
    seen = "".join([c for c in text if units(c)])
    return _SPACE.split(seen.strip())


class Speller:
    """Canonical text against one vocabulary, with a bounded memory of tokens seen before."""

    def __init__(self, trie: Trie | None, budget: int = 0) -> None:
        self.trie, self.budget, self.seen = trie, budget, {}

    def token(self, token: str) -> str | None:
        """Canonical spelling of a token, None if no vocabulary word is within the budget."""
        if token in self.seen:
            return self.seen[token]
        found = self.trie.walk(token, self.budget) if self.trie else None
        if len(self.seen) >= CACHE_TOKENS:
            self.seen.clear()
        self.seen[token] = found[0] if found else None
        return self.seen[token]

    def known(self, parts: list[str]) -> str | None:
        """The canonical text if every token is in the vocabulary."""
        out = []
        for part in parts:
            spelt = self.token(part) if part else ""
            if spelt is None:
                return None
            out.append(spelt)
        return " ".join(out)

    def text(self, text: str) -> str:
        """The canonical text; tokens without a vocabulary word are normalised by table."""
        out = []
        for part in tokens(text):
            spelt = self.token(part) if part else ""
            out.append(self.unknown(part) if spelt is None else spelt)
        return " ".join(out)

    def unknown(self, part: str) -> str:
        """A token by table, with w as v if the vocabulary is folded."""
        return folded(part, self.trie is not None and self.trie.fold_w)


def _vocabulary(words: DataFrame, most: int) -> list[str] | None:
    """The distinct tokens (column word) if they are within the limits, checked before they are fetched."""
    found = words.select("word").filter("word IS NOT NULL").distinct()
    n, chars = found.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    return [r[0] for r in found.collect()] if n <= most and chars <= MAX_CHARS else None


def text_tokens(texts: DataFrame) -> DataFrame:
    """The distinct tokens (column word) of a column text, as :func:`tokens` cuts them. Batches are made distinct before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {t for text in batch.column(0).to_pylist() if text is not None for t in tokens(text) if t}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["word"])

    return texts.select("text").mapInArrow(run, "word string").distinct()


def normalise(rows: DataFrame, vocabulary: DataFrame, key: str = "line_no", text: str = "text", budget: int = 0, fold_w: bool = False) -> DataFrame:
    """``key`` and the canonical form (column norm) of every row's text; null texts stay null. No shuffle.

    ``vocabulary`` has a column word, whose tokens are the canonical spellings; null words are ignored.
    With a budget the vocabulary must be within MAX_VOCABULARY and MAX_CHARS.
    """
    words = _vocabulary(vocabulary, MAX_VOCABULARY)
    if words is None and budget:
        raise ValueError("the vocabulary is too large to be broadcast; without it no edits can be weighed")
    shared = rows.sparkSession.sparkContext.broadcast(Trie(words or (), fold_w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value, budget)
        for batch in batches:
            norm = [None if t is None else speller.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm, pa.string())], names=[key, "norm"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, norm string")


def spellings(texts: DataFrame, vocabulary: DataFrame, budget: int = 1, fold_w: bool = False) -> DataFrame:
    """token, spelling, cost: the vocabulary word nearest to each distinct token of ``texts``, within the budget.

    Look-alikes and ignorable characters cost nothing, any other edit 1. Tokens without a word in reach
    have none; ties go to the first spelling. Distinct tokens are walked once each, spread over the
    cluster; the vocabulary (column word) must be within MAX_VOCABULARY and MAX_CHARS.
    """
    words = _vocabulary(vocabulary, MAX_VOCABULARY)
    if words is None:
        raise ValueError("the vocabulary is too large to be broadcast")
    shared = texts.sparkSession.sparkContext.broadcast(Trie(words, fold_w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [(t, *got) for t in batch.column(0).to_pylist() if (got := trie.walk(t, budget))]
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()))], names=["token", "spelling", "cost"])

    # A walk costs far more than its token's bytes say, so these partitions are not coalesced by size.
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return text_tokens(texts).repartition(parts, "word").mapInArrow(run, "token string, spelling string, cost int")


def canonical(lines: DataFrame, references: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Both tables in one form: line_no or ref_no (the other null), map_w_to_v, norm.

    Lines come out per way of folding, once with w kept and once with w as v; a reference comes out in
    the way its map_w_to_v says (null counts as false). A line looks like a reference if map_w_to_v and
    norm are equal. Words of the references and of ``lexicon`` are the vocabulary of the way they are
    marked with. Null texts have a null norm; repeated rows count once.
    """
    fold = F.coalesce("map_w_to_v", F.lit(False)).alias("fold")
    refs = references.select("ref_no", "text", fold).dropDuplicates(["ref_no", "text", "fold"])
    words = lexicon.select("word", fold).unionByName(refs.select(F.explode(F.split("text", r"\s")).alias("word"), "fold"))
    once = lines.select("line_no", "text").dropDuplicates(["line_no", "text"])
    none = F.lit(None).cast("long")
    parts = []
    for f in (False, True):
        vocabulary = words.filter(F.col("fold") == f)
        parts.append(normalise(once, vocabulary, fold_w=f).select("line_no", none.alias("ref_no"), F.lit(f).alias("map_w_to_v"), "norm"))
        parts.append(normalise(refs.filter(F.col("fold") == f), vocabulary, "ref_no", fold_w=f).select(none.alias("line_no"), "ref_no", F.lit(f).alias("map_w_to_v"), "norm"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _keyed(rows: DataFrame, id_column: str, spellers, folds: tuple[bool, ...]) -> DataFrame:
    """id, text, fold and the comparison key of each row per way of folding; rows with a token outside the vocabulary are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [None if t is None else Speller(t) for t in spellers.value]
        for batch in batches:
            ids, texts, fold, keys = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None:
                    continue
                parts = tokens(t)
                for f, speller in zip(folds, made):
                    got = " ".join([folded(part, f) for part in parts]) if speller is None else speller.known(parts)
                    if got is not None:
                        ids.append(i)
                        texts.append(t)
                        fold.append(f)
                        keys.append(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(fold, pa.bool_()), pa.array(keys, pa.string())], names=["id", "text", "fold", "key"]
            )

    return rows.select(id_column, "text").mapInArrow(run, "id long, text string, fold boolean, key string")


def look_classes(lines: DataFrame, references: DataFrame, max_vocabulary: int = MAX_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(line_no, text, fold, key) of lines that may look like a reference, and (ref_no, ref_text, fold, key) of the references.

    A class is a (fold, key): all its lines look the same as all its references. Lines with a token
    outside the references' vocabulary are in no class. Classes and membership say all pairs without
    listing them.
    """
    spark = lines.sparkSession
    refs = references.select("ref_no", "text", F.coalesce("map_w_to_v", F.lit(False)).alias("fold")).filter("text IS NOT NULL").dropDuplicates(["ref_no", "text", "fold"])
    folds = (False, True)
    words = [_vocabulary(text_tokens(refs.filter(F.col("fold") == f)), max_vocabulary) for f in folds]
    tries = [None if w is None else Trie(w, f) for w, f in zip(words, folds)]
    # Only the ways of folding that any reference asks for are made.
    used = [f for f, w in zip(folds, words) if w is None or w or not refs.filter(F.col("fold") == f).isEmpty()]
    shared = spark.sparkContext.broadcast([tries[folds.index(f)] for f in used])
    left = _keyed(lines, "line_no", shared, tuple(used)).withColumnRenamed("id", "line_no")
    right = None
    for f in used:
        alone = spark.sparkContext.broadcast([tries[folds.index(f)]])
        part = _keyed(refs.filter(F.col("fold") == f), "ref_no", alone, (f,))
        right = part if right is None else right.unionByName(part)
    if right is None:
        right = left.select(F.col("line_no").alias("id"), "text", "fold", "key").limit(0)
    return left, right.select(F.col("id").alias("ref_no"), F.col("text").alias("ref_text"), "fold", "key")


def same_looking(lines: DataFrame, references: DataFrame, max_vocabulary: int = MAX_VOCABULARY) -> DataFrame:
    """Lines whose text looks the same as that of a reference line but is stored differently: line_no, ref_no.

    ``lines`` has line_no and text, ``references`` ref_no, text and map_w_to_v (null counts as false);
    other columns are ignored, repeated rows give their pair once. Blanks at the ends and invisible
    characters don't count, any single space looks like any other, case matters; w looks like v where
    the reference says so, with any accent. Null texts are no case; blank ones look the same as blank
    ones. Empty tables give an empty result. A reference vocabulary over ``max_vocabulary`` tokens is not
    broadcast: both sides are then normalised by table, with the same spellings, and joined.
    """
    left, right = look_classes(lines, references, max_vocabulary)
    return left.join(right, ["fold", "key"]).filter("text <> ref_text").select("line_no", "ref_no").distinct()
