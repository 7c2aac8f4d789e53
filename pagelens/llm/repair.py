"""Noise in text from scanned pages: furniture removal, word repair and continuous paragraphs.

Pages are put together once, in blocks of :data:`BLOCK` record numbers of a volume, so no task holds
more of a volume than a block. A first pass reads each page and gathers what the volume and the
corpus know: likely titles and page numbers at page edges, and words outside the lexicon. From these
come each volume's title and page numbering, and the trained character editor. A second pass decides
per line – furniture by page position, likeness to the title, and fit into the numbering – and lets
the editor put words right and join words over line breaks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.editor import MARKS, MAX_TRAINING_WORDS, Editor, Neighbours, join_features, train
from pagelens.llm.lookalike import plain, units
from pagelens.runtime import collect_small, discard, durable

#: Record numbers (pages) of one block of a volume.
BLOCK = 512
#: Lines at each edge of a page that are looked at for the volume's title and numbering. Furniture itself may take more.
EDGE_LINES = 2
#: Likeness (1 - edit distance / length, letters and digits only) from which an edge line is the volume's title.
TITLE_LIKENESS = 0.6
#: Likeness of two readings of a title that no page shows twice alike.
READING_LIKENESS = 0.85
#: Share of a volume's pages that must show a text at an edge for it to be the title.
TITLE_SHARE = 0.1
#: A further title of a volume (another heading on facing pages) stands at least so often, and by share as often as the first.
MORE_TITLES, MORE_SHARE = 3, 0.4
#: Words of a lexicon and their letters; every worker indexes them.
MAX_LEXICON = 200_000
MAX_LETTERS = 4_000_000

#: Words before a page number, in the languages of the volumes.
NUMBER_WORDS = ("sid", "sida", "sidan", "s", "p", "pag", "pagina", "page", "fol", "folio", "f", "bl", "blad", "nr", "no", "n", "seite")
#: Characters that digits are misread as.
DIGITS = str.maketrans("lIi|OoQSsBZzbgqAT", "11110005582269947")

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LETTERS = re.compile(r"[\W_]+")
_GAP = re.compile(r"^\s*(\S{1,7})\s{2,}(?=\S)|\s{2,}(\S{1,7})\s*$")
_NUMBER = re.compile(rf"^(?:({'|'.join(NUMBER_WORDS)})[\s.:]*)?(?:([0-9lIi|OoQSsBZzbgqAT]{{1,5}})\s?([rv])?|([ivxlcdm1|]{{1,9}}))$", re.IGNORECASE)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int | None:
    """Value of a roman numeral in its regular spelling (1 and | read as I), else None."""
    text = text.lower().replace("1", "i").replace("|", "i")
    if not re.fullmatch(r"m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", text) or not text:
        return None
    total = 0
    for a, b in zip(text, text[1:] + "i"):
        total += -_ROMAN[a] if _ROMAN[a] < _ROMAN[b] else _ROMAN[a]
    return total


def page_number(text: str) -> tuple[str, int] | None:
    """(form, value) of a line that holds only a page number, else None.

    Forms: ``a`` arabic, ``f`` folio (value 2n for the front, 2n + 1 for the back), ``r`` roman.
    """
    core = _EDGE.sub("", text)
    got = _NUMBER.match(core)
    if not got:
        return None
    value = roman(got[4] or f"{got[2]}{got[3] or ''}")
    digits = (got[2] or "").translate(DIGITS)
    if got[3] and not any(c.isdigit() for c in got[2]):
        digits = ""
    if digits.isdigit() and (any(c.isdigit() for c in got[2]) or value is None and (got[1] or len(core) <= 3)):
        return ("f", 2 * int(digits) + (got[3] in "vV")) if got[3] else ("a", int(digits))
    return None if value is None else ("r", value)


def squeeze(text: str) -> str:
    """Letters and digits in lower case."""
    return _LETTERS.sub("", text).lower()


def title_forms(text: str) -> list[str]:
    """What an edge line may say as a title: the line, and the line without a page number set off by a gap."""
    forms = [squeeze(text)]
    bare = _GAP.sub("", text)
    if bare != text:
        forms.insert(0, squeeze(bare))
    return [f for f in forms if f]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def is_title(text: str, titles: list[str]) -> bool:
    """Whether an edge line repeats one of the titles, however badly read, with nothing but a page number beside it."""
    for title in titles:
        for form in title_forms(text):
            longest = max(len(form), len(title))
            if abs(len(form) - len(title)) <= (1 - TITLE_LIKENESS) * longest and len(form) <= 1.15 * len(title) + 2 and distance(form, title) <= (1 - TITLE_LIKENESS) * longest:
                return True
    return False


def split_tokens(text: str) -> list[str]:
    return text.split()


def core(token: str) -> str:
    """A token without punctuation at its ends, in lower case."""
    return _EDGE.sub("", token).lower()


def broken(raw: str) -> bool:
    """Whether the raw line ends with a hyphenation mark (invisible characters and blanks after it don't count)."""
    for c in reversed(raw):
        if c in MARKS:
            return True
        if not c.isspace() and units(c):
            return False
    return False


class Words:
    """Judges words against the lexicon and the editor, remembering what it has seen."""

    def __init__(self, neighbours: Neighbours, editor: Editor | None = None) -> None:
        self.neighbours, self.editor, self.lexicon, self.seen = neighbours, editor, neighbours.words, {}

    def known(self, word: str) -> bool:
        return word in self.lexicon

    def strange(self, word: str) -> bool:
        """Whether a word could be misread: outside the lexicon but not much longer than its words, no number, no hyphenated name, no old spelling with w for v."""
        return 1 < len(word) <= self.neighbours.longest + 2 and word not in self.lexicon and word.isalnum() and not word.isdigit() and ("w" not in word or word.replace("w", "v") not in self.lexicon)

    def candidate(self, token: str) -> str | None:
        """The word of a lower-case token if it could be misread."""
        if token in self.seen:
            return self.seen[token]
        w = core(token)
        return self._keep(token, w if w and self.strange(w) and w == _EDGE.sub("", token) else None)

    def repaired(self, token: str) -> tuple[str, str] | None:
        """(kind, word): what the editor makes of a token's word, None if it keeps it.

        ``misread`` is one misread character or pair of characters, ``respelt`` a lost or extra character
        or two misreadings, which are tried where no single one helps.
        """
        if token in self.seen:
            return self.seen[token]
        w, got = core(token), None
        if self.strange(w):
            edits = self.neighbours.edits(w)
            right = self.editor.repair(w, edits) if edits else None
            got = ("misread", right) if right else None
            if not edits:
                gaps = self.neighbours.gaps(w)
                right = (self.editor.repair(w, gaps) if gaps else None) or self.editor.pairs(w, self.lexicon)
                got = ("respelt", right) if right else None
        return self._keep(token, got)

    def _keep(self, token: str, found):
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[token] = found
        return found

    def join(self, left: str, mark: bool, right: str) -> list[str]:
        """Features of the break between two tokens."""
        a, b = core(left), core(right)
        stop = not mark and bool(left) and not left[-1].isalnum()
        return join_features(a, mark, stop, b, right[:1].isupper(), a + b in self.lexicon and bool(a) and bool(b), a in self.lexicon, b in self.lexicon)

    def joined(self, left: str, mark: bool, right: str) -> tuple[str, str] | None:
        """(kind, word) of the word that two tokens make over a line's end, as it is written, None if they are two words.

        ``split_word`` is a word of the lexicon, ``joined`` a marked break of any other word; before a
        capital its mark was a hyphen and stays.
        """
        a, b = core(left), core(right)
        if not a or not b:
            return None
        bare = left.rstrip(MARKS + "".join(c for c in left if not units(c))) if mark else left
        if a + b in self.lexicon and self.editor.score(self.join(left, mark, right)) > 0:
            return "split_word", bare + right
        if mark and a.isalpha() and b.isalpha():
            return "joined", f"{bare}-{right}" if right[:1].isupper() else bare + right
        return None


def pages(lines: DataFrame) -> DataFrame:
    """One row per page: volume_no, block, rec_no, place (its rank in the block) and its lines in order.

    Re-delivered rows count once. A page without a volume is a volume of its own (its rec_no, negative).
    """
    volume = F.coalesce("volume_no", -F.col("rec_no") - 1)
    keyed = lines.filter("rec_no IS NOT NULL").select(
        volume.alias("volume_no"), F.floor(F.col("rec_no") / BLOCK).alias("block"), "rec_no", F.struct("line_pos", "line_no", "text").alias("line")
    )
    put = keyed.repartition("volume_no", "block").groupBy("volume_no", "block", "rec_no").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    order = Window.partitionBy("volume_no", "block").orderBy("rec_no")
    return put.withColumn("place", F.row_number().over(order))


def block_starts(page_rows: DataFrame) -> DataFrame:
    """Per volume and block its number of pages (n) and that before it (start)."""
    counts = page_rows.groupBy("volume_no", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("volume_no").orderBy("block")
    return counts.select("volume_no", "block", "n", (F.sum("n").over(order) - F.col("n")).alias("start"))


def _edges(texts: list[str]) -> list[int]:
    """Positions of the outermost non-blank lines, the outermost first, head before foot."""
    filled = [i for i, t in enumerate(texts) if t]
    head, foot = filled[:EDGE_LINES], filled[::-1][:EDGE_LINES]
    return list(dict.fromkeys(i for pair in zip(head, foot) for i in pair))


def _pages_of(column: pa.ListArray) -> Iterator[tuple[list[int], list[str], list[str]]]:
    """Per page of a column of line arrays the line numbers, the texts as stored, and the texts by table."""
    offsets = column.offsets.to_pylist()
    ids = column.values.field("line_no").to_pylist()
    raw = [t or "" for t in column.values.field("text").to_pylist()]
    texts = [plain(t) for t in raw]
    for a, b in zip(offsets, offsets[1:]):
        yield ids[a:b], raw[a:b], texts[a:b]


_GATHER = "kind string, volume_no long, block long, place int, word string, form string, value long, n long"
_GATHER_NAMES = ["kind", "volume_no", "block", "place", "word", "form", "value", "n"]


def _gather(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        judge = Words(lexicon)
        for batch in batches:
            out: list[tuple] = []
            strange: Counter[str] = Counter()
            breaks: Counter[str] = Counter()
            for volume, block, place, (_, raw, texts) in zip(*(batch.column(i).to_pylist() for i in range(3)), _pages_of(batch.column(3))):
                for i in _edges(texts):
                    got = page_number(texts[i])
                    if got:
                        out.append(("number", volume, block, place, None, *got, 1))
                    else:
                        # A line that ends a sentence is running text, unless specks surround it.
                        form = [] if texts[i][-1] in ".!?;," and texts[i][0].isalnum() else title_forms(texts[i])
                        if form and sum(c.isalpha() for c in form[0]) >= 5:
                            out.append(("title", volume, None, None, form[0], None, None, 1))
                previous = None
                for i, text in enumerate(texts):
                    found = split_tokens(text)
                    if not found:
                        continue
                    # Words inside a line only: those at its ends may be parts of broken words. Names are upper case.
                    for t in found[1:-1]:
                        if not t[:1].isupper() and (w := judge.candidate(t)):
                            strange[w] += 1
                    if previous is not None and (previous[1] or previous[0][-1:].isalnum()):
                        a, b = core(previous[0]), core(found[0])
                        # Parts that make a known word, marked or no words themselves, are a sure join; known words that make none are not.
                        joined, apart = a + b in judge.lexicon, a in judge.lexicon and b in judge.lexicon
                        sure = joined and (previous[1] or not apart)
                        if sure or (not joined and apart):
                            breaks["\t".join([*judge.join(previous[0], previous[1], found[0]), "yes" if sure else "no"])] += 1
                    previous = (found[-1], broken(raw[i]))
            out += [("word", None, None, None, w, None, None, n) for w, n in strange.items()]
            out += [("break", None, None, None, b, None, None, n) for b, n in breaks.items()]
            columns = list(zip(*out)) if out else [[] for _ in _GATHER_NAMES]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_GATHER_NAMES)

    return run


def volume_facts(gathered: DataFrame, starts: DataFrame) -> DataFrame:
    """Per volume its titles and the offset of page numbers per form.

    The title is the edge text that stands most often, on two pages and a tenth of all at least; other
    texts that stand nearly as often are titles too (left and right pages may differ).

    A page number is the page's rank in the volume plus an offset; the offset that most edge lines
    agree on is the volume's (offsets: map form -> (offset, number of lines)).
    """
    counted = gathered.filter("kind = 'title'").groupBy("volume_no", "word").agg(F.sum("n").alias("n"))
    sizes = starts.groupBy("volume_no").agg(F.sum("n").alias("pages"))
    first = counted.groupBy("volume_no").agg(F.max("n").alias("most"), F.max_by("word", F.struct("n", "word")).alias("title")).join(sizes, "volume_no")
    # At most a handful of texts a volume: each stands on a twenty-fifth of its pages' edges or more.
    further = (
        counted.join(first, "volume_no").filter((F.col("word") != F.col("title")) & (F.col("n") >= MORE_TITLES) & (F.col("n") >= MORE_SHARE * F.col("most")) & (F.col("n") >= TITLE_SHARE * F.col("pages")))
        .groupBy("volume_no").agg(F.array_sort(F.collect_set("word")).alias("further"))
    )
    titles = first.join(further, "volume_no", "left").withColumn("all_titles", F.concat(F.array("title"), F.coalesce("further", F.array().cast("array<string>"))))
    numbers = (
        gathered.filter("kind = 'number'").drop("n").join(starts.drop("n"), ["volume_no", "block"])
        .groupBy("volume_no", "form", (F.col("value") - F.col("place") - F.col("start")).alias("offset")).agg(F.count("*").alias("n"))
        .groupBy("volume_no", "form").agg(F.max_by(F.struct("offset", "n"), F.struct("n", -F.abs("offset"), "offset")).alias("best"))
        .groupBy("volume_no").agg(F.map_from_entries(F.collect_list(F.struct("form", "best"))).alias("offsets"))
    )
    # A short volume whose edge texts all differ: they are compared by likeness instead. In a volume of
    # more than 1 / TITLE_SHARE pages, no text that stands once can be the title.
    short = titles.filter((F.col("most") == 1) & (F.col("pages") * TITLE_SHARE <= 1)).select("volume_no")
    singles = counted.join(short, "volume_no", "left_semi")
    few = singles.groupBy("volume_no").agg(F.array_sort(F.collect_set("word")).alias("words"))
    few = few.filter(F.size("words") > 1).withColumn(
        "likely",
        F.filter(
            "words",
            lambda w: F.exists(F.col("words"), lambda x: (x != w) & (F.levenshtein(x, w) <= F.lit(1 - READING_LIKENESS) * F.greatest(F.length(x), F.length(w)))),
        ),
    )
    return (
        titles.join(few.select("volume_no", "likely"), "volume_no", "left")
        .select("volume_no", F.when((F.col("most") > 1) & (F.col("most") >= TITLE_SHARE * F.col("pages")), F.col("all_titles")).otherwise(F.coalesce("likely", F.array().cast("array<string>"))).alias("titles"))
        .join(numbers, "volume_no", "full")
    )


_OUT = "volume_no long, block long, rec_no long, line_no long, pos int, kind string, text string, mark boolean, stops boolean"
_OUT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
_OUT_NAMES = [x.split(" ")[0] for x in _OUT.split(", ")]


def furniture(texts: list[str], titles: list[str], offsets: dict[str, tuple[int, int]], rank: int) -> dict[int, str]:
    """Kind of each furniture line of a page: lines are taken from the outside in, until running text begins."""
    found: dict[int, str] = {}
    filled = [i for i, t in enumerate(texts) if t]
    for side in (filled, filled[::-1]):
        for i in side:
            if i in found:
                break
            number = page_number(texts[i])
            if is_title(texts[i], titles):
                found[i] = "running_header"
            elif number and fits(number, texts[i], offsets, rank):
                found[i] = "page_number"
            else:
                break
    return found


def fits(number: tuple[str, int], text: str, offsets: dict[str, tuple[int, int]], rank: int) -> bool:
    """Whether a lone number is the page's: it has the value the volume's numbering expects, but for one misread digit."""
    form, value = number
    if form == "f":
        return True
    forms = [f for f in ("a", "r") if f in offsets and offsets[f][1] > 1]
    if not forms:
        # No numbering to hold it against: any short number that is no year in a sentence.
        return form == "r" or value < 1000
    for f in forms:
        expected = rank + offsets[f][0]
        if form == f == "a" and distance(str(value), str(expected)) <= 1:
            return True
        if form == f == "r" and value == expected:
            return True
    return form == "r" and "r" in forms and abs(value - rank - offsets["r"][0]) <= 2


def _repair(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neighbours, editor = shared.value
        judge = Words(neighbours, editor)
        for batch in batches:
            out: list[tuple] = []
            for volume, block, rec, place, start, titles, offsets, (ids, raw, texts) in zip(
                *(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6, 7)), _pages_of(batch.column(5))
            ):
                best = {f: (b["offset"], b["n"]) for f, b in (offsets or [])}
                kinds = furniture(texts, titles or [], best, place + (start or 0))
                for i, kind in kinds.items():
                    out.append((volume, block, rec, ids[i], i, kind, raw[i], None, None))
                running = [i for i, t in enumerate(texts) if t and i not in kinds]
                parts = {i: split_tokens(texts[i]) for i in running}
                head = [False] * len(texts)
                tail = [False] * len(texts)
                marks = {i: broken(raw[i]) for i in running}
                for i, j in zip(running, running[1:]):
                    made = judge.joined(parts[i][-1], marks[i], parts[j][0])
                    if marks[i] or made:
                        tail[i] = head[j] = True
                    if made:
                        out.append((volume, block, rec, ids[i], i, *made, marks[i], None))
                for k, i in enumerate(running):
                    found = parts[i]
                    words = []
                    for n, t in enumerate(found):
                        first, last = n == 0, n == len(found) - 1
                        if (first and head[i]) or (last and (tail[i] or marks[i])):
                            words.append(t)
                            continue
                        got = judge.repaired(t)
                        if got:
                            kind, right = got
                            w = core(t)
                            # The first and last word of a page may turn out to be parts of a word broken at
                            # the page's end, so the text keeps them as read.
                            edge = ("_first" if first and k == 0 else "") or ("_last" if last and k == len(running) - 1 else "")
                            out.append((volume, block, rec, ids[i], i, kind + edge, f"{w}>{right}", None, None))
                            if edge:
                                words.append(t)
                                continue
                            at = t.lower().find(w)
                            fixed = right.capitalize() if t[at : at + 1].isupper() and not t.isupper() else right.upper() if t.isupper() and len(w) > 1 else right
                            t = t[:at] + fixed + t[at + len(w) :]
                        words.append(t)
                    out.append((volume, block, rec, ids[i], i, "text", " ".join(words), marks[i], texts[i][-1:] in ".!?"))
            columns = list(zip(*out)) if out else [[] for _ in _OUT_NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _OUT_KINDS)], names=_OUT_NAMES)

    return run


def repair(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What was found in and done to each line: volume_no, block, rec_no, line_no, pos, kind, text, mark, stops.

    ``lines`` has line_no, rec_no, volume_no, line_pos and text, ``lexicon`` a column word; other columns
    are ignored, repeated lines count once. Kinds: ``running_header`` and ``page_number`` (furniture,
    text as stored), ``split_word`` (the lexicon word joined over the line's end, as written), ``joined``
    (the same for a marked break of any other word), ``misread`` (``read>right``), ``respelt`` (the same
    for lost and extra characters and for two misreadings in a word), and ``text`` (a line of running text after repair; mark: its last word is marked as broken; stops:
    it ends a sentence). A line can have several kinds; null and blank lines have none. Nulls in
    rec_no leave the line out. With an empty lexicon nothing is split or misread. Line text of any
    length is read whole.
    """
    spark = lines.sparkSession
    words = collect_small(lexicon.select(F.lower("word").alias("w")).filter("w IS NOT NULL AND trim(w) <> ''").distinct(), MAX_LEXICON, "lexicon")
    if sum(len(r[0]) for r in words) > MAX_LETTERS:
        raise ValueError(f"lexicon: more than {MAX_LETTERS} letters; every worker indexes them")
    neighbours = Neighbours(plain(r[0]).lower() for r in words)
    page_rows = durable(pages(lines), "pages")
    starts = durable(block_starts(page_rows), "starts")
    shared_words = spark.sparkContext.broadcast(neighbours)
    gathered = durable(page_rows.select("volume_no", "block", "place", "lines").mapInArrow(_gather(shared_words), _GATHER), "gathered")
    strange = gathered.filter("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("word")).limit(MAX_TRAINING_WORDS)
    # The features of a break are a few flags, so there are few distinct ones.
    breaks = collect_small(gathered.filter("kind = 'break'").groupBy("word").agg(F.sum("n")), 100_000, "kinds of line breaks")
    editor = train([tuple(r) for r in strange.collect()], sorted((r[0].split("\t")[:-1], r[0].endswith("yes"), r[1]) for r in breaks), neighbours)
    facts = durable(volume_facts(gathered, starts), "volumes")
    shared = spark.sparkContext.broadcast((neighbours, editor))
    full = page_rows.join(starts.drop("n"), ["volume_no", "block"], "left").join(facts, "volume_no", "left")
    done = durable(full.select("volume_no", "block", "rec_no", "place", "start", "lines", "titles", "offsets").mapInArrow(_repair(shared), _OUT), "repaired")
    for used in (page_rows, starts, gathered, facts):
        discard(used)
    return _over_pages(done, neighbours, editor)


def _over_pages(done: DataFrame, neighbours: Neighbours, editor: Editor) -> DataFrame:
    """Words broken between the last line of running text of a page and the first of the volume's next page with any."""
    spark = done.sparkSession
    running = done.filter("kind = 'text'")
    ends = running.groupBy("volume_no", "block", "rec_no").agg(
        F.min_by(F.struct("line_no", "text"), "pos").alias("first"), F.max_by(F.struct("line_no", "text", "mark"), "pos").alias("last")
    )
    order = Window.partitionBy("volume_no", "block").orderBy("rec_no")
    by_block = Window.partitionBy("volume_no").orderBy("block")
    next_block = ends.groupBy("volume_no", "block").agg(F.min_by(F.struct("rec_no", "first"), "rec_no").alias("head")).select(
        "volume_no", "block", F.lead("head").over(by_block).alias("head")
    )
    pairs = (
        ends.withColumn("next", F.lead(F.struct("rec_no", "first")).over(order))
        .join(next_block, ["volume_no", "block"])
        .select("volume_no", "block", "rec_no", "last", F.coalesce("next", "head").alias("next"))
        .filter("next IS NOT NULL")
        .select(
            "volume_no", "block", "rec_no", F.col("last.line_no").alias("line_no"), F.element_at(F.split("last.text", " "), -1).alias("a"), F.col("last.mark").alias("mark"),
            F.col("next.first.line_no").alias("next_line_no"), F.element_at(F.split("next.first.text", " "), 1).alias("b"),
        )
    )
    shared = spark.sparkContext.broadcast((neighbours, editor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chars = shared.value
        judge = Words(words, chars)
        for batch in batches:
            made = [judge.joined(a or "", bool(mark), b or "") or (None, None) for a, mark, b in zip(*(batch.column(i).to_pylist() for i in (4, 5, 7)))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 2, 3, 5, 6)), pa.array([k for k, _ in made], pa.string()), pa.array([w for _, w in made], pa.string())],
                names=["volume_no", "block", "rec_no", "line_no", "mark", "next_line_no", "kind", "joined"],
            )

    crossed = durable(pairs.mapInArrow(run, "volume_no long, block long, rec_no long, line_no long, mark boolean, next_line_no long, kind string, joined string"), "crossed")
    split = crossed.filter("joined IS NOT NULL")
    last_pos = running.select("line_no", "pos")
    added = split.join(last_pos, "line_no").select(
        "volume_no", "block", "rec_no", "line_no", "pos", "kind", F.col("joined").alias("text"), "mark", F.lit(None).cast("boolean").alias("stops")
    )
    # The first word of a page is a part if the page before broke a word; so is the last word of a page broken without a mark.
    edge = lambda side: F.explode(F.array(*(F.lit(f"{k}_{side}") for k in ("misread", "respelt")))).alias("kind")
    parts = crossed.filter("mark OR joined IS NOT NULL").select(F.col("next_line_no").alias("line_no"), edge("first")).unionByName(split.select("line_no", edge("last")))
    kept = done.join(parts, ["line_no", "kind"], "left_anti").withColumn("kind", F.regexp_replace("kind", "_first$|_last$", "")).select(*_OUT_NAMES)
    return kept.unionByName(added.select(*_OUT_NAMES))


def paragraphs(repaired: DataFrame) -> DataFrame:
    """Continuous paragraphs of each volume: volume_no, rec_no and paragraph_no (on the page where it begins or goes on), continues, text.

    Lines of running text follow each other; a word broken at a line's end is put together there and
    gone from the next line, also over pages. A paragraph ends with a line that ends a sentence and is
    shorter than four fifths of the page's longest line, or with the page; ``continues`` says that the
    page's last line ends no sentence, so its text goes on with the next page's first paragraph. Pages
    hold a bounded number of lines, so a volume is never gathered in one place.
    """
    joins = repaired.filter("kind IN ('split_word', 'joined')").select("volume_no", "block", "rec_no", "line_no", F.col("text").alias("joined"))
    lines = repaired.filter("kind = 'text'").select("volume_no", "block", "rec_no", "line_no", "pos", "text", "stops").join(joins, ["volume_no", "block", "rec_no", "line_no"], "left")
    # Whether the line before, on the page or on the page before, took this line's first word.
    order = Window.partitionBy("volume_no", "block").orderBy("rec_no", "pos")
    by_block = Window.partitionBy("volume_no").orderBy("block")
    block_end = lines.groupBy("volume_no", "block").agg(F.max_by(F.col("joined").isNotNull(), F.struct("rec_no", "pos")).alias("open")).select(
        "volume_no", "block", F.lag("open").over(by_block).alias("open_before")
    )
    page = Window.partitionBy("volume_no", "block", "rec_no")
    flow = page.orderBy("pos")
    whole = (
        lines.withColumn("before", F.lag(F.col("joined").isNotNull()).over(order))
        .join(block_end, ["volume_no", "block"])
        .withColumn("before", F.coalesce("before", "open_before", F.lit(False)))
        .withColumn("text", F.when(F.col("before"), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text")))
        .withColumn("text", F.when(F.col("joined").isNotNull(), F.concat(F.regexp_replace("text", r"\S+$", ""), "joined")).otherwise(F.col("text")))
        .withColumn("closes", F.col("stops") & (F.length("text") < 0.8 * F.max(F.length("text")).over(page)))
        .withColumn("paragraph_no", F.coalesce(F.sum(F.col("closes").cast("int")).over(flow.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("ends_page", F.lead("pos").over(flow).isNull())
    )
    return whole.groupBy("volume_no", "rec_no", "paragraph_no").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), lambda t: t != ""), " ").alias("text"),
        F.max(F.col("ends_page") & ~F.col("stops")).alias("continues"),
    )
