"""An averaged-perceptron character editor: keep, replace, delete, insert and line-join.

The editor reads one word (or the break between two lines) and scores edits of it. An edit is a
sequence of operations on neighbouring characters – ``R`` replace, ``D`` delete, ``I`` insert, ``J``
join over a line break – and everything else is kept; "keep all" scores 0. Edits are misreadings of one
character or two (:meth:`Neighbours.edits`), lost and extra characters (:meth:`Neighbours.gaps`), and two
misreadings in one word (:meth:`Editor.pairs`). Weights are trained with the structured perceptron update
and averaged over all updates.

No one labels the scans, so labels come from the corpus itself: a word outside the lexicon that one
edit turns into a lexicon word supports that edit, an edit with many supporters is a systematic
misreading, and coincidences (names, noise) have few. Edits with too little support are labelled "keep".
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

#: Marks of a word broken at the end of a line.
MARKS = "-‐‑=¬­"
#: Words the editor is trained on at most, taken by the order of a hash; the only bounded sample here.
MAX_TRAINING_WORDS = 20_000
EPOCHS = 5
#: An edit counts as systematic if at least this share of the words that edits can explain supports it, and at least so many.
MIN_SUPPORT_SHARE = 0.003
MIN_SUPPORT = 3
#: Letters of the shortest word in which a lost or extra character, or two misreadings, are looked for.
GAP_LETTERS = 4


class Neighbours:
    """Lexicon words that one misread character or pair of characters away from a word."""

    def __init__(self, lexicon: Iterable[str]) -> None:
        self.words = frozenset(lexicon)
        #: Letters of the longest word; no edit makes a lexicon word of one that is more than two longer.
        self.longest = max(map(len, self.words), default=0)
        #: (before, after) of a removed character, and of a removed pair, with what was removed.
        self.one: dict[tuple[str, str], list[str]] = defaultdict(list)
        self.two: dict[tuple[str, str], list[str]] = defaultdict(list)
        for w in self.words:
            for i in range(len(w)):
                self.one[w[:i], w[i + 1 :]].append(w[i])
                if i + 2 <= len(w):
                    self.two[w[:i], w[i + 2 :]].append(w[i : i + 2])

    def edits(self, word: str) -> list[tuple[int, str, str]]:
        """(position, read, right): ``read`` is one character or two, ``right`` what puts it right."""
        if len(word) > self.longest + 1:
            return []
        out = []
        for i in range(len(word)):
            before, after = word[:i], word[i + 1 :]
            out += [(i, word[i], c) for c in self.one.get((before, after), ()) if c != word[i]]
            out += [(i, word[i], cc) for cc in self.two.get((before, after), ()) if cc[0] != word[i] and cc[1] != word[i]]
            if i + 2 <= len(word):
                pair, rest = word[i : i + 2], word[i + 2 :]
                out += [(i, pair, c) for c in self.one.get((before, rest), ()) if c not in pair]
        return out


    def gaps(self, word: str) -> list[tuple[int, str, str]]:
        """(position, read, right) of a character that was lost (``read`` is empty) or is one too many (``right`` is empty)."""
        if not GAP_LETTERS <= len(word) <= self.longest + 1:
            return []
        out = [(i, "", c) for i in range(len(word) + 1) for c in self.one.get((word[:i], word[i:]), ())]
        out += [(i, word[i], "") for i in range(len(word)) if word[:i] + word[i + 1 :] in self.words]
        # Of the places in a run of one character only the first counts.
        return [e for e in out if not (e[0] and word[e[0] - 1] == (e[1] or e[2]))]


def operations(read: str, right: str) -> tuple[str, ...]:
    """The edit as operations on the characters read."""
    if not read:
        return tuple("I" + c for c in right)
    if not right:
        return ("D",) * len(read)
    if len(read) > len(right):
        return ("R" + right, "D") if len(read) == 2 else ("D",)
    return ("R" + right[0], *("I" + c for c in right[1:]))


def edit_features(word: str, at: int, read: str, right: str) -> list[str]:
    ops = f"{read}>{'+'.join(operations(read, right))}"
    left = word[at - 1] if at else "^"
    after = word[at + len(read)] if at + len(read) < len(word) else "$"
    kind = "d" if any(c.isdigit() for c in read) else "l"
    # Misreadings and gaps share no weight, so neither kind of edit speaks for the other.
    what = "edit" if read and right else "gap"
    return [ops, f"{ops}|{left}_", f"{ops}|_{after}", f"shape|{len(read)}{len(right)}{kind}", f"{what}|len|{min(len(word), 8)}", what]


def join_features(left: str, mark: bool, stop: bool, right: str, right_upper: bool, joined_known: bool, left_known: bool, right_known: bool) -> list[str]:
    return [
        f"J|{mark:d}{joined_known:d}", f"J|stop{stop:d}{mark:d}", f"J|upper{right_upper:d}{joined_known:d}", f"J|{left_known:d}{right_known:d}{joined_known:d}",
        f"J|digit{any(c.isdigit() for c in left + right):d}", "J",
    ]


#: What is known of breaks without any example: parts of a known word belong together, others don't.
PRIOR_BREAKS = [
    (join_features("a", mark, False, "b", False, known, False, False), known, 1) for mark in (True, False) for known in (True, False)
]


class Editor:
    """Weights of the trained editor, the misreadings it found to be systematic, and the edits they choose."""

    def __init__(self, weights: dict[str, float], systematic: Iterable[tuple[str, str]] = ()) -> None:
        self.weights = weights
        self.systematic = sorted(set(systematic))

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def repair(self, word: str, edits: list[tuple[int, str, str]]) -> str | None:
        """The word after the best edit that beats keeping it, else None; ``edits`` are those that give a lexicon word."""
        best, chosen = 0.0, None
        for at, read, right in sorted(set(edits)):
            s = self.score(edit_features(word, at, read, right))
            if s > best:
                best, chosen = s, word[:at] + right + word[at + len(read) :]
        return chosen

    def pairs(self, word: str, known: frozenset[str]) -> str | None:
        """The word after the best two systematic misreadings that give a known word, each of which beats keeping what it edits."""
        if len(word) < GAP_LETTERS:
            return None
        found = []
        for read, right in self.systematic:
            at = word.find(read)
            while at >= 0:
                found.append((at, read, right))
                at = word.find(read, at + 1)
        found.sort()
        best, chosen = 0.0, None
        for n, (i, read, right) in enumerate(found):
            for j, read2, right2 in found[n + 1 :]:
                if j < i + len(read):
                    continue
                made = word[:i] + right + word[i + len(read) : j] + right2 + word[j + len(read2) :]
                if made in known:
                    each = self.score(edit_features(word, i, read, right)), self.score(edit_features(word, j, read2, right2))
                    if min(each) > 0 and sum(each) > best:
                        best, chosen = sum(each), made
        return chosen


def _gold(examples: list[tuple[str, list[tuple[int, str, str]]]]) -> tuple[dict[str, tuple[int, str, str] | None], list[tuple[str, str]]]:
    """The edit that the corpus supports for each word, None for keep; and the edits with enough support."""
    support: Counter[tuple[str, str]] = Counter()
    for _, edits in examples:
        for e in {(r, c) for _, r, c in edits}:
            support[e] += 1.0 / len(edits)
    chosen = {}
    for _ in range(3):
        votes: Counter[tuple[str, str]] = Counter()
        for word, edits in examples:
            chosen[word] = max(edits, key=lambda e: (support[e[1], e[2]], e))
            votes[chosen[word][1:]] += 1
        support = votes
    enough = max(MIN_SUPPORT, MIN_SUPPORT_SHARE * len(examples))
    return {w: e if support[e[1:]] >= enough else None for w, e in chosen.items()}, [e for e, n in support.items() if n >= enough]


def train(words: list[tuple[str, int]], breaks: list[tuple[list[str], bool, int]], neighbours: Neighbours) -> Editor:
    """Train on words outside the lexicon, with how often they stand, and on line breaks (features, joined or not, count).

    Lost and extra characters are learned from words that no misreading explains. Deterministic: the
    order of the examples is that of the words.
    """
    misread, gaps = [], []
    for word, _ in sorted(set(words))[:MAX_TRAINING_WORDS]:
        edits = sorted(set(neighbours.edits(word)))
        if edits:
            misread.append((word, edits))
        elif found := sorted(set(neighbours.gaps(word))):
            gaps.append((word, found))
    chosen, systematic = _gold(misread)
    chosen |= _gold(gaps)[0]
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1

    def update(features: list[str], by: float) -> None:
        for f in features:
            weights[f] += by
            total[f] += by * step

    for _ in range(EPOCHS):
        for word, edits in [*misread, *gaps]:
            gold = chosen[word]
            guess, best = None, 0.0
            for e in edits:
                s = sum(weights[f] for f in edit_features(word, *e))
                if s > best:
                    guess, best = e, s
            if guess != gold:
                if gold:
                    update(edit_features(word, *gold), 1.0)
                if guess:
                    update(edit_features(word, *guess), -1.0)
            step += 1
        for features, joined, _ in [*PRIOR_BREAKS, *breaks]:
            s = sum(weights[f] for f in features)
            if (s > 0) != joined:
                update(features, 1.0 if joined else -1.0)
            step += 1
    return Editor({f: w - total[f] / step for f, w in weights.items() if w or total[f]}, systematic)
