"""Words of texts in Arrow batches, shared by the text operators of this package."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd

#: Code that parts the texts of a batch; it is no letter and no digit.
BREAK = "\x01"
_WORDS = re.compile(r"[^\W_]+|\x01")
#: A word broken at the end of a line: the mark, the line break, and the rest of the word.
BROKEN = re.compile(r"(?<=\w)[-‐‑=¬­][^\S\n]*\r?\n\s*(?=\w)")


def fold(text: str | None) -> str:
    """Lower case, composed accents; null is the empty text."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower()


def words(text: str | None, join_lines: bool = False) -> list[str]:
    """Runs of letters and digits, case aside."""
    text = fold(text).replace(BREAK, " ")
    if join_lines and "\n" in text:
        text = BROKEN.sub("", text)
    return _WORDS.findall(text)


def batch_words(texts: list[str | None], join_lines: bool = False) -> list[str]:
    """All words of a batch in one list, with BREAK after each text."""
    folded = [fold(t).replace(BREAK, " ") for t in texts]
    if join_lines:
        folded = [BROKEN.sub("", t) if "\n" in t else t for t in folded]
    return _WORDS.findall(BREAK.join(folded) + BREAK) if folded else []


def codes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Integer code of each word of :func:`batch_words` (equal words, equal codes) and the number of its text.

    The breaks have code -1 and belong to the text before them.
    """
    code, values = pd.factorize(np.array(found, dtype=object))
    code = code.astype(np.int64)
    at = np.flatnonzero(values == BREAK)
    if len(at):
        code[code == at[0]] = -1
    stop = code == -1
    text = np.cumsum(stop) - stop
    return code, text
