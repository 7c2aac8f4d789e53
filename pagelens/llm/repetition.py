"""Repetition inside single documents: zstandard compression bands, then the exact share of repeated words.

Each document is compressed whole and in fixed chunks, as a stream of word codes of four bytes each, so
that its ratio (compressed over plain bytes) counts words and not letters. Repeated runs shrink to a
match each: a document that repeats a share s of its words, in runs of eight or more, is covered by at
most two matches per eight repeated words, and a match costs a few bytes more with the length of the
document. The limit of the ``repetitive`` band is that bound (:func:`repetitive_limit`), so the band
rejects what is not repetitive enough without losing a case, and the exact count only has to look at the
band. The compressor's optimal parser searches every position (its fast levels skip ahead in streams of ever
new words, and so miss runs).
A second ratio, over the bytes of the words, labels ``incompressible`` text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import batch_words, codes

#: Words of a run that must have stood earlier, and the share of words in such runs that makes a case.
RUN_WORDS = 8
REPEATED_SHARE = 0.3
#: Words of a fixed chunk, and bytes of one for the ratio over bytes.
CHUNK_WORDS = 1024
CHUNK_BYTES = 4096
LEVEL = 3
#: Bytes by which a frame may exceed what its matches and literals say: headers, tables, and bytes at the ends of matches.
FRAME_BYTES = 40

#: Bytes of a text's words, and the ratio from which a text of that length counts as incompressible.
INCOMPRESSIBLE_LIMITS = ((64, 1.3), (256, 1.0), (1024, 0.85), (4096, 0.75))

_SCHEMA = "doc_id long, n_words long, n_bytes long, ratio double, chunk_ratio double, byte_ratio double, band string, repeated_words long, repeated_share double"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_bytes", pa.int64()),
        ("ratio", pa.float64()),
        ("chunk_ratio", pa.float64()),
        ("byte_ratio", pa.float64()),
        ("band", pa.string()),
        ("repeated_words", pa.int64()),
        ("repeated_share", pa.float64()),
    ]
)


def limit(n_bytes: int, points: tuple[tuple[int, float], ...]) -> float:
    """The limit for a text of that length, linear in the logarithm of the length between the points."""
    return float(np.interp(np.log(max(n_bytes, 1)), [np.log(n) for n, _ in points], [r for _, r in points]))


def repetitive_limit(n_words: np.ndarray, share: float = REPEATED_SHARE) -> np.ndarray:
    """The ratio up to which a document of that many words may repeat ``share`` of them."""
    # A match: three codes of up to eight bits, its offset, and the lengths beyond the codes.
    match_bytes = (24 + 2 * np.log2(4.0 * np.maximum(n_words, 1))) / 8
    # Two matches instead of the 32 bytes of eight words; a frame has a header and tables for each 128 kB.
    return 1.0 - share * (1 - 2 * match_bytes / 32) + FRAME_BYTES * (1 + n_words // 32768) / (4.0 * np.maximum(n_words, 1))


def compressor(n_words: int) -> zstandard.ZstdCompressor:
    """Optimal parsing with matches of seven bytes or more, over a window that holds the whole text."""
    window = min(27, max(10, int(4 * n_words).bit_length()))
    tables = min(24, max(8, window))
    params = zstandard.ZstdCompressionParameters(
        window_log=window, hash_log=tables, chain_log=tables, search_log=7, min_match=7, target_length=64, strategy=zstandard.STRATEGY_BTOPT
    )
    return zstandard.ZstdCompressor(compression_params=params)


def repeated_words(code: np.ndarray, text: np.ndarray, run: int = RUN_WORDS) -> np.ndarray:
    """For each word of a batch (see :func:`words.codes`), whether it lies in a run that stood earlier in its text.

    Windows of ``run`` words are compared by a 64-bit polynomial hash and then word by word.
    """
    covered = np.zeros(len(code), dtype=bool)
    n = len(code) - run + 1
    if n <= 0:
        return covered
    value = (code.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    key = np.zeros(n, dtype=np.uint64)
    inside = np.ones(n, dtype=bool)
    for k in range(run):
        key = key * np.uint64(0xD1342543DE82EF95) + value[k : k + n]
        inside &= code[k : k + n] >= 0
    key ^= text[:n].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    at = np.flatnonzero(inside)
    _, first, inverse = np.unique(key[at], return_index=True, return_inverse=True)
    earlier = at[first[inverse]]
    hit = earlier < at
    at, earlier = at[hit], earlier[hit]
    same = text[at] == text[earlier]
    for k in range(run):
        same &= code[at + k] == code[earlier + k]
    at = at[same]
    mark = np.zeros(len(code) + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + run, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(documents: DataFrame, exact: str = "repetitive", run: int = RUN_WORDS, share: float = REPEATED_SHARE, byte_ratios: bool = True) -> DataFrame:
    """Compression band and repeated share of every document.

    ``documents`` has doc_id and text; other columns are ignored. ``exact`` says for which documents
    repeated_words and repeated_share are counted: ``repetitive`` (the others get null) or ``all``.
    Columns: doc_id, n_words, n_bytes (of the words joined by blanks), ratio (of the word codes, null
    without words), chunk_ratio (the lowest of the fixed chunks), byte_ratio (of the bytes, null unless
    ``byte_ratios``), band, repeated_words, repeated_share. Bands: ``repetitive`` (the whole document, by
    its length, or one of its chunks is within the limit for ``share``), ``incompressible`` (by its
    bytes), ``ordinary``, ``empty``. Null and blank texts are ``empty`` with share 0. Every row gives a
    row, also repeated ones; whole texts are read. No shuffle.
    """

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdCompressor(level=LEVEL)
        made: dict[int, zstandard.ZstdCompressor] = {}

        def size_of(data: bytes) -> int:
            n = len(data) // 4
            key = n.bit_length()
            if key not in made:
                made[key] = compressor((1 << key) - 1)
            return len(made[key].compress(data))

        for batch in batches:
            found = batch_words(batch.column(1).to_pylist())
            code, text = codes(found)
            ends = np.flatnonzero(code == -1)
            starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
            counts = ends - starts
            # A multiplication by an odd number spreads the codes over 32 bits, one to one.
            stream = ((code + 1).astype(np.uint32) * np.uint32(0x9E3779B1)).astype("<u4").tobytes()
            whole_limit = repetitive_limit(counts, share)
            chunk_limit = float(repetitive_limit(np.array([CHUNK_WORDS]), share)[0])
            ratios, lows, byte_rows, bands, sizes = [], [], [], [], []
            for a, b, n, most in zip(starts.tolist(), ends.tolist(), counts.tolist(), whole_limit.tolist()):
                if not n:
                    for column in (ratios, lows, byte_rows):
                        column.append(None)
                    sizes.append(0)
                    bands.append("empty")
                    continue
                data = stream[4 * a : 4 * b]
                ratio = low = size_of(data) / len(data)
                band = "repetitive" if ratio <= most else "ordinary"
                if n > CHUNK_WORDS:
                    cut = 4 * CHUNK_WORDS
                    low = min(size_of(data[i : i + cut]) / cut for i in range(0, len(data) - cut + 1, cut))
                    band = "repetitive" if low <= chunk_limit else band
                ratios.append(ratio)
                lows.append(low)
                if not byte_ratios:
                    byte_rows.append(None)
                    sizes.append(None)
                else:
                    letters = " ".join(found[a:b]).encode("utf-8", "surrogatepass")
                    sizes.append(len(letters))
                    byte_rows.append(len(plain.compress(letters)) / len(letters))
                    if band == "ordinary" and byte_rows[-1] >= limit(len(letters), INCOMPRESSIBLE_LIMITS):
                        band = "incompressible"
                bands.append(band)
            wanted = np.array([exact == "all" or b == "repetitive" for b in bands], dtype=bool)
            keep = np.repeat(wanted, counts + 1) if len(counts) else np.zeros(0, dtype=bool)
            sums = np.bincount(text[keep], weights=repeated_words(code[keep], text[keep], run), minlength=len(counts)) if keep.any() else np.zeros(len(counts))
            repeated = [int(s) if w or b == "empty" else None for s, w, b in zip(sums.tolist(), wanted.tolist(), bands)]
            shares = [None if r is None else r / c if c else 0.0 for r, c in zip(repeated, counts.tolist())]
            arrays = [batch.column(0), counts, sizes, ratios, lows, byte_rows, bands, repeated, shares]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _ARROW)], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run_batches, _SCHEMA)


def repetitive(documents: DataFrame, share: float = REPEATED_SHARE, run: int = RUN_WORDS) -> DataFrame:
    """Documents (doc_id, repeated_share) at least ``share`` of whose words are repeated: those of the repetitive band, counted exactly.

    The band loses none of them for runs of eight or more words (``run``).
    """
    if run < 8:
        raise ValueError("the limits of the band hold for runs of eight or more words")
    found = measure(documents, "repetitive", run, share, byte_ratios=False)
    return found.filter((F.col("band") == "repetitive") & (F.col("repeated_share") >= share)).select("doc_id", "repeated_share")
