"""Ground-truth targets of a page: error rates, bag of words, box matching and average precision.

The kernel works on one page at a time (pages are bounded), over Arrow batches of joined pages: one
shuffle for the join, edit distances once, one matching for all thresholds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import polygons
from pagelens.operators.assignment import solve

NAN = float("nan")
_WORDS = re.compile(r"\w+")

#: The 34 targets in their public order.
TARGETS = tuple(
    f"target_{t}"
    for t in (
        "perm_cer_strict perm_cer_split_tol perm_cer_split_penalty perm_cer_htr_only geom_order_avg_line_cer avg_line_cer seg_error ro_error delta_cer"
        " pi_missing_ratio pi_halluc_ratio avg_missing_ratio avg_halluc_ratio gt_num_lines pred_num_lines bow_precision bow_recall bow_f1"
        " map50_line map75_line map50_region map75_region iou50_line_precision iou50_line_recall iou50_line_f1 iou75_line_precision iou75_line_recall iou75_line_f1"
        " soft_iou50_line_precision soft_iou50_line_recall soft_iou50_line_f1 soft_iou75_line_precision soft_iou75_line_recall soft_iou75_line_f1"
    ).split()
)


def levenshtein(a: str, b: str) -> int:
    """Edit distance over code points; one vectorised row per character of the shorter text."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    other = np.array([ord(c) for c in b], dtype=np.int32)
    ramp = np.arange(len(b) + 1)
    row = ramp.copy()
    for i, c in enumerate(a, 1):
        ahead = np.empty_like(row)
        ahead[0] = i
        np.minimum(row[:-1] + (other != ord(c)), row[1:] + 1, out=ahead[1:])
        row = np.minimum.accumulate(ahead - ramp) + ramp
    return int(row[-1])


def distances(truth: Sequence[str], read: Sequence[str]) -> np.ndarray:
    """Edit distances of all pairs; each character of a truth line advances the rows of all read lines at once."""
    m, n = len(truth), len(read)
    out = np.zeros((m, n))
    if not m or not n:
        return out
    longest = max(map(len, read))
    other = np.full((n, longest), -1, dtype=np.int32)
    for j, r in enumerate(read):
        other[j, : len(r)] = [ord(c) for c in r]
    ends = np.array([len(r) for r in read])
    ramp = np.arange(longest + 1, dtype=np.int32)
    for i, t in enumerate(truth):
        row = np.broadcast_to(ramp, (n, longest + 1)).copy()
        for k, c in enumerate(t, 1):
            ahead = np.empty_like(row)
            ahead[:, 0] = k
            np.minimum(row[:, :-1] + (other != ord(c)), row[:, 1:] + 1, out=ahead[:, 1:])
            ahead -= ramp
            np.minimum.accumulate(ahead, axis=1, out=ahead)
            row = ahead + ramp
        out[i] = row[np.arange(n), ends]
    return out


def permutation_cer(truth: Sequence[str], read: Sequence[str], dist: np.ndarray, insertion: float) -> tuple[float, float]:
    """Error rate under the best pairing of lines whatever their order, and the rate over paired lines only.

    Lines left over cost their characters, read ones times ``insertion``. Without truth lines the
    denominator is 1; truth lines that are all empty have no rate (ZeroDivisionError).
    """
    m, n = len(truth), len(read)
    if not m and not n:
        return 0.0, NAN
    size = max(m, n)
    cost = np.zeros((size, size))
    cost[:m, :n] = dist
    cost[:m, n:] = np.array([len(t) for t in truth], dtype=float)[:, None]
    cost[m:, :n] = insertion * np.array([len(r) for r in read], dtype=float)[None, :]
    columns = solve(cost)
    total = cost[np.arange(size), columns].sum()
    chars = sum(map(len, truth)) if m else 1
    if chars == 0:
        raise ZeroDivisionError("no characters in the ground truth")
    pairs = [(r, c) for r, c in enumerate(columns) if r < m and c < n]
    paired_chars = sum(len(truth[r]) for r, _ in pairs)
    return total / chars, sum(dist[r, c] for r, c in pairs) / paired_chars if paired_chars else NAN


def linewise_cer(truth: Sequence[str], read: Sequence[str]) -> float:
    """Mean line error rate in the given order; a truth line without a read one counts 1."""
    if not truth:
        return 0.0
    rates = []
    for i, t in enumerate(truth):
        if i >= len(read):
            rates.append(1.0)
        elif not t:
            rates.append(0.0 if not read[i] else 1.0)
        else:
            rates.append(levenshtein(t, read[i]) / len(t))
    return sum(rates) / len(rates)


def in_page_order(lines: Sequence[dict]) -> list[str]:
    """Texts by (ymin, xmin) if every line has a box, else as stored."""
    if lines and all(x["xmin"] is not None for x in lines):
        lines = sorted(lines, key=lambda x: (x["ymin"], x["xmin"]))
    return [x["text"] or "" for x in lines]


def bag_of_words(truth: Sequence[str], read: Sequence[str]) -> tuple[float, float, float]:
    a = Counter(w for t in truth for w in _WORDS.findall(t.lower()))
    b = Counter(w for t in read for w in _WORDS.findall(t.lower()))
    if not a and not b:
        return 1.0, 1.0, 1.0
    if not a:
        return 0.0, 1.0, 0.0
    if not b:
        return 0.0, 0.0, 0.0
    both = sum((a & b).values())
    p, r = both / sum(b.values()), both / sum(a.values())
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (rows xmin, ymin, xmax, ymax); 0 where the union is empty."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    side = lambda lo, hi: np.maximum(0.0, np.minimum(a[:, None, hi], b[None, :, hi]) - np.maximum(a[:, None, lo], b[None, :, lo]))
    inter = side(0, 2) * side(1, 3)
    area = lambda x: np.maximum(0.0, x[:, 2] - x[:, 0]) * np.maximum(0.0, x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def greedy_ious(iou: np.ndarray) -> list[float]:
    """IoU of one-to-one pairs taken from the best down (ties: lower truth, then lower prediction); pairs with 0 count too."""
    m, n = iou.shape
    order = np.argsort(-iou, axis=None, kind="stable")
    rows, columns = set(), set()
    out = []
    for k in order:
        r, c = divmod(int(k), n)
        if r not in rows and c not in columns:
            rows.add(r)
            columns.add(c)
            out.append(float(iou[r, c]))
            if len(out) == min(m, n):
                break
    return out


def precision_recall(n_truth: int, n_read: int, mass: float) -> tuple[float, float, float]:
    if not n_truth and not n_read:
        return 1.0, 1.0, 1.0
    if not n_truth:
        return 0.0, 1.0, 0.0
    if not n_read:
        return 1.0, 0.0, 0.0
    p, r = mass / n_read, mass / n_truth
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def average_precision(iou: np.ndarray, scores: Sequence[float], threshold: float) -> float:
    """Area under the precision envelope; ``iou`` is truth by prediction, best scores choose first (ties as stored)."""
    m, n = iou.shape
    if not m or not n:
        return 1.0 if m == n else 0.0
    free = np.ones(m, dtype=bool)
    hits = []
    for j in sorted(range(n), key=lambda j: -scores[j]):
        column = np.where(free, iou[:, j], -1.0)
        best = int(column.argmax())
        hit = column[best] > 0 and column[best] >= threshold
        free[best] &= not hit
        hits.append(hit)
    true = np.cumsum(hits)
    precision = true / np.arange(1, n + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    return float(sum(e / m for e, h in zip(envelope, hits) if h))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def _boxes(items: Sequence[dict]) -> np.ndarray:
    return np.array([[x["xmin"], x["ymin"], x["xmax"], x["ymax"]] for x in items], dtype=float).reshape(-1, 4)


def targets(truth_lines: Sequence[dict], truth_boxes: Sequence[dict], truth_regions: Sequence[dict], read_lines: Sequence[dict], detections: Sequence[dict], strict: float = 1.0, tolerant: float = 0.0) -> dict[str, float]:
    """All 34 targets of a page. Lines have text and a box or None; detections have kind, score and a box.

    Boxes of lines on both sides may have a polygon; pairs that both have one are matched by its
    intersection over union, others by that of their boxes. Average precision always takes boxes.
    """
    truth, read = [x["text"] or "" for x in truth_lines], [x["text"] or "" for x in read_lines]
    m, n = len(truth), len(read)
    dist = distances(truth, read)
    perm, htr_only = permutation_cer(truth, read, dist, strict)
    split, _ = permutation_cer(truth, read, dist, tolerant)
    average, geometric = linewise_cer(truth, read), linewise_cer(in_page_order(truth_lines), in_page_order(read_lines))
    missing, extra = max(0, m - n) / max(1, m), max(0, n - m) / max(1, n)
    line_boxes = _boxes(truth_boxes)
    found = {k: [d for d in detections if d["kind"] == k] for k in ("line", "region")}
    iou = {"line": iou_matrix(line_boxes, _boxes(found["line"])), "region": iou_matrix(_boxes(truth_regions), _boxes(found["region"]))}
    outlines = [[x.get("polygon") for x in side] for side in (truth_boxes, found["line"])]
    pairs = greedy_ious(polygons.iou_matrix(*outlines, iou["line"])) if iou["line"].size else []
    values = [
        perm, split, perm - split, htr_only, geometric, average, geometric - perm, average - geometric, average - perm,
        missing, extra, missing, extra, float(m), float(n), *bag_of_words(truth, read),
    ]
    for kind in ("line", "region"):
        values += [average_precision(iou[kind], [d["score"] for d in found[kind]], t) for t in (0.5, 0.75)]
    sizes = (len(line_boxes), len(found["line"]))
    for t in (0.5, 0.75):
        values += precision_recall(*sizes, sum(v >= t for v in pairs))
    for t, k in ((0.5, 12.0), (0.75, 15.0)):
        values += precision_recall(*sizes, sum(_sigmoid(k * (v - t)) for v in pairs))
    return dict(zip(TARGETS, values, strict=True))


def evaluate(truth: DataFrame, read: DataFrame, key: str = "stem", strict: float = 1.0) -> DataFrame:
    """Targets per page that both sides have: key, the 34 targets, and error (null, or why a page has none).

    ``truth`` has key, lines (text and box), boxes and regions; ``read`` key, lines and detections, as
    :mod:`pagelens.sources` reads them. A page whose metrics fail keeps its row with null targets.
    """
    # The kernel costs far more than its input's bytes say, so its partitions are not coalesced by size.
    parts = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    truth, read = truth.repartition(parts, key), read.repartition(parts, key)
    joined = truth.select(key, F.col("lines").alias("truth_lines"), "boxes", F.col("regions").alias("truth_regions")).join(
        read.select(key, F.col("lines").alias("read_lines"), "detections"), key
    )
    kind = dict(truth.dtypes)[key]
    schema = pa.schema([*((t, pa.float64()) for t in TARGETS), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cells in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                try:
                    rows.append({**targets(*(c or [] for c in cells), strict=strict), "error": None})
                except Exception as e:
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *schema.names])

    return joined.mapInArrow(run, f"{key} {kind}, {', '.join(f'{t} double' for t in TARGETS)}, error string")


def corpus_means(evaluated: DataFrame) -> DataFrame:
    """Number of pages and the mean of every target over pages without error."""
    return evaluated.filter("error IS NULL").agg(F.count("*").alias("n_pages"), *(F.avg(t).alias(t) for t in TARGETS))
