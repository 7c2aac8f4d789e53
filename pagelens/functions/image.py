"""Image statistics of a page in grey levels, the place of its text, and its fold, in NumPy over Arrow batches of Spark's image source.

Stroke widths come from a two-pass chamfer distance, components from runs of dark pixels that are
joined row by row. The skew is the slope at which dark pixels fall into the sharpest rows, in degrees;
it is measured on all dark pixels, not on detected line segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The ten image features in their public order.
NAMES = (
    "img_mean_intensity", "img_std_intensity", "img_contrast", "blur_score_var_laplacian", "noise_std_diff_median", "fg_ratio",
    "stroke_width_mean", "stroke_width_std", "cc_count", "skew_angle_deg",
)


def grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Luma of blue-green-red(-alpha) bytes, as 8-bit levels."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels == 1 else np.floor(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2] + 0.5)


def otsu(g: np.ndarray) -> int:
    """Level that parts the histogram with the largest variance between both sides."""
    h = np.bincount(g.astype(np.int64).ravel(), minlength=256).astype(float)
    w = np.cumsum(h)
    s = np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w / w[-1] - s) ** 2 / (w * (w[-1] - w))
    return int(np.nan_to_num(between, nan=-1.0, posinf=-1.0).argmax())


#: Steps of the chamfer distance, straight and diagonal.
STRAIGHT, DIAGONAL = 0.955, 1.3693


def distances(dark: np.ndarray) -> np.ndarray:
    """Distance of each dark pixel to the nearest light one; infinite without any."""
    d = np.where(dark, np.inf, 0.0)
    ramp = STRAIGHT * np.arange(dark.shape[1])

    def sweep(d: np.ndarray) -> None:
        before = np.full(d.shape[1] + 2, np.inf)
        for row in d:
            np.minimum(row, before[1:-1] + STRAIGHT, out=row)
            np.minimum(row, before[:-2] + DIAGONAL, out=row)
            np.minimum(row, before[2:] + DIAGONAL, out=row)
            row[:] = np.minimum.accumulate(row - ramp) + ramp
            before[1:-1] = row

    # The second pass goes from the last pixel to the first.
    sweep(d)
    sweep(d[::-1, ::-1])
    return d


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of components, runs as rows y, first, end, component number of each run) of the set pixels."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, first = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = np.arange(len(y))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if diagonal else 0
    starts = np.searchsorted(y, np.arange(mask.shape[0] + 1))
    for row in range(1, mask.shape[0]):
        i, j = starts[row - 1], starts[row]
        while i < starts[row] and j < starts[row + 1]:
            if first[i] < end[j] + reach and first[j] < end[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(y))], dtype=np.int64)
    found, number = np.unique(roots, return_inverse=True)
    return len(found), np.stack([y, first, end], axis=1) if len(y) else np.zeros((0, 3), dtype=np.int64), number


def skew(dark: np.ndarray) -> float:
    """Slope in degrees (within 45 either way, downwards positive) whose rows have the most uneven numbers of dark pixels; NaN without any."""
    y, x = np.nonzero(dark)
    if not len(y):
        return float("nan")
    best = 0.0
    for step, span in ((1.0, 45), (0.1, 10)):
        angles = best + step * np.arange(-span, span + 1)
        scores = []
        for a in angles:
            r = np.deg2rad(a)
            rows = np.floor(y * np.cos(r) - x * np.sin(r)).astype(np.int64)
            n = np.bincount(rows - rows.min()).astype(float)
            scores.append(np.square(n).sum())
        top = np.flatnonzero(np.array(scores) == max(scores))
        best = float(angles[top[np.abs(angles[top]).argmin()]])
    return best


def features(g: np.ndarray) -> dict[str, float]:
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    around = np.stack([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)])
    laplacian = around[1] + around[3] + around[5] + around[7] - 4 * g
    dark = g <= otsu(g)
    width = distances(dark)[dark]
    width = width[np.isfinite(width)]
    strokes = (width.mean(), width.std()) if len(width) else (np.nan, np.nan)
    # The background is a component too.
    count = components(dark)[0] + 1
    found = (g.mean(), g.std(), g.max() - g.min(), laplacian.var(), (g - np.median(around, axis=0)).std(), dark.mean(), *strokes, count, skew(dark))
    return dict(zip(NAMES, map(float, found)))


def _bounds(levels: np.ndarray, window: int, whole: int) -> tuple[int, int]:
    """Where the text begins and ends along a projection: the first and last place at which it turns darker than its middle and stays so."""
    levels = levels / levels.max() if levels.max() > 0 else levels.astype(float)
    n = len(levels)
    grey_level = np.sort(levels)[int(n * 0.1) : int(0.9 * n)].mean()
    if n <= 2 * window:
        return 0, whole
    medians = np.median(np.lib.stride_tricks.sliding_window_view(levels, window), axis=1)
    begin = np.arange(window, n - window)
    hit = np.flatnonzero((medians[begin - window] > grey_level) & (grey_level > medians[begin]))
    i = int(begin[hit[0]] if len(hit) else begin[-1])
    end = np.arange(n - window, window, -1)
    hit = np.flatnonzero((medians[end - window] < grey_level) & (grey_level < medians[end]))
    j = int(end[hit[0]] if len(hit) else end[-1])
    return (i, j) if i <= j else (0, whole)


def printspace(g: np.ndarray, window: int = 150) -> tuple[int, int, int, int]:
    """Box (xmin, ymin, xmax, ymax) of the main text, from the projections of dark pixels; the whole page where none is found.

    A dark border that joins the top left corner is taken away first.
    """
    light = g > otsu(g)
    if not light[0, 0]:
        _, runs, number = components(~light, diagonal=False)
        for y, first, end in runs[number == number[0]]:
            light[y, first:end] = True
    x0, x1 = _bounds(light.sum(axis=0).astype(float), window, g.shape[1])
    y0, y1 = _bounds(light.sum(axis=1).astype(float), window, g.shape[0])
    return x0, y0, x1, y1


def fold(g: np.ndarray, strip: float = 0.1, threshold: float = 0.2) -> int | None:
    """Column of the dark fold between two pages, None for a single page: the darkest column of the middle strip, if it is among the darkest of all."""
    width = g.shape[1]
    levels = g.sum(axis=0)
    middle, half = width // 2, int(strip * width / 2)
    inner = levels[middle - half : middle + half]
    if len(inner) and inner.min() < np.sort(levels)[int(width * threshold)]:
        return int(middle - half + inner.argmin())
    return None


def page_layout(images: DataFrame, window: int = 150, strip: float = 0.1, threshold: float = 0.2) -> DataFrame:
    """path, the box of the printspace, and fold (null for a single page) of each row of Spark's image source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, w, c, d in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                g = grey(h, w, c, d)
                rows.append((*map(float, printspace(g, window)), fold(g, strip, threshold)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64() if i < 4 else pa.int64()) for i, c in enumerate(columns))], names=["path", "xmin", "ymin", "xmax", "ymax", "fold"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "path string, xmin double, ymin double, xmax double, ymax double, fold long")


def image_features(images: DataFrame) -> DataFrame:
    """path and the ten features of each row of Spark's image source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(grey(h, w, c, d)) for h, w, c, d in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], pa.float64()) for n in NAMES)], names=["path", *NAMES])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, f"path string, {', '.join(f'{n} double' for n in NAMES)}")
