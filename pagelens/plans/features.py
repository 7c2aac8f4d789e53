"""Page features: 144 columns in five groups from a page's arrays, and the n-gram, language-model and lexicon groups by joins.

The JSON-only groups are expressions over one row per page (no shuffle); selecting a group plans only
its columns. Absent values are NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import geometry as G
from pagelens.functions import stats as S
from pagelens.functions import text as T
from pagelens.operators.quantiles import exact_quantiles

NAN = float("nan")
GROUPS = ("segmentation", "regionization", "layout", "htr_confidence", "text")


class Stages:
    """Names for values that several features share: arrays first, then their statistics, each computed once per page."""

    def __init__(self) -> None:
        self.arrays: dict[str, Column] = {}
        self.summaries: dict[str, Column] = {}

    def array(self, name: str, values: Column) -> Column:
        self.arrays[f"_{name}"] = values
        return F.col(f"_{name}")

    def stats(self, values: Column, prefix: str) -> dict[str, Column]:
        self.summaries[f"_s_{prefix}"] = S.summary_of(values)
        return {f"{prefix}_{k}": F.col(f"_s_{prefix}")[k] for k in S.STATS}


def _d(c: Column) -> Column:
    return c.cast("double")


def _bare(x: Column) -> Column:
    return G.box(x["xmin"], x["ymin"], x["xmax"], x["ymax"])


def _gaps(centres: Column) -> Column:
    """Positive differences of neighbours after sorting."""
    ordered = F.array_sort(centres)
    return F.filter(F.transform(ordered, lambda y, i: F.when(i > 0, y - F.get(ordered, i - 1))), lambda d: d.isNotNull() & (d > 0))


def _of_region(lines: Column, i: Column) -> Column:
    return F.filter(lines, lambda x: x["region_pos"] == i)


def segmentation(at: Stages, regions: Column, lines: Column, edges: dict[str, Sequence[float]]) -> dict[str, Column]:
    region_conf = at.array("region_conf", S.finite_of(F.transform(regions, lambda r: r["seg_conf"])))
    line_conf = at.array("line_conf", S.finite_of(F.transform(lines, lambda x: x["seg_conf"])))
    chars = at.array("chars", F.transform(lines, lambda x: _d(F.length(x["text"]))))
    low, high = F.col("_low"), F.col("_high")
    at.summaries |= {"_low": S.array_percentile(chars, 0.2), "_high": S.array_percentile(chars, 0.8)}
    share = lambda test: F.when(F.size(chars) > 0, F.size(F.filter(chars, test)) / F.size(chars)).otherwise(F.lit(NAN))
    inner = F.flatten(F.transform(regions, lambda r, i: _gaps(F.transform(_of_region(lines, i), G.center_y))))
    stored = F.transform(regions, lambda r, i: F.transform(_of_region(lines, i), G.center_y))
    inversions = F.aggregate(
        F.transform(stored, lambda ys: F.size(F.filter(F.transform(ys, lambda y, i: (i > 0) & (y < F.coalesce(F.get(ys, i - 1), y))), lambda b: b))),
        F.lit(0), lambda a, n: a + n,
    )
    return {
        "num_regions": _d(F.size(regions)),
        "num_lines": _d(F.size(lines)),
        "has_region_conf": _d(F.size(S.finite_of(region_conf)) > 0),
        **at.stats(region_conf, "region_conf"),
        **at.stats(line_conf, "line_conf"),
        **S.array_histogram(region_conf, edges["region_conf"], "region_conf"),
        **S.array_histogram(line_conf, edges["line_conf"], "line_conf"),
        **at.stats(F.transform(regions, G.area), "region_area"),
        **at.stats(F.transform(F.filter(regions, lambda r: G.height(r) > 0), lambda r: F.try_divide(G.width(r), G.height(r))), "region_aspect"),
        "region_overlap_count": _d(G.overlap_pairs(regions)),
        **at.stats(F.transform(lines, G.height), "line_height"),
        **at.stats(F.transform(lines, G.width), "line_width"),
        **at.stats(inner, "line_spacing"),
        **at.stats(_gaps(F.transform(lines, G.center_y)), "page_line_spacing"),
        "frac_short_lines": share(lambda c: c < low),
        "frac_long_lines": share(lambda c: c > high),
        "line_overlap_count": _d(G.overlap_pairs(lines)),
        "region_to_line_ratio": F.when(F.size(regions) > 0, F.size(lines) / F.size(regions)).otherwise(F.lit(NAN)),
        "reading_order_inversions": _d(inversions),
        "region_conf_entropy": S.array_entropy(region_conf),
        "line_conf_entropy": S.array_entropy(line_conf),
    }


def regionization(at: Stages, regions: Column, lines: Column) -> dict[str, Column]:
    counts = F.transform(regions, lambda r: _d(r["n_lines"]))
    n = F.size(regions)
    kept = at.array("kept", F.filter(
        F.transform(regions, lambda r, i: F.struct(G.area(r).alias("area"), G.height(r).alias("height"), _of_region(lines, i).alias("lines"))),
        lambda r: (F.size(r["lines"]) > 0) & (r["area"] > 0),
    ))
    total = lambda r, f: S.total_of(F.transform(r["lines"], f))
    ratio = lambda size, part: F.filter(F.transform(kept, lambda r: F.when((r[size] > 0) & (total(r, part) > 0), F.try_divide(r[size], total(r, part)))), lambda x: x.isNotNull())
    many = F.filter(kept, lambda r: F.size(r["lines"]) >= 2)
    spread = lambda f: S.mean_of(F.transform(many, lambda r: S.std_of(F.transform(r["lines"], f))))
    part = lambda test: F.when(n > 0, F.size(F.filter(counts, test)) / n).otherwise(F.lit(NAN))
    return {
        **at.stats(counts, "lines_per_region"),
        "frac_single_line_regions": part(lambda c: c == 1),
        "frac_multi_line_regions": part(lambda c: c >= 2),
        "max_lines_in_region": S.or_nan(F.array_max(counts)),
        **at.stats(ratio("area", G.area), "region_tightness_area_ratio"),
        **at.stats(ratio("height", G.height), "region_height_to_lines_height_ratio"),
        "region_xmin_std_mean": spread(lambda x: x["xmin"]),
        "region_xmax_std_mean": spread(lambda x: x["xmax"]),
        "region_centerx_std_mean": spread(G.center_x),
    }


def layout(at: Stages, regions: Column, lines: Column) -> dict[str, Column]:
    page = at.array("page", G.union_box(F.concat(F.transform(regions, _bare), F.transform(F.filter(lines, lambda x: x["region_pos"].isNull()), _bare))))
    area = F.when(G.area(page) == 0, 1.0).otherwise(G.area(page))
    xs = at.array("xs", F.transform(lines, G.center_x))
    low, high = F.array_min(xs), F.array_max(xs)
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    at.summaries["_edge"] = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.when(i == 10, hi).otherwise(lo + i * ((hi - lo) / 10)))
    edge = F.col("_edge")
    bins = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.size(F.filter(xs, lambda x: (x >= F.get(edge, i)) & ((x < F.get(edge, i + 1)) | ((i == 9) & (x <= F.get(edge, i + 1)))))),
    )
    columns = F.size(F.filter(bins, lambda k: k > 0.2 * F.array_max(bins)))
    small = F.size(F.filter(regions, lambda r: G.area(r) < 0.01 * area))
    whole = lambda c: F.when(page.isNotNull(), c).otherwise(F.lit(NAN))
    return {
        "text_density": whole(S.total_of(F.transform(lines, G.area)) / area),
        "num_columns_est": whole(F.when(F.size(xs) > 0, _d(F.greatest(F.lit(1), F.least(columns, F.lit(4))))).otherwise(F.lit(NAN))),
        "layout_fragmentation_score": whole(small / F.greatest(F.lit(1), F.size(regions))),
    }


def htr_confidence(at: Stages, lines: Column, edges: dict[str, Sequence[float]]) -> dict[str, Column]:
    scores = at.array("scores", S.finite_of(F.transform(lines, lambda x: x["score"])))
    tokens = at.array("tokens", S.finite_of(F.flatten(F.transform(lines, lambda x: x["tokens"]))))
    chars = at.array("chars", F.transform(lines, lambda x: _d(F.length(x["text"]))))
    words = at.array("words", F.transform(lines, lambda x: _d(T.word_count(x["text"]))))
    return {
        **at.stats(scores, "htr_line_score"),
        **S.array_histogram(scores, edges["htr_line_score"], "htr_line_score"),
        **at.stats(tokens, "htr_token_score"),
        **S.array_histogram(tokens, edges["htr_token_score"], "htr_token_score"),
        "htr_token_score_entropy": S.array_entropy(tokens),
        **at.stats(chars, "line_char_count"),
        **at.stats(words, "line_word_count"),
        "total_chars": S.total_of(chars),
        "total_words": S.total_of(words),
    }


def page_text(lines: Column) -> Column:
    """The page's lines joined by line breaks."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def text(at: Stages, lines: Column) -> dict[str, Column]:
    joined = at.array("joined", page_text(lines))
    some = F.length(joined) > 0
    runs = F.aggregate(F.transform(lines, lambda x: T.long_runs(x["text"])), F.lit(0), lambda a, n: a + n)
    without = F.size(F.filter(lines, lambda x: ~T.has_letter(x["text"]))) / F.size(lines)
    return {
        **T.char_classes(joined),
        "frac_no_alpha_lines": F.when(some, without).otherwise(F.lit(NAN)),
        "long_repetition_run_count": F.when(some, _d(runs)).otherwise(F.lit(NAN)),
    }


def page_features(page_rows: DataFrame, groups: Iterable[str] | None = None, edges: dict[str, Sequence[float]] | None = None, key: str = "page_no", extra: dict[str, Callable[[Stages, Column, Column], dict[str, Column]]] | None = None) -> DataFrame:
    """The key and the features of the chosen groups (none chosen: all five), columns sorted by name.

    ``page_rows`` comes from :func:`pagelens.sources.page_json.pages`; unreadable pages are left out (see
    its error table). ``edges`` gives histogram edges per confidence family; the default is ten equal
    bins over 0..1. ``extra`` adds groups of one's own: a function from the stages, the regions and the
    lines to columns; they can be chosen like the others. An unknown group is a ValueError.
    """
    every = (*GROUPS, *(extra or ()))
    chosen = tuple(groups or every)
    if unknown := set(chosen) - set(every):
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    equal = S.linspace(0.0, 1.0, 10)
    bins = {f: S.sanitize_edges(edges[f]) if edges and f in edges else equal for f in ("region_conf", "line_conf", "htr_line_score", "htr_token_score")}
    r, x, at = F.col("regions"), F.col("lines"), Stages()
    built = {
        "segmentation": lambda: segmentation(at, r, x, bins),
        "regionization": lambda: regionization(at, r, x),
        "layout": lambda: layout(at, r, x),
        "htr_confidence": lambda: htr_confidence(at, x, bins),
        "text": lambda: text(at, x),
        **{name: lambda make=make: make(at, r, x) for name, make in (extra or {}).items()},
    }
    columns: dict[str, Column] = {}
    for g in every:
        if g in chosen:
            columns |= built[g]()
    base = page_rows.filter("error IS NULL").select(key, "regions", "lines")
    base = base.select("*", *(c.alias(n) for n, c in at.arrays.items()))
    base = base.select("*", *(c.alias(n) for n, c in at.summaries.items()))
    return base.select(key, *(S.or_nan(columns[c]).alias(c) for c in sorted(columns)))


def fit_bins(page_rows: DataFrame, quantiles: Sequence[float] = S.BIN_QUANTILES) -> dict[str, list[float]]:
    """Quantile edges of the four confidence families over all pages; no family is gathered in one place."""
    readable = page_rows.filter("error IS NULL")
    families = {
        "region_conf": F.transform("regions", lambda r: r["seg_conf"]),
        "line_conf": F.transform("lines", lambda x: x["seg_conf"]),
        "htr_line_score": F.transform("lines", lambda x: x["score"]),
        "htr_token_score": F.flatten(F.transform("lines", lambda x: x["tokens"])),
    }
    long = readable.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(k), S.finite_of(v)) for k, v in families.items())))).alias("family", "values"))
    rows = exact_quantiles(long.select("family", F.explode("values").alias("v")), ["family"], "v", quantiles).collect()
    found: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r.family, r.i)):
        found.setdefault(r.family, []).append(r.edge)
    return {f: S.sanitize_edges(found.get(f)) for f in families}
