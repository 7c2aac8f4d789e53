"""Writers: feature CSVs, logs, bin edges, and page exports as ALTO, PAGE, JSON and plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from xml.sax.saxutils import quoteattr, escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.boosting import Model
from pagelens.runtime import collect_small


def wide_csv(df: DataFrame, path: str, keys: Sequence[str] = ()) -> bool:
    """CSV with its columns in order of name; nothing is written for an empty table. Parts are written in parallel, each with the header."""
    if df.isEmpty():
        return False
    df.select(*keys, *sorted(c for c in df.columns if c not in keys)).write.mode("overwrite").csv(path, header=True)
    return True


def target_log(df: DataFrame, path: str, key: str, columns: Sequence[str]) -> None:
    """Appends one line per row: the key, then name=value in order of name, parted by tabs."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in sorted(columns)]
    df.select(F.concat_ws("\t", F.col(key).cast("string"), *parts).alias("value")).write.mode("append").text(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def save_edges(spark: SparkSession, edges: dict[str, Sequence[float]], path: str) -> None:
    """Bin edges by family as one JSON line, wherever Spark can write."""
    body = json.dumps({f"{k}_edges": list(v) for k, v in edges.items()})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_edges(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Bin edges by family, made strictly increasing."""
    from pagelens.functions.stats import sanitize_edges

    body = "\n".join(r[0] for r in collect_small(spark.read.text(path), 10_000, "lines of bin edges"))
    return {k.removesuffix("_edges"): sanitize_edges(v) for k, v in json.loads(body).items()}


def save_models(spark: SparkSession, models: dict[str, Model], path: str) -> None:
    """Trained models by name, as a table of their JSON."""
    spark.createDataFrame([(k, m.to_json()) for k, m in models.items()], "name string, model_json string").write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, Model]:
    return {r.name: Model.from_json(r.model_json) for r in collect_small(spark.read.parquet(path), 10_000, "models")}


def save_pca(spark: SparkSession, mean: np.ndarray, components: np.ndarray, path: str) -> None:
    rows = [(i, list(map(float, v))) for i, v in enumerate([mean, *components])]
    spark.createDataFrame(rows, "i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_pca(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(collect_small(spark.read.parquet(path), 100_000, "components"))
    return np.array(rows[0].v), np.array([r.v for r in rows[1:]])


def corpus(df: DataFrame, path: str) -> None:
    """Pages (volume, rel_path, text) as one ordered corpus: a header line, the text, a blank line."""
    header = F.concat(F.lit("# VOLUME="), F.col("volume"), F.lit(" PAGE="), F.col("rel_path"))
    df.orderBy(F.lower("rel_path"), "rel_path").select(F.concat(header, F.lit("\n"), F.col("text"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


# --- page exports: one string per page ------------------------------------------------------------


def plain_text(lines: str = "lines") -> Column:
    """Texts of a page's lines, one per line."""
    return F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")


def page_json(key: str = "page_no", regions: str = "regions", lines: str = "lines") -> Column:
    """A page as JSON; empty texts, zeros, empty arrays and nulls are left out, but token scores and confidences of 0 stay."""
    filled = lambda x, *names: x.withField(names[0], F.nullif(x[names[0]], F.lit(""))) if len(names) == 1 else filled(filled(x, names[0]), *names[1:])
    kept_lines = F.transform(lines, lambda x: filled(x, "text", "polygon").withField("tokens", F.coalesce(x["tokens"], F.array().cast("array<double>"))))
    kept_regions = F.transform(regions, lambda x: filled(x, "label", "polygon").withField("n_lines", F.nullif(x["n_lines"], F.lit(0))))
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.to_json(F.struct(F.col(key), some(kept_regions).alias(regions), some(kept_lines).alias(lines)), {"ignoreNullFields": "true"})


#: Characters that XML 1.0 has no form for; they are left out.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def _text(x) -> str:
    return _NO_XML.sub("", x["text"] or "")


def word_spans(text: str, x0: float, x1: float) -> list[tuple[str, float, float]]:
    """Words of a line with their edges, from equal pixels per character; a word takes one character more, cut at the line's end."""
    width = x1 - x0
    step = width // len(text) if text else 0
    at, out = 0.0, []
    for w in text.split():
        end = min(at + step * (len(w) + 1), width)
        out.append((w, x0 + at, x0 + end))
        at += step * (len(w) + 1)
    return out


def _points(b) -> str:
    """The polygon in whole pixels, else the corners of the box."""
    from pagelens.sources.page_json import polygon

    found = polygon(b["polygon"]) if b.get("polygon") else []
    if len(found) >= 3:
        return " ".join(f"{round(x)},{round(y)}" for x, y in found)
    x0, y0, x1, y1 = (round(b[k]) for k in ("xmin", "ymin", "xmax", "ymax"))
    return f"{x0},{y0} {x1},{y0} {x1},{y1} {x0},{y1}"


def _place(b) -> str:
    return f'HPOS="{round(b["xmin"])}" VPOS="{round(b["ymin"])}" WIDTH="{round(b["xmax"] - b["xmin"])}" HEIGHT="{round(b["ymax"] - b["ymin"])}"'


def _conf(x) -> str:
    return f' WC="{x["score"]:.4f}"' if x["score"] is not None else ""


def _in_regions(regions, lines) -> Iterator[tuple[dict | None, list]]:
    loose = [x for x in lines if x["region_pos"] is None]
    if loose:
        yield None, loose
    for i, r in enumerate(regions):
        yield r, [x for x in lines if x["region_pos"] == i]


def alto_page(name: str, regions, lines, steps: Sequence[str] = ()) -> str:
    """ALTO 4: one block per region, one string with its own box per word of a line, and the processing ``steps`` in order.

    A word broken with - or ¬ gets its whole as SUBS_CONTENT on both parts.
    """
    done = "".join(f'<Processing ID="step_{i}"><processingStepDescription>{escape(x)}</processingStepDescription></Processing>' for i, x in enumerate(steps))
    out = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#">',
        f"<Description><MeasurementUnit>pixel</MeasurementUnit><sourceImageInformation><fileName>{escape(name)}</fileName></sourceImageInformation>{done}</Description>",
        '<Layout><Page ID="page" PHYSICAL_IMG_NR="1"><PrintSpace>',
    ]
    for i, (r, members) in enumerate(_in_regions(regions, lines)):
        box = r if r is not None else {k: f(x[k] for x in members) for k, f in (("xmin", min), ("ymin", min), ("xmax", max), ("ymax", max))}
        out.append(f'<TextBlock ID="block_{i}" {_place(box)}>')
        spans = [word_spans(_text(x), x["xmin"], x["xmax"]) for x in members]
        words = [[w for w, _, _ in found] for found in spans]
        for j, x in enumerate(members):
            out.append(f'<TextLine ID="line_{i}_{j}" {_place(x)}>')
            for k, w in enumerate(words[j]):
                subs = ""
                if k == len(words[j]) - 1 and w[-1] in "-¬" and j + 1 < len(members) and words[j + 1]:
                    subs = f' SUBS_TYPE="HypPart1" SUBS_CONTENT={quoteattr(w[:-1] + words[j + 1][0])}'
                elif k == 0 and j and words[j - 1] and words[j - 1][-1][-1] in "-¬":
                    subs = f' SUBS_TYPE="HypPart2" SUBS_CONTENT={quoteattr(words[j - 1][-1][:-1] + w)}'
                if k:
                    out.append("<SP/>")
                place = _place({**x, "xmin": spans[j][k][1], "xmax": spans[j][k][2]})
                out.append(f"<String CONTENT={quoteattr(w)}{subs} {place}{_conf(x)}/>")
            out.append("</TextLine>")
        out.append("</TextBlock>")
    return "\n".join([*out, "</PrintSpace></Page></Layout></alto>"])


def page_page(name: str, regions, lines) -> str:
    """PAGE 2019: regions with absolute coordinates, lines with their text and confidence."""
    out = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15">',
        f"<Page imageFilename={quoteattr(name)}>",
    ]
    for i, (r, members) in enumerate(_in_regions(regions, lines)):
        box = r if r is not None else {k: f(x[k] for x in members) for k, f in (("xmin", min), ("ymin", min), ("xmax", max), ("ymax", max))}
        out.append(f'<TextRegion id="region_{i}"><Coords points="{_points(box)}"/>')
        for j, x in enumerate(members):
            conf = f' conf="{x["score"]:.4f}"' if x["score"] is not None else ""
            out.append(f'<TextLine id="line_{i}_{j}"><Coords points="{_points(x)}"/><TextEquiv{conf}><Unicode>{escape(_text(x))}</Unicode></TextEquiv></TextLine>')
        out.append("</TextRegion>")
    return "\n".join([*out, "</Page></PcGts>"])


def _xml(write: Callable) -> Callable[..., Column]:
    def column(key: str = "page_no", regions: str = "regions", lines: str = "lines") -> Column:
        @F.pandas_udf("string")
        def run(k: pd.Series, r: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series([write(str(a), b if b is not None else [], c if c is not None else []) for a, b, c in zip(k, r, x)])

        # Lines and regions travel as JSON-free arrays of structs; Arrow hands them over as lists of dicts.
        # They have to be columns of a table: Spark does not hand arrays made by lambdas to Python functions.
        return run(F.col(key).cast("string"), F.col(regions), F.col(lines))

    return column


alto = _xml(alto_page)
page_xml = _xml(page_page)

SERIALIZERS: dict[str, Callable[..., Column]] = {
    "alto": alto, "page": page_xml, "json": page_json, "txt": lambda key="page_no", regions="regions", lines="lines": plain_text(lines),
}
SERIALIZERS["text"] = SERIALIZERS["txt"]


def serializer(name: str) -> Callable[..., Column]:
    """The export of that name: alto, page, json, txt or text; case aside."""
    try:
        return SERIALIZERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown format: {name}") from None
