"""Ground-truth XML (PAGE and ALTO) as one row per page: lines, line boxes, region boxes, corpus text, error."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.sources.page_json import polygon

_BOX = "xmin:double,ymin:double,xmax:double,ymax:double"
SCHEMA = f"lines array<struct<text:string,{_BOX}>>, geoms array<struct<polygon:string,{_BOX}>>, boxes array<struct<{_BOX},polygon:string>>, regions array<struct<{_BOX}>>, text string, error string"
_SIDES = ("xmin", "ymin", "xmax", "ymax")
Box = tuple[float, float, float, float]


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _children(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e if _name(x) == name)


def _around(points: list[tuple[float, float]]) -> Box | None:
    return (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)) if points else None


def _coords(e: ET.Element, deep: bool = False) -> tuple[str, Box | None]:
    found = next(_all(e, "Coords") if deep else _children(e, "Coords"), None)
    raw = found.get("points", "") if found is not None else ""
    return raw, _around(polygon(raw))


def _confidence(e: ET.Element) -> float:
    try:
        return float(e.get("conf", "1.0"))
    except ValueError:
        return 1.0


def _unicode(e: ET.Element) -> str:
    found = next(_all(e, "Unicode"), None)
    return ((found.text if found is not None else "") or "").strip()


def page_line_text(line: ET.Element) -> str:
    """The reading with the highest confidence (the first of equals), else its words', else any text."""
    readings = list(_children(line, "TextEquiv"))
    if readings:
        return _unicode(max(readings, key=_confidence))
    words = [_unicode(t) for w in _children(line, "Word") for t in [next(_children(w, "TextEquiv"), None)] if t is not None]
    if any(words):
        return " ".join(w for w in words if w)
    return _unicode(line)


def alto_box(e: ET.Element) -> Box | None:
    try:
        x, y, w, h = (float(e.get(k)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
    except (TypeError, ValueError):
        return None
    return x, y, x + w, y + h


def _union(boxes: list[Box]) -> Box | None:
    return _around([(b[0], b[1]) for b in boxes] + [(b[2], b[3]) for b in boxes])


def alto_text(root: ET.Element) -> str:
    """Running text of a page: broken words put together at their first part, marks of breaks left out, empty lines dropped."""
    out = []
    for line in _all(root, "TextLine"):
        parts = []
        for e in line:
            if _name(e) == "SP":
                parts.append(" ")
            elif _name(e) == "String":
                kind = e.get("SUBS_TYPE")
                if kind != "HypPart2":
                    parts.append((kind == "HypPart1" and e.get("SUBS_CONTENT")) or e.get("CONTENT", ""))
        text = " ".join("".join(parts).split())
        if text:
            out.append(text)
    return "\n".join(out)


def _row(text: str, b: Box | None, name: str = "text") -> dict:
    return {name: text, **dict(zip(_SIDES, b or (None,) * 4))}


def read_xml(body: str | bytes) -> dict:
    """All of a page. Malformed XML raises ParseError.

    ALTO lines without text are no text lines, but they are geometries; PAGE lines always are both.
    """
    root = ET.fromstring(body)
    lines, geoms, regions = [], [], []
    if "alto" in root.tag.lower():
        for line in _all(root, "TextLine"):
            strings = list(_children(line, "String"))
            b = _union([x for x in map(alto_box, strings) if x])
            content = " ".join(w for w in (s.get("SUBS_CONTENT") or s.get("CONTENT") or "" for s in strings) if w).strip()
            geoms.append(_row("", b or alto_box(line), "polygon"))
            if content:
                lines.append(_row(content, b))
        for kind in ("TextBlock", "ComposedBlock"):
            regions += [b for b in map(alto_box, _all(root, kind)) if b]
        text = alto_text(root)
    else:
        for line in _all(root, "TextLine"):
            raw, b = _coords(line)
            geoms.append(_row(raw, b, "polygon"))
            lines.append(_row(page_line_text(line), b))
        regions = [b for b in (_coords(r, deep=True)[1] for r in _all(root, "TextRegion")) if b]
        text = "\n".join(x["text"] for x in lines if x["text"])
    boxes = [{k: g[k] for k in (*_SIDES, "polygon")} for g in geoms if g["xmin"] is not None]
    return {"lines": lines, "geoms": geoms, "boxes": boxes, "regions": [dict(zip(_SIDES, b)) for b in regions], "text": text, "error": None}


_F = [(n, pa.float64()) for n in _SIDES]
_ARROW = [
    pa.field("lines", pa.list_(pa.struct([("text", pa.string()), *_F]))),
    pa.field("geoms", pa.list_(pa.struct([("polygon", pa.string()), *_F]))),
    pa.field("boxes", pa.list_(pa.struct([*_F, ("polygon", pa.string())]))),
    pa.field("regions", pa.list_(pa.struct(_F))),
    pa.field("text", pa.string()),
    pa.field("error", pa.string()),
]


def pages(files: DataFrame, key: str = "stem", body: str = "content") -> DataFrame:
    """One row per file: key, lines, geoms, boxes, regions, text, error (the message of XML that cannot be read; the rest is null then)."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    rows.append(read_xml(content or b""))
                except Exception as e:
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW)], names=[key, *(f.name for f in _ARROW)])

    return files.select(key, body).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def errors(page_rows: DataFrame, key: str = "stem") -> DataFrame:
    return page_rows.filter("error IS NOT NULL").select(key, F.lit("ground_truth").alias("stage"), F.col("error").alias("message"))
