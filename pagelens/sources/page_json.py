"""Recogniser pages (JSON) as one row per page with arrays of regions and lines.

Every layout in use is read: children under ``contains``, ``regions`` or ``lines``; labels and
confidences at the top or under ``annotations``; texts as ``text_result`` or ``transcription``; boxes
as ``bbox`` or from the polygon, crop-local ones moved to page coordinates. Pages stay one row, so
page features need no shuffle; :func:`lines` and :func:`regions` explode to long tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "xmin:double,ymin:double,xmax:double,ymax:double"
LINE = f"struct<region_pos:int,text:string,score:double,seg_conf:double,{BOX},tokens:array<double>,polygon:string>"
REGION = f"struct<label:string,seg_conf:double,{BOX},n_lines:int,polygon:string>"
DETECTION = f"struct<kind:string,score:double,{BOX},polygon:string>"
PAGE_COLUMNS = f"regions array<{REGION}>, lines array<{LINE}>, detections array<{DETECTION}>, error string"


def _float(value) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def label(node: dict) -> str:
    found = node.get("segmentation_label") or (node.get("annotations") or {}).get("segmentation_label") or ""
    return str(found).lower()


def confidence(node: dict) -> float | None:
    """The member's presence decides where it is read; a value that is no number is missing."""
    if "segmentation_confidence" in node:
        return _float(node["segmentation_confidence"])
    return _float((node.get("annotations") or {}).get("segmentation_confidence"))


def polygon(value) -> list[tuple[float, float]]:
    points = []
    if isinstance(value, str):
        for part in value.replace(";", " ").split():
            xy = [_float(v) for v in part.split(",")]
            if len(xy) == 2 and None not in xy:
                points.append((xy[0], xy[1]))
    for p in value if isinstance(value, list) else ():
        xy = (p.get("x"), p.get("y")) if isinstance(p, dict) else p if isinstance(p, list) and len(p) == 2 else (None, None)
        x, y = _float(xy[0]), _float(xy[1])
        if x is not None and y is not None:
            points.append((x, y))
    return points


def box(node: dict) -> tuple[float, float, float, float] | None:
    b = node.get("bbox")
    if isinstance(b, dict):
        sides = tuple(_float(b.get(k)) for k in ("xmin", "ymin", "xmax", "ymax"))
        return None if None in sides else sides
    p = polygon(node.get("polygon"))
    return (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)) if p else None


def outline(node: dict, by: tuple[float, float] = (0.0, 0.0)) -> str:
    """The polygon as ``x,y`` tokens, moved like the box; '' without one."""
    value = node.get("polygon")
    if isinstance(value, str) and by == (0.0, 0.0):
        return value.strip()
    return " ".join(f"{x + by[0]:g},{y + by[1]:g}" for x, y in polygon(value))


def children(node: dict) -> list[dict]:
    """The child objects in the first member that has any; regions and lines side by side come regions first."""
    if node.get("contains"):
        found = node["contains"]
    else:
        found = []
        for member in ("regions", "lines"):
            value = node.get(member)
            found += value if isinstance(value, list) else [value]
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def texts(node: dict) -> tuple[list[str], float | None]:
    """All readings of a line and the confidence of the first."""
    result = node.get("text_result")
    if isinstance(result, dict):
        scores = result.get("scores") or []
        return [str(t) for t in result.get("texts") or []], _float(scores[0]) if scores else None
    found = [t for t in node.get("transcription") or [] if isinstance(t, dict)]
    return [str(t.get("text") or "") for t in found], _float(found[0].get("confidence")) if found else None


def token_scores(node: dict) -> list[float]:
    pairs = node.get("token_scores")
    if pairs is None:
        first = next((t for t in node.get("transcription") or [] if isinstance(t, dict)), {})
        pairs = first.get("token_scores")
    scores = [_float(p[1]) for p in pairs or [] if isinstance(p, (list, tuple)) and len(p) == 2]
    return [s for s in scores if s is not None and math.isfinite(s)]


def offset(parent: tuple | None, boxes: list[tuple | None]) -> tuple[float, float]:
    """How far crop-local child boxes must move: the parent's corner if strictly more of their centres then lie inside."""
    if parent is None:
        return 0.0, 0.0

    def inside(dx: float, dy: float) -> int:
        count = 0
        for b in boxes:
            if b:
                x, y = (b[0] + b[2]) / 2 + dx, (b[1] + b[3]) / 2 + dy
                count += parent[0] <= x <= parent[2] and parent[1] <= y <= parent[3]
        return count

    return (parent[0], parent[1]) if inside(parent[0], parent[1]) > inside(0.0, 0.0) else (0.0, 0.0)


def _moved(b: tuple | None, by: tuple[float, float]) -> tuple | None:
    return b and (b[0] + by[0], b[1] + by[1], b[2] + by[0], b[3] + by[1])


def _sides(b: tuple) -> dict:
    return dict(zip(("xmin", "ymin", "xmax", "ymax"), b))


def is_line(node: dict) -> bool:
    """A page line: labelled so, or with a text and no child labelled so."""
    if label(node) == "textline":
        return True
    if "lines" in node or "regions" in node and node["regions"]:
        return False
    return bool(texts(node)[0]) and not any(label(c) == "textline" for c in children(node))


def read_page(body: str) -> dict:
    """Regions, lines (page lines first, then those of regions in order) and detections of a page.

    A line needs a box. Lines of regions without any text go, page lines stay. Regions inside regions
    count as regions of the page; boxes are absolute.
    """
    page = json.loads(body)
    if not isinstance(page, dict):
        raise ValueError("page is no object")
    regions: list[dict] = []
    page_lines: list[dict] = []
    region_lines: list[dict] = []
    detections: list[dict] = []

    def add_line(node: dict, b: tuple | None, region: int | None, by: tuple[float, float]) -> None:
        if b is None:
            return
        found, score = texts(node)
        if region is not None and not any(t.strip() for t in found):
            return
        (page_lines if region is None else region_lines).append(
            {"region_pos": region, "text": found[0] if found else "", "score": score, "seg_conf": confidence(node), **_sides(b), "tokens": token_scores(node), "polygon": outline(node, by)}
        )
        if region is not None:
            regions[region]["n_lines"] += 1

    def detect(node: dict, b: tuple | None, kind: str, by: tuple[float, float]) -> None:
        if b is not None:
            score = confidence(node)
            detections.append({"kind": kind, "score": score if score is not None and math.isfinite(score) else 1.0, **_sides(b), "polygon": outline(node, by)})

    stack: list[tuple[dict, tuple[float, float]]] = [(n, (0.0, 0.0)) for n in reversed(children(page))]
    line_nodes = {id(x) for x in _listed(page, "lines")}
    while stack:
        node, by = stack.pop()
        b = _moved(box(node), by)
        if id(node) in line_nodes or is_line(node):
            add_line(node, b, None, by)
            detect(node, b, "line", by)
            continue
        if b is None:
            continue
        me = len(regions)
        regions.append({"label": label(node), "seg_conf": confidence(node), **_sides(b), "n_lines": 0, "polygon": outline(node, by)})
        detect(node, b, "region", by)
        inner = children(node)
        direct = {id(x) for x in _listed(node, "lines")}
        move = offset(b, [_moved(box(c), by) for c in inner])
        below = (by[0] + move[0], by[1] + move[1])
        nested = []
        for c in inner:
            if id(c) in direct or label(c) in ("textline", "") and not children(c):
                add_line(c, _moved(box(c), below), me, below)
                detect(c, _moved(box(c), below), "line", below)
            else:
                nested.append((c, below))
        stack += reversed(nested)
    return {"regions": regions, "lines": page_lines + region_lines, "detections": detections, "error": None}


def _listed(node: dict, member: str) -> list:
    value = node.get(member)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def pages(bodies: DataFrame, key: str = "page_no", body: str = "body") -> DataFrame:
    """One row per page: the key, regions, lines, detections, and error (null if the page could be read).

    ``bodies`` has the key (repeated rows count once) and the JSON text; other columns are ignored. An
    unreadable page keeps its row with null arrays and the message, it never fails the job.
    """
    kind = dict(bodies.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    if text is None:
                        raise ValueError("no body")
                    rows.append(read_page(text))
                except Exception as e:
                    rows.append({"regions": None, "lines": None, "detections": None, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in _SCHEMA)], names=[key, *(f.name for f in _SCHEMA)])

    return bodies.select(key, body).dropDuplicates([key]).mapInArrow(run, f"{key} {kind}, {PAGE_COLUMNS}")


_BOX_FIELDS = [(n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax")]
_SCHEMA = [
    pa.field("regions", pa.list_(pa.struct([("label", pa.string()), ("seg_conf", pa.float64()), *_BOX_FIELDS, ("n_lines", pa.int32()), ("polygon", pa.string())]))),
    pa.field("lines", pa.list_(pa.struct([("region_pos", pa.int32()), ("text", pa.string()), ("score", pa.float64()), ("seg_conf", pa.float64()), *_BOX_FIELDS, ("tokens", pa.list_(pa.float64())), ("polygon", pa.string())]))),
    pa.field("detections", pa.list_(pa.struct([("kind", pa.string()), ("score", pa.float64()), *_BOX_FIELDS, ("polygon", pa.string())]))),
    pa.field("error", pa.string()),
]


def lines(page_rows: DataFrame, key: str = "page_no") -> DataFrame:
    """Long table of lines: key, line_pos and the line's fields."""
    return page_rows.filter("error IS NULL").select(key, F.posexplode("lines").alias("line_pos", "x")).select(key, "line_pos", "x.*")


def regions(page_rows: DataFrame, key: str = "page_no") -> DataFrame:
    return page_rows.filter("error IS NULL").select(key, F.posexplode("regions").alias("region_pos", "x")).select(key, "region_pos", "x.*")


def errors(page_rows: DataFrame, key: str = "page_no") -> DataFrame:
    """The dead letters: pages that could not be read, with the stage and message."""
    return page_rows.filter("error IS NOT NULL").select(key, F.lit("page_json").alias("stage"), F.col("error").alias("message"))
