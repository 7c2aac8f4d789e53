"""Deeply nested page records to flat tables with Merkle subtree identities.

Every object of a page (region, line, word, polygon point, or any other nested object) is brought to a
canonical form and hashed bottom-up: its identity covers its own members and, in order, the identities
of its children. Equal objects therefore have equal identities wherever they occur. They are stored
once (:func:`objects`), and every occurrence is kept as a bridge row with its path, parent and ordinal
(:func:`bridges`). Nothing of a body is lost: what becomes no child – scalars, arrays of scalars, elements
that are no objects – is in the content of the object that holds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The members that hold child objects, with the kind and the path letter of the children.
CHILDREN = (("regions", "region", "r"), ("lines", "line", "l"), ("words", "word", "w"))
#: Kinds whose member ``polygon`` becomes points.
POLYGONS = ("line",)
#: Bridge rows of one Arrow batch.
BATCH_ROWS = 100_000

BRIDGE_SCHEMA = "page_no long, kind string, node_path string, parent_path string, ordinal int, object_id string, parent_object_id string"
_SCHEMA = pa.schema(
    [
        ("page_no", pa.int64()),
        ("kind", pa.string()),
        ("node_path", pa.string()),
        ("parent_path", pa.string()),
        ("ordinal", pa.int32()),
        ("object_id", pa.string()),
        ("parent_object_id", pa.string()),
        ("content", pa.string()),
    ]
)
_SEPARATORS = re.compile(r"[\s;]+")
_encode = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def _identity(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def polygon_points(value) -> tuple[list[tuple[int, float | None, float | None]], bool]:
    """((position, x, y) of a polygon in any of its spellings, whether the points say all of it).

    A string of ``x,y`` tokens parted by blanks or semicolons; an array of ``{"x":, "y":}`` objects,
    of ``[x, y]`` arrays or of ``x,y`` strings; or a lone point object. Null elements keep their
    position. A coordinate that is no number becomes None, the point itself stays.
    """
    points = []
    if isinstance(value, str):
        whole = True
        for i, p in enumerate(p for p in _SEPARATORS.split(value) if p):
            x, _, y = p.partition(",")
            try:
                points.append((i, float(x), float(y)))
            except ValueError:
                points.append((i, _number(x), _number(y.partition(",")[0])))
                whole = False
        return points, whole
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, list):
        return [], value is None
    whole = True
    for i, p in enumerate(value):
        if isinstance(p, dict):
            xy = (p.get("x"), p.get("y"))
            whole = whole and len(p) == 2 and "x" in p and "y" in p
        elif isinstance(p, list):
            xy = (p[0] if p else None, p[1] if len(p) > 1 else None)
            whole = whole and len(p) == 2
        elif isinstance(p, str):
            parts = p.strip().split(",")
            xy = (parts[0], parts[1] if len(parts) > 1 else None)
            whole = whole and len(parts) == 2
        else:
            whole = whole and p is None
            continue
        point = (i, _number(xy[0]), _number(xy[1]))
        whole = whole and point[1] is not None and point[2] is not None
        points.append(point)
    return points, whole


def _leftover(value):
    """What an array of child objects holds besides objects: a scalar as it is, other elements by position; None for nothing."""
    if isinstance(value, list):
        return {str(i): x for i, x in enumerate(value) if x is not None and not isinstance(x, dict)} or None
    return None if isinstance(value, dict) else value


class Walk:
    """What becomes a child: the members named in ``children``, points of ``polygons``, and with ``rest`` every other object."""

    def __init__(self, children: Sequence[tuple[str, str, str]] = CHILDREN, polygons: Sequence[str] = POLYGONS, rest: bool = False) -> None:
        self.children, self.polygons, self.rest = tuple(children), frozenset(polygons), rest
        self.named = frozenset(m for m, _, _ in children)

    def _members(self, obj: dict, kind: str) -> list[tuple[str, str, str]]:
        """(member, kind, letter) of the members of an object that hold children, the named ones first."""
        found = [c for c in self.children if c[0] in obj]
        if self.rest:
            for m in sorted(obj):
                v = obj[m]
                if m not in self.named and not (m == "polygon" and kind in self.polygons) and (isinstance(v, dict) or isinstance(v, list) and any(isinstance(x, dict) for x in v)):
                    found.append((m, m, m))
        return found

    def page(self, body: str | None, contents: bool) -> tuple[list[tuple], list[tuple]]:
        """Bridge rows of a page and, if wanted, their contents as (object_id, kind, content).

        The walk keeps its own stack, so nesting depth is limited by memory only. A body that is null
        or no JSON object gives no rows.
        """
        try:
            page = json.loads(body) if body is not None else None
        except ValueError:
            return [], []
        if not isinstance(page, dict):
            return [], []
        # Nodes in pre-order: [kind, path, parent index, ordinal, object, child identities, identity, members].
        nodes: list[list] = []
        stack: list[tuple] = [(page, "", -1, "page", 0)]
        while stack:
            obj, path, parent, kind, ordinal = stack.pop()
            me = len(nodes)
            members = self._members(obj, kind)
            nodes.append([kind, path, parent, ordinal, obj, [], None, members])
            prefix = f"{path}/" if path else ""
            for member, child, letter in reversed(members):
                value = obj[member]
                if isinstance(value, dict):
                    stack.append((value, f"{prefix}{letter}0", me, child, 0))
                elif isinstance(value, list):
                    for i in range(len(value) - 1, -1, -1):
                        if isinstance(value[i], dict):
                            stack.append((value[i], f"{prefix}{letter}{i}", me, child, i))
        points: list[tuple] = []
        found: list[tuple] = []
        for me in range(len(nodes) - 1, -1, -1):
            kind, path, parent, ordinal, obj, children, _, members = nodes[me]
            held = {m for m, _, _ in members}
            content = {k: v for k, v in obj.items() if v is not None and k not in held}
            for m in held:
                left = _leftover(obj[m])
                if left is not None:
                    content[m] = left
            children.reverse()
            if kind in self.polygons and "polygon" in content:
                corners, whole = polygon_points(content["polygon"])
                if whole:
                    del content["polygon"]
                children.append("|")
                for k, (i, x, y) in enumerate(corners):
                    text = f'{{"x":{"null" if x is None else repr(x)},"y":{"null" if y is None else repr(y)}}}'
                    oid = blake2b(f"point{text}".encode(), digest_size=16).hexdigest()
                    children.append(oid if i == k else f"{i}:{oid}")
                    points.append((f"{path}/p{i}", i, oid, me))
                    if contents:
                        found.append((oid, "point", text))
            said = _encode(content)
            nodes[me][6] = oid = _identity(f"{kind}{said}[{','.join(children)}]")
            if contents and parent >= 0:
                found.append((oid, kind, said))
            if parent >= 0:
                nodes[parent][5].append(f"{kind}{ordinal}:{oid}")
        rows = [(kind, path, nodes[parent][1], ordinal, oid, nodes[parent][6]) for kind, path, parent, ordinal, _, _, oid, _ in nodes[1:]]
        rows += [("point", path, nodes[parent][1], i, oid, nodes[parent][6]) for path, i, oid, parent in points]
        return rows, found


def _over(pages: DataFrame, walk: Walk, contents: bool, schema: str, rows_of: Callable[[int | None, list, list], list]) -> DataFrame:
    """Rows made from each page once, in Arrow batches."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    arrow = pa.schema([_SCHEMA.field(n) if n in _SCHEMA.names else pa.field(n, pa.int64()) for n in names])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for page_no, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += rows_of(page_no, *walk.page(body, contents))
                if len(out) >= BATCH_ROWS:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return pages.select("page_no", "body").dropDuplicates(["page_no"]).mapInArrow(run, schema)


def bridges(pages: DataFrame, children: Sequence[tuple[str, str, str]] = CHILDREN, polygons: Sequence[str] = POLYGONS, rest: bool = False) -> DataFrame:
    """One row per occurrence of a nested object or polygon point.

    ``pages`` has ``page_no`` and ``body``; other columns are ignored. Rows with the same page_no are
    re-deliveries and count once. Null or malformed bodies, empty objects and an empty table give no
    rows. Columns: page_no, kind, node_path, parent_path ('' at the top), ordinal (position in its
    array), object_id, parent_object_id (the page's own identity at the top). ``children`` names the
    members that are walked, with kind and path letter; with ``rest`` every other member that is an object or
    an array with objects is walked too, with its name as kind and letter. Points are made of the
    polygons of the kinds ``polygons``.
    """
    return _over(pages, Walk(children, polygons, rest), False, BRIDGE_SCHEMA, lambda page_no, rows, _: [(page_no, *r) for r in rows])


def objects(pages: DataFrame, children: Sequence[tuple[str, str, str]] = CHILDREN, polygons: Sequence[str] = POLYGONS, rest: bool = False) -> DataFrame:
    """Each distinct object once: object_id, kind, content and how often it occurs (n_occurrences).

    Takes the pages and options of :func:`bridges`. content is canonical JSON of the members that became no
    children; a polygon whose points don't say all of it stays there as well. Occurrences combine per
    page and before the shuffle.
    """

    def counted(_: int | None, __: list, found: list) -> list:
        times: dict[tuple, int] = {}
        for f in found:
            times[f] = times.get(f, 0) + 1
        return [(*f, n) for f, n in times.items()]

    rows = _over(pages, Walk(children, polygons, rest), True, "object_id string, kind string, content string, n_occurrences long", counted)
    return rows.groupBy("object_id", "kind", "content").agg(F.sum("n_occurrences").alias("n_occurrences"))


def flat_table(pages: DataFrame, kind: str, fields: dict[str, str], children: Sequence[tuple[str, str, str]] = CHILDREN, polygons: Sequence[str] = POLYGONS, rest: bool = False) -> DataFrame:
    """The flat table of one kind: page, path and parent link, plus ``fields`` ({column: JSON path}) read as text.

    Takes the pages and options of :func:`bridges`; made in one walk, without joining objects and bridges.
    """

    def read(page_no: int | None, rows: list, found: list) -> list:
        content = {oid: said for oid, k, said in found if k == kind}
        return [(page_no, *r, content[r[4]]) for r in rows if r[0] == kind]

    rows = _over(pages, Walk(children, polygons, rest), True, f"{BRIDGE_SCHEMA}, content string", read)
    return rows.select(
        "page_no", "node_path", "parent_path", "ordinal", "object_id", "parent_object_id", *(F.get_json_object("content", path).alias(name) for name, path in fields.items())
    )
