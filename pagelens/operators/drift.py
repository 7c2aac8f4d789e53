"""Schema drift between the exports of a stream: fingerprints, changes, and one consistent table.

Each export (file) of a stream gets a layout: its field paths with their JSON types. A layout has a
fingerprint, and exports in a row with one fingerprint form a version. Layouts of consecutive exports
are compared, and every difference becomes an explicit migration step (added, removed, renamed,
retyped). Chained renames within a stream and known synonyms route every path of every version to one
column, to which cast and default rules then apply; other paths get columns of their own. Bodies are
parsed to VARIANT once and never leave the JVM; Python sees paths only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.runtime import collect_small, discard, durable

#: Share of the lines found in both exports, with a value on both sides, that must carry the same value in a rename.
RENAME_AGREEMENT = 0.9

#: Canonical columns of the unified table, with the path that seeds each and the type it is cast to.
CANONICAL = {
    "label": ("segmentation_label", "string"),
    "confidence": ("segmentation_confidence", "double"),
    "text": ("text", "string"),
    "polygon": ("polygon", "string"),
    "hand": ("annotations.hand", "string"),
    "rotation": ("annotations.rotation", "double"),
    "is_marginal": ("is_marginal", "string"),
    "script": ("script", "string"),
    "language": ("language", "string"),
    "tags": ("tags", "string"),
    "model": ("model_name", "string"),
}

#: Other spellings of a column's path, for streams that never show the rename.
SYNONYMS = {
    "label": ("segmentationLabel", "seg_label", "class_name", "annotations.segmentation_label", "annotations.kind"),
    "confidence": ("segmentationConfidence", "seg_conf", "det_score", "annotations.segmentation_confidence", "annotations.score"),
    "text": ("content", "transcript"),
    "polygon": ("coords", "points"),
    "hand": ("writer_hand",),
    "rotation": ("rotation_deg",),
    "is_marginal": ("annotations.marginal",),
    "script": ("annotations.script",),
    "language": ("annotations.language",),
    "tags": ("annotations.tags",),
    "model": ("pipeline.model",),
}

#: Levels of objects that fields are followed through; deeper ones are an error.
MAX_DEPTH = 64

#: Columns of the unified table besides the canonical ones, and members that are objects: names too.
MAX_COLUMNS = 10_000

_ROUTE = pa.schema([("stream_no", pa.int64()), ("version", pa.int64()), ("path", pa.string()), ("target", pa.string()), ("rule", pa.string())])


def records(exports: DataFrame) -> DataFrame:
    """Each record once (json_no is the key), with its body as VARIANT in column v; malformed bodies give null."""
    return (
        exports.select("json_no", "stream_no", "export_no", "body")
        .dropDuplicates(["json_no"])
        .select("json_no", "stream_no", "export_no", F.try_parse_json("body").alias("v"))
    )


def fields(recs: DataFrame, line_member: str = "line_ref", depth: int | None = 2, arrays: bool = False, split_numbers: bool = False) -> DataFrame:
    """One row per non-null field of each record: stream_no, export_no, line, path, jtype, val (a hash of the value).

    Fields are the members of the body and, down to ``depth`` levels (None: all), the members of object
    members as ``member.sub``. An object is kept as a row of type object without a value, so that its
    replacement by another type shows. With ``arrays`` the objects in arrays are entered too, as ``member[].sub``;
    line then also names the element. With ``split_numbers`` whole and other numbers are two types.
    """
    spark = recs.sparkSession
    number = "WHEN t = 'BIGINT' THEN 'integer' ELSE 'number'" if split_numbers else "ELSE 'number'"
    kind = (
        "CASE WHEN t LIKE 'OBJECT%' THEN 'object' WHEN t LIKE 'ARRAY%' THEN 'array' WHEN t = 'BOOLEAN' THEN 'boolean'"
        f" WHEN t = 'STRING' THEN 'string' WHEN t = 'VOID' THEN NULL {number} END"
    )
    level = spark.sql(
        f"""
        SELECT stream_no, export_no, try_variant_get(v, '$.{line_member}', 'string') AS line, m.key AS path, m.value AS value, schema_of_variant(m.value) AS t
        FROM {{recs}}, LATERAL variant_explode(v) m
        """,
        recs=recs,
    ).withColumn("jtype", F.expr(kind))
    found, below = level, level
    for n in range(2, (depth or MAX_DEPTH + 1) + 1):
        if depth is None:
            if n > MAX_DEPTH:
                raise ValueError(f"fields nest over {MAX_DEPTH} levels deep")
            below = durable(below.filter("jtype = 'object' OR jtype = 'array'"), "nested")
            if below.isEmpty():
                break
        inside = "SELECT stream_no, export_no, line, concat(path, '.', m.key) AS path, m.value AS value, schema_of_variant(m.value) AS t FROM {b}, LATERAL variant_explode(value) m WHERE jtype = 'object'"
        if arrays:
            inside += """ UNION ALL SELECT stream_no, export_no, concat_ws('#', coalesce(line, ''), e.pos) AS line, concat(path, '[].', m.key) AS path, m.value AS value, schema_of_variant(m.value) AS t
                FROM {b}, LATERAL variant_explode(value) e, LATERAL variant_explode(CASE WHEN schema_of_variant(e.value) LIKE 'OBJECT%' THEN e.value END) m WHERE jtype = 'array'"""
        below = spark.sql(inside, b=below).withColumn("jtype", F.expr(kind))
        found = found.unionByName(below)
    return found.filter(F.col("jtype").isNotNull()).select(
        "stream_no", "export_no", "line", "path", "jtype", F.when(F.col("jtype") != "object", F.xxhash64(F.to_json("value"))).alias("val")
    )


def layouts(field_rows: DataFrame) -> DataFrame:
    """Per stream, export and path the JSON type of most of its values (ties: the first by name)."""
    counted = field_rows.groupBy("stream_no", "export_no", "path", "jtype").agg(F.count("*").alias("n"))
    return counted.groupBy("stream_no", "export_no", "path").agg(
        F.expr("min_by(jtype, struct(-n, jtype))").alias("jtype"), F.sum("n").alias("n_values")
    )


def fingerprints(exports: DataFrame, layout: DataFrame) -> DataFrame:
    """Per export its layout fingerprint, the number of the layout version within the stream, and the export before.

    An export without any readable field has a fingerprint of the empty layout.
    """
    prints = layout.groupBy("stream_no", "export_no").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "path", "jtype"))), ","), 256).alias("fingerprint")
    )
    order = Window.partitionBy("stream_no").orderBy("export_no")
    return (
        exports.select("stream_no", "export_no")
        .distinct()
        .join(prints, ["stream_no", "export_no"], "left")
        .withColumn("fingerprint", F.coalesce("fingerprint", F.sha2(F.lit(""), 256)))
        .withColumn("prev_export_no", F.lag("export_no").over(order))
        .withColumn("is_new", (F.col("fingerprint") != F.coalesce(F.lag("fingerprint").over(order), F.lit(""))).cast("int"))
        .withColumn("version", F.sum("is_new").over(order))
        .drop("is_new")
    )


def changes(exports: DataFrame, line_member: str = "line_ref", depth: int | None = 2, arrays: bool = False, split_numbers: bool = False) -> DataFrame:
    """Every change of a stream's layout from one export to the next.

    ``exports`` has json_no, stream_no, export_no and body; further columns are ignored, repeated
    json_no count once. Options are those of :func:`fields`. Result: stream_no, export_no, drift_kind,
    old_path, new_path, old_type, new_type. Null streams or exports form no sequence and give no rows;
    so do an empty table and a stream with one export. A removed path that agrees with several added
    ones goes to the pair with most agreeing lines (ties by path). When an object or an array that is
    entered becomes something else, or the reverse, what lies below it is not reported.
    """
    recs = records(exports.filter(F.col("stream_no").isNotNull() & F.col("export_no").isNotNull()))
    rows = durable(fields(recs, line_member, depth, arrays, split_numbers), "fields")
    layout = durable(layouts(rows), "layouts")
    order = Window.partitionBy("stream_no").orderBy("export_no")
    # Exports without any field are exports too.
    every = exports.filter("stream_no IS NOT NULL AND export_no IS NOT NULL").select("stream_no", "export_no").distinct()
    steps = durable(every.withColumn("prev_export_no", F.lag("export_no").over(order)).filter("prev_export_no IS NOT NULL"), "steps")
    old = (
        layout.select("stream_no", F.col("export_no").alias("prev_export_no"), "path", F.col("jtype").alias("old_type"))
        .join(steps, ["stream_no", "prev_export_no"])
        .select("stream_no", "export_no", "path", "old_type")
    )
    new = layout.select("stream_no", "export_no", "path", F.col("jtype").alias("new_type")).join(
        steps.select("stream_no", "export_no"), ["stream_no", "export_no"]
    )
    both = durable(old.join(new, ["stream_no", "export_no", "path"], "full"), "compared")
    retyped = both.filter("old_type <> new_type")
    swapped = retyped.filter("old_type = 'object' OR new_type = 'object'" + (" OR old_type = 'array' OR new_type = 'array'" if arrays else ""))
    # Every path that one lies below: a.b[].c lies below a.b[], a.b and a.
    above = F.expr("explode(transform(sequence(1, greatest(size(split(path, '[.]')) - 1, 1)), n -> regexp_replace(substring_index(path, '.', n), '(\\\\[\\\\])+$', '')))")
    loose = both.filter("(old_type IS NULL OR new_type IS NULL) AND coalesce(old_type, new_type) <> 'object'")
    covered = (
        loose.filter(F.col("path").contains(".")).select("stream_no", "export_no", "path", above.alias("parent"))
        .join(swapped.select("stream_no", "export_no", F.col("path").alias("parent")), ["stream_no", "export_no", "parent"], "left_semi")
        .select("stream_no", "export_no", "path")
    )
    loose = loose.join(covered, ["stream_no", "export_no", "path"], "left_anti")
    removed = loose.filter("new_type IS NULL").select("stream_no", "export_no", F.col("path").alias("old_path"), "old_type")
    added = loose.filter("old_type IS NULL").select("stream_no", "export_no", F.col("path").alias("new_path"), "new_type")
    pairs = durable(removed.join(added, ["stream_no", "export_no"]).filter("old_type = new_type").join(steps, ["stream_no", "export_no"]), "pairs")
    # Only values of paths that may have been renamed move, as hashes and keyed by line, so no export is one key.
    gone_values = rows.join(
        pairs.select("stream_no", F.col("prev_export_no").alias("export_no"), F.col("old_path").alias("path"), F.col("export_no").alias("step")).distinct(), ["stream_no", "export_no", "path"]
    ).select("stream_no", F.col("step").alias("export_no"), "line", F.col("path").alias("old_path"), F.col("val").alias("old_val"))
    new_values = rows.join(pairs.select("stream_no", "export_no", F.col("new_path").alias("path")).distinct(), ["stream_no", "export_no", "path"], "left_semi").select(
        "stream_no", "export_no", "line", F.col("path").alias("new_path"), F.col("val").alias("new_val")
    )
    agreed = (
        gone_values.join(new_values, ["stream_no", "export_no", "line"])
        .groupBy("stream_no", "export_no", "old_path", "new_path")
        .agg(F.count("*").alias("n"), F.count_if(F.col("old_val") == F.col("new_val")).alias("same"))
        .filter(F.col("same") >= RENAME_AGREEMENT * F.col("n"))
        .filter("same > 0")
        .join(pairs, ["stream_no", "export_no", "old_path", "new_path"], "left_semi")
    )
    # Mutual best pairs: each path of a step takes part in at most one rename.
    by_old = Window.partitionBy("stream_no", "export_no", "old_path").orderBy(F.desc("same"), "new_path")
    by_new = Window.partitionBy("stream_no", "export_no", "new_path").orderBy(F.desc("same"), "old_path")
    renamed = (
        agreed.withColumn("ro", F.row_number().over(by_old)).withColumn("rn", F.row_number().over(by_new)).filter("ro = 1 AND rn = 1")
        .join(removed, ["stream_no", "export_no", "old_path"])
        .select("stream_no", "export_no", F.lit("renamed").alias("drift_kind"), "old_path", "new_path", "old_type", F.col("old_type").alias("new_type"))
    )
    renamed = durable(renamed, "renamed")
    gone = removed.join(renamed.select("stream_no", "export_no", "old_path"), ["stream_no", "export_no", "old_path"], "left_anti")
    come = added.join(renamed.select("stream_no", "export_no", "new_path"), ["stream_no", "export_no", "new_path"], "left_anti")
    none = F.lit(None).cast("string")
    done = durable(
        renamed.unionByName(
            gone.select("stream_no", "export_no", F.lit("removed").alias("drift_kind"), "old_path", F.lit("").alias("new_path"), "old_type", none.alias("new_type"))
        )
        .unionByName(
            come.select("stream_no", "export_no", F.lit("added").alias("drift_kind"), F.lit("").alias("old_path"), "new_path", none.alias("old_type"), "new_type")
        )
        .unionByName(
            retyped.select("stream_no", "export_no", F.lit("retyped").alias("drift_kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), "old_type", "new_type")
        ),
        "changes",
    )
    for used in (rows, layout, both, pairs, renamed, steps):
        discard(used)
    return done


def _values(recs: DataFrame) -> DataFrame:
    """json_no, stream_no, export_no, path and text of every non-null value of the records.

    A member that is an object in any record is also read as one where it is JSON text of an object or
    an array of name/value pairs with distinct names; any other value of it stays a value of the member.
    """
    spark = recs.sparkSession
    top = spark.sql("SELECT json_no, stream_no, export_no, m.key AS key, m.value AS value, schema_of_variant(m.value) AS t FROM {recs}, LATERAL variant_explode(v) m", recs=recs)
    top = durable(top.filter("t <> 'VOID' AND (key <> 'line_ref' OR t LIKE 'OBJECT%' OR t LIKE 'ARRAY%')"), "members")
    keys = [r[0] for r in collect_small(top.filter("t LIKE 'OBJECT%'").select("key").distinct(), MAX_COLUMNS, "object members")]
    pairs = "from_json(to_json(value), 'array<struct<name:string,value:string>>')"
    read = f"""CASE WHEN t LIKE 'OBJECT%' THEN value
        WHEN NOT known THEN NULL
        WHEN t = 'STRING' THEN try_parse_json(try_variant_get(value, '$', 'string'))
        WHEN t RLIKE '^ARRAY<OBJECT<name: STRING, value: [^:]*>>$' AND forall({pairs}, e -> e.name IS NOT NULL)
             AND size(array_distinct(transform({pairs}, e -> e.name))) = size({pairs})
        THEN try_parse_json(to_json(map_from_entries({pairs}))) END"""
    top = top.withColumn("known", F.col("key").isin(keys)).withColumn("o", F.expr(read)).withColumn("o", F.when(F.expr("schema_of_variant(o) LIKE 'OBJECT%'"), F.col("o")))
    sub = spark.sql("SELECT json_no, stream_no, export_no, concat(head, '.', m.key) AS path, m.value AS value FROM {top}, LATERAL variant_explode(o) m", top=top.filter("o IS NOT NULL").select("json_no", "stream_no", "export_no", F.col("key").alias("head"), "o"))
    flat = top.filter("o IS NULL").select("json_no", "stream_no", "export_no", F.col("key").alias("path"), "value").unionByName(sub)
    return flat.filter("schema_of_variant(value) <> 'VOID'").select(
        "json_no", "stream_no", "export_no", "path", F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), F.to_json("value")).alias("text")
    )


def route(steps: list[tuple[int | None, str | None, str]], known: dict[str, tuple[int, str, str]]) -> list[tuple[int | None, str, str, str]]:
    """Column of every path of every version of one stream: version, path, target, rule.

    ``steps`` are (version, old_path, path): each path seen in a version with old_path null, and each
    rename. ``known`` gives for a path (rank, column, rule). A field keeps its column over versions and
    renames. Of several fields that stand side by side and belong to one column the first by rank and
    name gets it; the others, and fields without a known name, get ``.`` and their first path.
    """
    seen: dict[int | None, set[str]] = {}
    renames: dict[int | None, dict[str, str]] = {}
    for version, old, path in steps:
        if old is None:
            seen.setdefault(version, set()).add(path)
        else:
            renames.setdefault(version, {})[path] = old
    names: list[list[str]] = []
    where: list[set[tuple[int | None, str]]] = []
    now: dict[str, int] = {}
    for version in sorted(seen, key=lambda e: (e is None, e)):
        moved = {new: now[old] for new, old in renames.get(version, {}).items() if old in now}
        for old in renames.get(version, {}).values():
            now.pop(old, None)
        now |= moved
        for path in sorted(seen[version]):
            if path not in now:
                now[path] = len(names)
                names.append([])
                where.append(set())
            field = now[path]
            if path not in names[field]:
                names[field].append(path)
            where[field].add((version, path))
    plans = []
    for field, paths in enumerate(names):
        found = [(known[p][0], i, *known[p][1:]) for i, p in enumerate(paths) if p in known]
        rank, i, column, rule = min(found) if found else (9, 0, "." + paths[0], "own")
        plans.append((rank, paths[0], field, column, "renamed" if i else rule))
    taken: dict[str, set[int | None]] = {}
    result = []
    for _, first, field, column, rule in sorted(plans):
        at = {e for e, _ in where[field]}
        target, n = column, 1
        while taken.get(target, set()) & at:
            target, rule = f".{first}" + (f".{n}" if n > 1 else ""), "own"
            n += 1
        taken.setdefault(target, set()).update(at)
        result += [(e, p, target, rule) for e, p in where[field]]
    return result


def routes(values: DataFrame, change_rows: DataFrame, versions: DataFrame, canonical: dict[str, tuple[str, str]] = CANONICAL) -> DataFrame:
    """The explicit migration steps of every version of every stream: stream_no, version, path, target, rule.

    ``values`` are the records' paths (:func:`_values`), ``versions`` come from :func:`fingerprints`.
    Rules: ``seed`` (the column's own path), ``renamed`` (by chained renames of the stream), ``synonym``
    (:data:`SYNONYMS`), ``own`` (target is ``.`` and a path). A rename counts in its own stream only.
    """
    known = {p: (2, name, "synonym") for name in canonical for p in SYNONYMS.get(name, ())}
    known |= {seed: (1, name, "seed") for name, (seed, _) in canonical.items()}
    none = F.lit(None).cast("string")
    seen = values.groupBy("stream_no", "version", "path").agg(none.alias("old_path")).select("stream_no", "version", "old_path", "path")
    renames = change_rows.filter("drift_kind = 'renamed'").join(versions.select("stream_no", "export_no", "version"), ["stream_no", "export_no"]).select(
        "stream_no", "version", "old_path", F.col("new_path").alias("path")
    )
    kinds = "stream_no long, version long, path string, target string, rule string"

    def run(part: pa.Table) -> pa.Table:
        stream = part.column("stream_no")[0].as_py()
        found = route(list(zip(*(part.column(c).to_pylist() for c in ("version", "old_path", "path")))), known)
        return pa.Table.from_pylist([dict(zip(_ROUTE.names, (stream, *r))) for r in found], _ROUTE)

    # Paths and renames of one stream: a property of its layouts, not of its records.
    return seen.unionByName(renames).groupBy("stream_no").applyInArrow(run, kinds)


def unified(exports: DataFrame, change_rows: DataFrame, canonical: dict[str, tuple[str, str]] = CANONICAL) -> DataFrame:
    """All records as one table with one set of columns: keys, line_ref, the canonical columns, and one for every other path.

    Each record goes through the steps of its export's version (:func:`fingerprints`, :func:`routes`).
    Rules per record: *rename* – each value goes to the column its path has in that version of that
    stream; *cast* – to the column's type, null where that fails; *default* – null where the path has
    no value. Objects stored as JSON text or as arrays of name/value objects are read like the object
    they stand for. Other paths give string columns named by the path, ``.`` as ``__``, numbered where
    such a name is in use. Records with a malformed body keep their keys with nulls.
    """
    recs = durable(records(exports), "records")
    versions = durable(fingerprints(recs, layouts(fields(recs))).select("stream_no", "export_no", "version"), "versions")
    v = versions.select(F.col("stream_no").alias("s"), F.col("export_no").alias("e"), "version")
    values = durable(
        _values(recs).join(v, F.col("stream_no").eqNullSafe(F.col("s")) & F.col("export_no").eqNullSafe(F.col("e"))).drop("s", "e"), "values"
    )
    steps = durable(routes(values, change_rows, versions, canonical), "routes")
    columns = {name: (name, kind) for name, (_, kind) in canonical.items()}
    used = {"json_no", "stream_no", "export_no", "line_ref", *(name.lower() for name in canonical)}
    for (target,) in sorted(collect_small(steps.filter("rule = 'own'").select("target").distinct(), MAX_COLUMNS, "columns")):
        base, n = target[1:].replace(".", "__"), 1
        name = base
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        columns[target] = (name, "string")
    r = steps.select(F.col("stream_no").alias("s"), F.col("version").alias("e"), F.col("path").alias("p"), "target")
    placed = values.join(r, F.col("stream_no").eqNullSafe(F.col("s")) & F.col("version").eqNullSafe(F.col("e")) & (F.col("path") == F.col("p")))
    found = placed.groupBy(F.col("json_no").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("target", "text"))).alias("m"))
    value = lambda target, kind: F.try_element_at("m", F.lit(target)).try_cast(kind)
    return recs.join(found, F.col("json_no").eqNullSafe(F.col("k")), "left").select(
        "json_no", "stream_no", "export_no", F.expr("try_variant_get(v, '$.line_ref', 'string')").alias("line_ref"), *(value(t, kind).alias(name) for t, (name, kind) in columns.items())
    )
