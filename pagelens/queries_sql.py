"""SQL (DuckDB) with the same result as the core query of that name."""

from __future__ import annotations

from pagelens.functions.stats import BIN_QUANTILES, linspace
from pagelens.queries import _BOXES, _LINES, _SIDES, _TRAIN, FEATURES


def _hist() -> str:
    edges = linspace(0.0, 1.0, 10)
    n = "count(*) FILTER (WHERE v >= 0 AND v <= 1)"
    cols = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        op = "<=" if i == 9 else "<"
        cols.append(f"CASE WHEN {n} > 0 THEN round(count(*) FILTER (WHERE v >= {a!r} AND v {op} {b!r}) / {n}, 9) ELSE 0.0 END AS htr_hist_bin_{i}")
    return f"SELECT dataset_tag, {', '.join(cols)} FROM (SELECT DISTINCT line_no, dataset_tag, CASE WHEN isfinite(htr_score) THEN htr_score END AS v FROM text_lines) GROUP BY dataset_tag"


def _stats(x: str, prefix: str, digits: int = 9, std_digits: int = 9) -> str:
    return (
        f"round(avg({x}), {digits}) AS {prefix}_mean, round(stddev_pop({x}), {std_digits}) AS {prefix}_std, round(min({x}), {digits}) AS {prefix}_min,"
        f" round(max({x}), {digits}) AS {prefix}_max, CASE WHEN avg({x}) <> 0 THEN round(stddev_pop({x}) / avg({x}), 9) END AS {prefix}_cv"
    )


_GRAMS = "SELECT {key}, substr(t, CAST(i AS BIGINT), {n}) AS gram FROM (SELECT {key}, {text} AS t FROM {src}), LATERAL (SELECT unnest(range(1, length(t) - {n} + 2)) AS i)"
#: White space as :data:`pagelens.functions.text.SPACE` has it.
_SPACE = "[\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]+"
_COLLAPSED = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_INTER = "greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
_AREA = "({0}.xmax - {0}.xmin) * ({0}.ymax - {0}.ymin)"
_OVERLAP = "a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax"


def _coded(text: str) -> str:
    """A text with each character of its pair of texts as one byte, since DuckDB's edit distance counts bytes."""
    bytes_ = "".join(chr(c) for c in range(33, 127) if chr(c) != "'") + "".join(chr(c) for c in range(1, 33))
    return f"CASE WHEN chars IS NULL THEN {text} ELSE translate({text}, chars, substr('{bytes_}', 1, length(chars))) END"


# --- pages made of the scanned lines ------------------------------------------------------------------

_MADE = f"""raw AS (SELECT DISTINCT line_no, rec_no, line_pos, coalesce(text, '') AS text, CASE WHEN isfinite(htr_score) THEN htr_score END AS hs, CASE WHEN isfinite(line_conf) THEN line_conf END AS lc,
  CASE WHEN isfinite(region_conf) THEN region_conf END AS rc FROM text_lines),
L0 AS (SELECT *, line_pos // 10 AS reg, CAST((line_pos % 10) * 10 AS DOUBLE) AS x0, CAST(line_pos * 25 + line_no % 7 AS DOUBLE) AS y0, length(text) AS chars,
  CASE WHEN {_COLLAPSED} = '' THEN 0 ELSE len(string_split({_COLLAPSED}, ' ')) END AS words FROM raw),
L AS (SELECT *, x0 + 9 * chars + 1 AS x1, y0 + 20 + line_no % 11 AS y1, y0 + (20 + line_no % 11) / 2.0::DOUBLE AS cy FROM L0),
R AS (SELECT rec_no, reg, count(*) AS n, max(rc) AS rc, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum((x1 - x0) * (y1 - y0)) AS la, sum(y1 - y0) AS lh,
  stddev_pop(x0) AS sx0, stddev_pop(x1) AS sx1, stddev_pop((x0 + x1) / 2) AS sxc FROM L GROUP BY 1, 2)"""

_STATS = ("mean", "std", "min", "max", "cv")


def feature_digits(column: str) -> int:
    """Digits that are sure and hold no ties: confidences have six, so a mean of 2**k of them has k more; deviations of large values have fewer."""
    confidence = ("conf" in column or "score" in column) and "hist" not in column
    if column.endswith(("_cv", "_entropy", "_std_mean")):
        return 6
    if column.endswith("_std"):
        return 8 if confidence else 6
    return 11 if confidence else 9


def _five(x: str, prefix: str) -> str:
    mean, std = feature_digits(f"{prefix}_mean"), feature_digits(f"{prefix}_std")
    return (
        f"round(avg({x}), {mean}) AS {prefix}_mean, round(stddev_pop({x}), {std}) AS {prefix}_std, round(min({x}), 9) AS {prefix}_min, round(max({x}), 9) AS {prefix}_max,"
        f" round(CASE WHEN avg({x}) <> 0 THEN stddev_pop({x}) / avg({x}) END, 6) AS {prefix}_cv"
    )


def _ten(x: str, prefix: str) -> str:
    edges = linspace(0.0, 1.0, 10)
    n = f"count(*) FILTER (WHERE {x} >= 0 AND {x} <= 1)"
    return ", ".join(
        f"CASE WHEN {n} > 0 THEN round(count(*) FILTER (WHERE {x} >= {a!r} AND {x} {'<=' if i == 9 else '<'} {b!r}) / {n}, 9) ELSE 0.0 END AS {prefix}_hist_bin_{i}"
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    )


def _entropy(table: str, x: str, name: str) -> str:
    """Entropy of a column shifted to minimum 0, per page."""
    return (
        f"(SELECT rec_no, round(CASE WHEN count(v) = 0 THEN NULL ELSE coalesce(sum(CASE WHEN v > 0 THEN -(v / t) * log2(v / t) END), 0.0) END, 6) AS {name}"
        f" FROM (SELECT rec_no, v, sum(v) OVER (PARTITION BY rec_no) AS t FROM (SELECT rec_no, {x} - min({x}) OVER (PARTITION BY rec_no) AS v FROM {table})) GROUP BY rec_no)"
    )


def _gap(by: str, name: str) -> str:
    return f"(SELECT rec_no, {_five('g', name)} FROM (SELECT rec_no, lead(cy) OVER (PARTITION BY {by} ORDER BY cy) - cy AS g FROM L) WHERE g > 0 GROUP BY rec_no)"


def _crossing(table: str, key: str, name: str) -> str:
    return f"(SELECT rec_no, CAST(count(*) AS DOUBLE) AS {name} FROM {table} a JOIN {table} b USING (rec_no) WHERE a.{key} < b.{key} AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY rec_no)"


_RATIOS = {"digit": "[^\\p{Nd}]", "upper": "[^\\p{Lu}]"}
_PARTS = (
    f"""(SELECT rec_no, CAST(count(*) AS DOUBLE) AS num_lines, {_five('lc', 'line_conf')}, {_ten('lc', 'line_conf')}, {_five('y1 - y0', 'line_height')}, {_five('x1 - x0', 'line_width')}, {_five('hs', 'htr_line_score')},
  {_ten('hs', 'htr_line_score')}, {_five('chars', 'line_char_count')}, {_five('words', 'line_word_count')}, CAST(sum(chars) AS DOUBLE) AS total_chars, CAST(sum(words) AS DOUBLE) AS total_words FROM L GROUP BY rec_no)""",
    f"""(SELECT rec_no, CAST(count(*) AS DOUBLE) AS num_regions, CASE WHEN count(rc) > 0 THEN 1.0 ELSE 0.0 END AS has_region_conf, {_five('rc', 'region_conf')}, {_ten('rc', 'region_conf')}, {_five('(x1 - x0) * (y1 - y0)', 'region_area')},
  {_five('(x1 - x0) / (y1 - y0)', 'region_aspect')}, {_five('n', 'lines_per_region')}, round(count(*) FILTER (WHERE n = 1) / count(*), 9) AS frac_single_line_regions, round(count(*) FILTER (WHERE n >= 2) / count(*), 9) AS frac_multi_line_regions,
  CAST(max(n) AS DOUBLE) AS max_lines_in_region, {_five('(x1 - x0) * (y1 - y0) / la', 'region_tightness_area_ratio')}, {_five('(y1 - y0) / lh', 'region_height_to_lines_height_ratio')}, round(avg(sx0) FILTER (WHERE n > 1), 6) AS region_xmin_std_mean,
  round(avg(sx1) FILTER (WHERE n > 1), 6) AS region_xmax_std_mean, round(avg(sxc) FILTER (WHERE n > 1), 6) AS region_centerx_std_mean, round(sum(n) / count(*), 9) AS region_to_line_ratio,
  round(sum(la) / ((max(x1) - min(x0)) * (max(y1) - min(y0))), 9) AS text_density FROM R GROUP BY rec_no)""",
    "(SELECT rec_no, round(count(*) FILTER (WHERE chars < lo) / count(*), 9) AS frac_short_lines, round(count(*) FILTER (WHERE chars > hi) / count(*), 9) AS frac_long_lines FROM (SELECT rec_no, chars, quantile_cont(chars, 0.2) OVER (PARTITION BY rec_no) AS lo, quantile_cont(chars, 0.8) OVER (PARTITION BY rec_no) AS hi FROM L) GROUP BY rec_no)",
    _gap("rec_no, reg", "line_spacing"),
    _gap("rec_no", "page_line_spacing"),
    _entropy("L", "lc", "line_conf_entropy"),
    _entropy("R", "rc", "region_conf_entropy"),
    "(SELECT rec_no, CAST(count(*) FILTER (WHERE up) AS DOUBLE) AS reading_order_inversions FROM (SELECT rec_no, lag(cy) OVER (PARTITION BY rec_no, reg ORDER BY line_pos, line_no) > cy AS up FROM L) GROUP BY rec_no)",
    "(SELECT rec_no, "
    + ", ".join(f"round(length(regexp_replace(t, '{p}', '', 'g')) / nullif(length(t), 0), 9) AS char_{k}_ratio" for k, p in _RATIOS.items())
    + ", CASE WHEN length(t) > 0 THEN round(none, 9) END AS frac_no_alpha_lines FROM (SELECT rec_no, string_agg(text, chr(10) ORDER BY line_pos, line_no) AS t, count(*) FILTER (WHERE NOT regexp_matches(text, '\\p{L}')) / count(*) AS none FROM L GROUP BY rec_no))",
)
_SUMS = (_crossing("L", "line_no", "line_overlap_count"), _crossing("R", "reg", "region_overlap_count"))
_FIVES = "line_conf line_height line_width htr_line_score line_char_count line_word_count region_conf region_area region_aspect lines_per_region region_tightness_area_ratio region_height_to_lines_height_ratio line_spacing page_line_spacing".split()
#: Page features that SQL gives too.
FEATURE_COLUMNS = (
    *(f"{p}_{k}" for p in _FIVES for k in _STATS),
    *(f"{p}_hist_bin_{i}" for p in ("line_conf", "region_conf", "htr_line_score") for i in range(10)),
    *(
        "num_lines total_chars total_words num_regions has_region_conf frac_single_line_regions frac_multi_line_regions max_lines_in_region region_xmin_std_mean region_xmax_std_mean region_centerx_std_mean"
        " region_to_line_ratio text_density frac_short_lines frac_long_lines line_conf_entropy region_conf_entropy reading_order_inversions char_digit_ratio char_upper_ratio frac_no_alpha_lines"
        " line_overlap_count region_overlap_count"
    ).split(),
)
_NO_XML = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]"
_XML_TEXT = f"trim(regexp_replace(regexp_replace(text, '{_NO_XML}', '', 'g'), '{_SPACE}', ' ', 'g'))"

ORACLES: dict[str, str] = {
    "made_page_features": f"WITH {_MADE} SELECT rec_no, {', '.join(f'CAST(coalesce({c}, 0.0) AS DOUBLE) AS {c}' if c.endswith('overlap_count') else f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS)} FROM (SELECT DISTINCT rec_no FROM L) "
    + " ".join(f"LEFT JOIN {p} USING (rec_no)" for p in (*_PARTS, *_SUMS)),
    "page_layout_order": f"WITH {_MADE} SELECT rec_no AS doc_id, line_no, row_number() OVER (PARTITION BY rec_no ORDER BY floor((y0 + y1) / 2), line_pos, line_no) - 1 AS order_no FROM L",
    "page_round_trip": f"""WITH {_MADE} SELECT rec_no, row_number() OVER (PARTITION BY rec_no ORDER BY reg, line_pos, line_no) - 1 AS i, {_XML_TEXT} AS text,
  CAST(x0 AS BIGINT) AS xmin, CAST(y0 AS BIGINT) AS ymin, CAST(x1 AS BIGINT) AS xmax, CAST(y1 AS BIGINT) AS ymax FROM L""",
    "alto_round_trip": f"""WITH {_MADE}, w AS (SELECT *, CASE WHEN {_XML_TEXT} = '' THEN 0 ELSE len(string_split({_XML_TEXT}, ' ')) END AS k FROM L)
SELECT rec_no, count(*) AS n_lines, count(*) FILTER (WHERE k > 0) AS n_text_lines, count(DISTINCT reg) AS n_regions, CAST(sum(k) AS BIGINT) AS n_words FROM w GROUP BY rec_no""",
    "csv_round_trip": f"WITH {_TRAIN} SELECT row_no, " + ", ".join(f"round(CASE WHEN isfinite({c}) THEN {c} END, 9) AS {c}" for c in (*FEATURES, "target_bow_f1")) + " FROM train",
    "corpus_round_trip": f"WITH {_LINES}, c AS (SELECT {_COLLAPSED} AS text FROM lines) SELECT text, count(*) AS n FROM c WHERE text <> '' AND text NOT LIKE '#%' GROUP BY text",
    "p3_found": """
WITH RECURSIVE once AS (SELECT DISTINCT ON (page_no) page_no, CAST(body AS JSON) AS j FROM page_documents WHERE json_valid(body)),
nodes AS (
  SELECT page_no, 'page' AS kind, '' AS node_path, '' AS parent_path, j FROM once WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT n.page_no, c.kind, CASE WHEN n.node_path = '' THEN '' ELSE n.node_path || '/' END || c.letter || CAST(i.i AS VARCHAR), n.node_path,
    CASE WHEN json_type(c.arr) = 'ARRAY' THEN json_extract(c.arr, '$[' || CAST(i.i AS VARCHAR) || ']') ELSE c.arr END
  FROM nodes n, LATERAL (VALUES ('region', 'r', json_extract(n.j, '$.regions')), ('line', 'l', json_extract(n.j, '$.lines')), ('word', 'w', json_extract(n.j, '$.words'))) c(kind, letter, arr),
    LATERAL (SELECT unnest(range(CASE WHEN json_type(c.arr) = 'ARRAY' THEN CAST(json_array_length(c.arr) AS BIGINT) WHEN json_type(c.arr) = 'OBJECT' THEN 1 ELSE 0 END)) AS i) i
  WHERE n.kind <> 'word' AND json_type(CASE WHEN json_type(c.arr) = 'ARRAY' THEN json_extract(c.arr, '$[' || CAST(i.i AS VARCHAR) || ']') ELSE c.arr END) = 'OBJECT'),
polys AS (SELECT page_no, node_path, json_extract(j, '$.polygon') AS p FROM nodes WHERE kind = 'line'),
text_points AS (SELECT page_no, node_path, generate_subscripts(parts, 1) - 1 AS i FROM (SELECT page_no, node_path, list_filter(regexp_split_to_array(json_extract_string(p, '$'), '[\\s;]+'), lambda x: x <> '') AS parts FROM polys WHERE json_type(p) = 'VARCHAR')),
list_points AS (SELECT page_no, node_path, i.i FROM polys, LATERAL (SELECT unnest(range(CAST(json_array_length(p) AS BIGINT))) AS i) i WHERE json_type(p) = 'ARRAY' AND json_type(json_extract(p, '$[' || CAST(i.i AS VARCHAR) || ']')) <> 'NULL'),
points AS (SELECT * FROM text_points UNION ALL SELECT * FROM list_points UNION ALL SELECT page_no, node_path, 0 FROM polys WHERE json_type(p) = 'OBJECT')
SELECT page_no, kind, node_path, parent_path FROM nodes WHERE kind <> 'page'
UNION ALL SELECT page_no, 'point', node_path || '/p' || CAST(i AS VARCHAR), node_path FROM points""",
    "p3_lines": """
WITH RECURSIVE once AS (SELECT DISTINCT ON (page_no) page_no, CAST(body AS JSON) AS j FROM page_documents WHERE json_valid(body)),
nodes AS (
  SELECT page_no, 'page' AS kind, '' AS node_path, '' AS parent_path, j FROM once WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT n.page_no, c.kind, CASE WHEN n.node_path = '' THEN '' ELSE n.node_path || '/' END || c.letter || CAST(i.i AS VARCHAR), n.node_path,
    CASE WHEN json_type(c.arr) = 'ARRAY' THEN json_extract(c.arr, '$[' || CAST(i.i AS VARCHAR) || ']') ELSE c.arr END
  FROM nodes n, LATERAL (VALUES ('region', 'r', json_extract(n.j, '$.regions')), ('line', 'l', json_extract(n.j, '$.lines')), ('word', 'w', json_extract(n.j, '$.words'))) c(kind, letter, arr),
    LATERAL (SELECT unnest(range(CASE WHEN json_type(c.arr) = 'ARRAY' THEN CAST(json_array_length(c.arr) AS BIGINT) WHEN json_type(c.arr) = 'OBJECT' THEN 1 ELSE 0 END)) AS i) i
  WHERE n.kind <> 'word' AND json_type(CASE WHEN json_type(c.arr) = 'ARRAY' THEN json_extract(c.arr, '$[' || CAST(i.i AS VARCHAR) || ']') ELSE c.arr END) = 'OBJECT')
SELECT page_no, node_path, parent_path, CAST(regexp_extract(node_path, '([0-9]+)$', 1) AS BIGINT) AS ordinal, TRY_CAST(json_extract_string(j, '$.segmentation_confidence') AS DOUBLE) AS confidence,
  json_extract_string(j, '$.transcription[0].text') AS text FROM nodes WHERE kind = 'line'""",
    "p6_found": """
WITH once AS (SELECT DISTINCT ON (json_no) stream_no, export_no, CAST(body AS JSON) AS j FROM htr_json WHERE json_valid(body)),
top AS (SELECT o.stream_no, o.export_no, json_extract_string(o.j, '$.line_ref') AS line, e.key AS path, e.type AS t, e.value AS value FROM once o, json_each(o.j) e),
every AS (SELECT * FROM top UNION ALL SELECT p.stream_no, p.export_no, p.line, p.path || '.' || e.key, e.type, e.value FROM top p, json_each(CASE WHEN p.t = 'OBJECT' THEN p.value ELSE '{}' END) e),
f AS (SELECT stream_no, export_no, line, path, CASE WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'VARCHAR' THEN 'string' ELSE 'number' END AS jt, CAST(value AS VARCHAR) AS val FROM every WHERE t <> 'NULL'),
lay AS (SELECT stream_no, export_no, path, jt FROM (SELECT *, row_number() OVER (PARTITION BY stream_no, export_no, path ORDER BY n DESC, jt) AS r FROM (SELECT stream_no, export_no, path, jt, count(*) AS n FROM f GROUP BY ALL)) WHERE r = 1),
step AS (SELECT * FROM (SELECT stream_no, export_no, lag(export_no) OVER (PARTITION BY stream_no ORDER BY export_no) AS prev FROM (SELECT DISTINCT stream_no, export_no FROM once)) WHERE prev IS NOT NULL),
o AS (SELECT s.stream_no, s.export_no, l.path, l.jt FROM step s JOIN lay l ON l.stream_no = s.stream_no AND l.export_no = s.prev), n AS (SELECT s.stream_no, s.export_no, l.path, l.jt FROM step s JOIN lay l ON l.stream_no = s.stream_no AND l.export_no = s.export_no),
b AS (SELECT coalesce(o.stream_no, n.stream_no) AS stream_no, coalesce(o.export_no, n.export_no) AS export_no, coalesce(o.path, n.path) AS path, o.jt AS ot, n.jt AS nt FROM o FULL JOIN n ON o.stream_no = n.stream_no AND o.export_no = n.export_no AND o.path = n.path),
ret AS (SELECT * FROM b WHERE ot <> nt), swapped AS (SELECT stream_no, export_no, path FROM ret WHERE ot = 'object' OR nt = 'object'),
loose AS (SELECT * FROM b WHERE (ot IS NULL OR nt IS NULL) AND coalesce(ot, nt) <> 'object' AND NOT EXISTS (SELECT 1 FROM swapped w WHERE w.stream_no = b.stream_no AND w.export_no = b.export_no AND b.path LIKE w.path || '.%')),
pairs AS (SELECT r.stream_no, r.export_no, s.prev, r.path AS op, a.path AS np FROM loose r JOIN loose a ON r.stream_no = a.stream_no AND r.export_no = a.export_no AND r.nt IS NULL AND a.ot IS NULL AND r.ot = a.nt JOIN step s ON s.stream_no = r.stream_no AND s.export_no = r.export_no),
agree AS (SELECT p.stream_no, p.export_no, p.op, p.np, count(*) AS k, count(*) FILTER (WHERE x.val = y.val) AS same FROM pairs p JOIN f x ON x.stream_no = p.stream_no AND x.export_no = p.prev AND x.path = p.op
  JOIN f y ON y.stream_no = p.stream_no AND y.export_no = p.export_no AND y.path = p.np AND y.line = x.line GROUP BY ALL),
ren AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_no, export_no, op ORDER BY same DESC, np) AS ro, row_number() OVER (PARTITION BY stream_no, export_no, np ORDER BY same DESC, op) AS rn FROM agree WHERE same > 0 AND same >= 0.9 * k) WHERE ro = 1 AND rn = 1)
SELECT stream_no, export_no, 'renamed' AS drift_kind, op AS old_path, np AS new_path FROM ren
UNION ALL SELECT stream_no, export_no, 'retyped', path, path FROM ret
UNION ALL SELECT stream_no, export_no, 'removed', path, '' FROM loose l WHERE nt IS NULL AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.stream_no = l.stream_no AND r.export_no = l.export_no AND r.op = l.path)
UNION ALL SELECT stream_no, export_no, 'added', '', path FROM loose l WHERE ot IS NULL AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.stream_no = l.stream_no AND r.export_no = l.export_no AND r.np = l.path)""",
    "p6_versions": """
WITH once AS (SELECT DISTINCT ON (json_no) stream_no, export_no, CAST(body AS JSON) AS j FROM htr_json WHERE json_valid(body)),
top AS (SELECT o.stream_no, o.export_no, e.key AS path, e.type AS t, e.value AS value FROM once o, json_each(o.j) e),
every AS (SELECT * FROM top UNION ALL SELECT p.stream_no, p.export_no, p.path || '.' || e.key, e.type, e.value FROM top p, json_each(CASE WHEN p.t = 'OBJECT' THEN p.value ELSE '{}' END) e),
f AS (SELECT stream_no, export_no, path, CASE WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'VARCHAR' THEN 'string' ELSE 'number' END AS jt FROM every WHERE t <> 'NULL'),
lay AS (SELECT stream_no, export_no, path, jt FROM (SELECT *, row_number() OVER (PARTITION BY stream_no, export_no, path ORDER BY n DESC, jt) AS r FROM (SELECT stream_no, export_no, path, jt, count(*) AS n FROM f GROUP BY ALL)) WHERE r = 1),
pr AS (SELECT e.stream_no, e.export_no, sha256(coalesce(string_agg(path || ':' || jt, ',' ORDER BY path || ':' || jt), '')) AS fingerprint FROM (SELECT DISTINCT stream_no, export_no FROM htr_json) e LEFT JOIN lay USING (stream_no, export_no) GROUP BY 1, 2),
v AS (SELECT *, lag(export_no) OVER w AS prev_export_no, CASE WHEN fingerprint IS DISTINCT FROM lag(fingerprint) OVER w THEN 1 ELSE 0 END AS is_new FROM pr WINDOW w AS (PARTITION BY stream_no ORDER BY export_no))
SELECT stream_no, export_no, fingerprint, prev_export_no, CAST(sum(is_new) OVER (PARTITION BY stream_no ORDER BY export_no) AS BIGINT) AS version FROM v""",
    "group_stats": f"SELECT event_type, {_stats('value', 'value')} FROM events GROUP BY event_type",
    "hist_equal": _hist(),
    "shifted_entropy": """
WITH s AS (SELECT o_custkey, o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) AS x FROM orders), t AS (SELECT *, sum(x) OVER (PARTITION BY o_custkey) AS total FROM s)
SELECT o_custkey, round(coalesce(sum(CASE WHEN x > 0 THEN -(x / total) * log2(x / total) END), 0.0), 5) AS entropy FROM t GROUP BY o_custkey""",
    "quantile_edges": f"""
WITH v AS (SELECT DISTINCT line_no, dataset_tag, line_conf AS x FROM text_lines WHERE isfinite(line_conf) AND line_conf BETWEEN 0 AND 1),
q AS (SELECT dataset_tag, quantile_cont(x, {list(BIN_QUANTILES)}) AS q FROM v GROUP BY dataset_tag)
SELECT dataset_tag, CAST(i AS BIGINT) AS i, round(q[i + 1], 9) AS edge FROM q, (SELECT unnest(range({len(BIN_QUANTILES)})) AS i)""",
    "array_features": f"SELECT o_custkey, {_stats('o_totalprice', 'price', 6, 3)}, round(quantile_cont(o_totalprice, 0.2), 4) AS p20 FROM orders GROUP BY o_custkey",
    "line_shape": f"""
WITH {_LINES}, x AS (SELECT rec_no, length(text) AS chars, CASE WHEN {_COLLAPSED} = '' THEN 0 ELSE len(string_split({_COLLAPSED}, ' ')) END AS words FROM lines),
p AS (SELECT *, quantile_cont(chars, 0.2) OVER (PARTITION BY rec_no) AS lo, quantile_cont(chars, 0.8) OVER (PARTITION BY rec_no) AS hi FROM x)
SELECT rec_no, count(*) AS n_lines, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(words) AS BIGINT) AS total_words,
  round(count(*) FILTER (WHERE chars < lo) / count(*), 9) AS frac_short_lines, round(count(*) FILTER (WHERE chars > hi) / count(*), 9) AS frac_long_lines FROM p GROUP BY rec_no""",
    "char_classes": """
SELECT doc_id, round(length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) / n, 9) AS char_digit_ratio, round((n - length(regexp_replace(text, '[^\\p{L}\\p{N}\\s\\p{Z}]', '', 'g'))) / n, 9) AS char_punct_ratio,
  round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / n, 9) AS char_upper_ratio, round((n - length(regexp_replace(text, '[^\\x20-\\x7E\\x{C0}-\\x{17F}]', '', 'g'))) / n, 9) AS char_unknown_ratio
FROM (SELECT doc_id, text, length(text) AS n FROM documents)""",
    "no_alpha_lines": f"WITH {_LINES} SELECT rec_no, round(count(*) FILTER (WHERE NOT regexp_matches(text, '\\p{{L}}')) / count(*), 9) AS frac_no_alpha_lines FROM lines GROUP BY rec_no",
    "repetition_runs": """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS island FROM c), r AS (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id, ch, island HAVING count(*) >= 3)
SELECT d.doc_id, count(r.k) AS n_runs FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "word_token_counts": "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_words FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY doc_id",
    "ngram_top": f"WITH {_LINES}, g AS ({_GRAMS.format(key='line_no', text=_COLLAPSED, n=4, src='lines')}) SELECT CAST(4 AS BIGINT) AS n, gram, count(*) AS cnt FROM g GROUP BY gram HAVING count(*) >= 5 ORDER BY cnt DESC, gram LIMIT 200",
    "ngram_ratio": f"""
WITH {_LINES}, g AS ({_GRAMS.format(key='line_no', text=_COLLAPSED, n=3, src='lines')}), f AS (SELECT gram FROM g GROUP BY gram HAVING count(*) >= 50)
SELECT l.line_no, round(count(f.gram) / nullif(count(g.gram), 0), 9) AS char_3gram_ratio_present FROM lines l LEFT JOIN g USING (line_no) LEFT JOIN f ON f.gram = g.gram GROUP BY l.line_no""",
    "lm_perplexity": f"""
WITH {_LINES}, bare AS (SELECT line_no, regexp_replace(text, '{_SPACE}', '', 'g') AS text FROM lines),
w AS ({_GRAMS.format(key='line_no', text='text', n=3, src='lines')}), c AS (SELECT substr(gram, 1, 2) AS context, substr(gram, 3, 1) AS token, count(*) AS cnt FROM w GROUP BY 1, 2),
t AS (SELECT context, sum(cnt) AS total, count(*) AS vocab FROM c GROUP BY context), s AS ({_GRAMS.format(key='line_no', text='text', n=3, src='bare')}),
p AS (SELECT line_no, ln(greatest((coalesce(cnt, 0) + 0.1::DOUBLE) / (coalesce(total, 0) + 0.1::DOUBLE * coalesce(vocab, 1)), 1e-12)) AS logp FROM s
  LEFT JOIN c ON c.context = substr(gram, 1, 2) AND c.token = substr(gram, 3, 1) LEFT JOIN t ON t.context = substr(gram, 1, 2))
SELECT o.line_no, round(exp(-avg(logp)), 4) AS ppl FROM bare o LEFT JOIN p USING (line_no) GROUP BY o.line_no""",
    "lexicon_match": f"""
WITH {_LINES}, tok AS (SELECT rec_no, w AS token FROM (SELECT rec_no, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM lines)),
lx AS (SELECT DISTINCT lexicon_name, lower(word) AS word FROM lexicon UNION SELECT DISTINCT 'combined', lower(word) FROM lexicon), names AS (SELECT DISTINCT lexicon_name FROM lx), recs AS (SELECT DISTINCT rec_no FROM lines)
SELECT r.rec_no, n.lexicon_name, round(coalesce(count(lx.word) / nullif(count(tok.token), 0), 0.0), 9) AS match_ratio, count(lx.word) AS match_count, count(DISTINCT lx.word) AS unique_match_count
FROM recs r CROSS JOIN names n LEFT JOIN tok ON tok.rec_no = r.rec_no LEFT JOIN lx ON lx.lexicon_name = n.lexicon_name AND lx.word = tok.token GROUP BY 1, 2""",
    "bow_prf": f"""
WITH {_SIDES}, a AS (SELECT rec_no, w, count(*) AS n FROM (SELECT rec_no, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM truth) GROUP BY 1, 2),
b AS (SELECT rec_no, w, count(*) AS n FROM (SELECT rec_no, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM readl) GROUP BY 1, 2),
s AS (SELECT coalesce(a.rec_no, b.rec_no) AS rec_no, sum(coalesce(a.n, 0)) AS t, sum(coalesce(b.n, 0)) AS r, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS both_n FROM a FULL JOIN b ON a.rec_no = b.rec_no AND a.w = b.w GROUP BY 1),
k AS (SELECT k.rec_no, coalesce(t, 0) AS t, coalesce(r, 0) AS r, coalesce(both_n, 0) AS m FROM (SELECT DISTINCT rec_no FROM lines) k LEFT JOIN s USING (rec_no)),
pr AS (SELECT rec_no, CASE WHEN t = 0 AND r = 0 THEN 1.0 WHEN t = 0 OR r = 0 THEN 0.0 ELSE m / r END::DOUBLE AS p, CASE WHEN t = 0 THEN 1.0 WHEN r = 0 THEN 0.0 ELSE m / t END::DOUBLE AS c FROM k)
SELECT rec_no, round(p, 9) AS bow_precision, round(c, 9) AS bow_recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END, 9) AS bow_f1 FROM pr""",
    "linewise_cer": f"""
WITH {_SIDES}, j0 AS (SELECT coalesce(t.rec_no, r.rec_no) AS rec_no, t.text AS t, r.text AS r, array_to_string(list_distinct(string_split(t.text || r.text, '')), '') AS chars FROM truth t FULL JOIN readl r ON t.rec_no = r.rec_no AND t.pos = r.pos),
j AS (SELECT rec_no, {_coded('t')} AS t, {_coded('r')} AS r FROM j0),
g AS (SELECT rec_no, avg(CASE WHEN t IS NULL THEN NULL WHEN r IS NULL THEN 1.0::DOUBLE WHEN t = '' THEN CASE WHEN r = '' THEN 0.0 ELSE 1.0 END::DOUBLE ELSE levenshtein(t, r) / length(t)::DOUBLE END) AS a, count(t) AS m, count(r) AS n FROM j GROUP BY rec_no)
SELECT rec_no, round(coalesce(a, 0.0), 9) AS avg_line_cer, round(greatest(m - n, 0) / greatest(m, 1), 9) AS missing_ratio, round(greatest(n - m, 0) / greatest(n, 1), 9) AS halluc_ratio FROM g""",
    "geom_order": f"""
WITH {_BOXES}, b AS (SELECT page, pos, CASE WHEN page % 7 = 0 AND pos % 3 = 0 THEN NULL ELSE xmin END AS xmin, ymin FROM boxes), f AS (SELECT *, bool_and(xmin IS NOT NULL) OVER (PARTITION BY page) AS ok FROM b)
SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN ok THEN ymin END, CASE WHEN ok THEN xmin END, pos) - 1 AS order_no FROM f""",
    "box_overlap": f"WITH {_BOXES} SELECT a.page, count(b.pos) AS n_overlaps FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND a.pos < b.pos AND {_OVERLAP} GROUP BY a.page",
    "box_iou": f"WITH {_BOXES} SELECT a.page, a.pos, round(max({_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER})), 9) AS best_iou FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND a.pos <> b.pos GROUP BY a.page, a.pos",
    "polygon_iou": f"WITH {_BOXES} SELECT a.page, a.pos, round(max({_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER})), 9) AS best_iou FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND a.pos <> b.pos GROUP BY a.page, a.pos",
    "contained_boxes": f"WITH {_BOXES} SELECT DISTINCT a.page, a.pos FROM boxes a JOIN boxes b ON a.page = b.page AND a.pos <> b.pos AND {_AREA.format('b')} > {_AREA.format('a')} AND {_INTER} > 0.5 * {_AREA.format('a')}",
    "printspace_order": f"""
WITH {_BOXES}, p AS (SELECT a.*, CASE WHEN greatest(0, least(700, a.xmax) - greatest(150, a.xmin)) * greatest(0, least(350, a.ymax) - greatest(60, a.ymin)) / ({_AREA.format('a')}) > 0.5 THEN 'PRINTSPACE'
  WHEN a.xmax >= 700 THEN 'MARGIN_RIGHT' WHEN a.xmin <= 150 THEN 'MARGIN_LEFT' WHEN a.ymin <= 60 THEN 'MARGIN_TOP' WHEN a.ymax >= 350 THEN 'MARGIN_BOTTOM' ELSE 'PRINTSPACE' END AS location FROM boxes a)
SELECT page, pos, location, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN floor((xmin + xmax) / 2) > 425 THEN 1 ELSE 0 END,
  CASE location WHEN 'MARGIN_TOP' THEN 0 WHEN 'PRINTSPACE' THEN 1 WHEN 'MARGIN_BOTTOM' THEN 2 WHEN 'MARGIN_LEFT' THEN 3 ELSE 4 END, ymin, pos) - 1 AS order_no FROM p""",
    "left_right_order": f"WITH {_BOXES}, s AS (SELECT *, avg(ymax - ymin) OVER (PARTITION BY page) AS step FROM boxes) SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY floor(ymin / step), xmin, pos) - 1 AS order_no FROM s",
    "top_down_order": f"WITH {_BOXES} SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY floor((ymin + ymax) / 2), pos) - 1 AS order_no FROM boxes",
    "line_spacing": f"""
WITH {_BOXES}, c AS (SELECT page, pos, ymin + (ymax - ymin) / 2 AS cy FROM boxes), g AS (SELECT page, lead(cy) OVER (PARTITION BY page ORDER BY cy, pos) - cy AS gap FROM c)
SELECT page, {_stats('gap', 'line_spacing')} FROM g WHERE gap > 0 GROUP BY page""",
    "order_inversions": f"""
WITH {_BOXES}, c AS (SELECT page, ymin + (ymax - ymin) / 2 AS cy, lag(ymin + (ymax - ymin) / 2) OVER (PARTITION BY page ORDER BY pos) AS before FROM boxes)
SELECT page, count(*) FILTER (WHERE before > cy) AS n_inversions FROM c GROUP BY page""",
    "polygon_boxes": f"WITH {_BOXES} SELECT page, pos, xmin, ymin, xmax, ymax FROM boxes",
    "pruned_tree": f"WITH {_BOXES} SELECT page AS doc_id, pos + 1 AS node_id FROM boxes WHERE (pos % 100) / 100.0::DOUBLE >= 0.3 AND xmin <= 900 AND (xmax - xmin) / (ymax - ymin) > 1.0",
    "stem_pairing": """
WITH g AS (SELECT regexp_replace(regexp_extract(gt_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, min(gt_path) AS gt_path FROM dataset_pages WHERE gt_path IS NOT NULL GROUP BY 1),
p AS (SELECT regexp_replace(regexp_extract(pred_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, min(pred_path) AS pred_path FROM dataset_pages WHERE pred_path IS NOT NULL GROUP BY 1)
SELECT stem, gt_path, pred_path FROM g JOIN p USING (stem)""",
    "excluded_paths": "SELECT DISTINCT gt_path AS rel_path FROM dataset_pages WHERE gt_path IS NOT NULL AND lower(gt_path) NOT IN (SELECT lower(gt_path) FROM dataset_pages WHERE gt_path IS NOT NULL AND rec_no % 3 = 0)",
    "existing_images": """
WITH f AS (SELECT DISTINCT image_path AS path FROM dataset_pages WHERE image_path IS NOT NULL), a AS (SELECT path FROM f UNION ALL SELECT regexp_replace(path, 'jpg$', 'png') FROM f WHERE length(regexp_replace(path, 'jpg$', 'png')) % 2 = 0),
s AS (SELECT regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, min_by(path, (CASE WHEN path LIKE '%.png' THEN 0 ELSE 1 END, path)) AS path FROM a GROUP BY 1)
SELECT w.stem, s.path FROM (SELECT DISTINCT source_page_id AS stem FROM dataset_pages) w LEFT JOIN s USING (stem)""",
    "paired_compare": f"""
WITH {_TRAIN}, v AS (SELECT source_page_id, dataset_tag, CASE WHEN isfinite(target_bow_f1) THEN target_bow_f1 END AS y, CASE WHEN isfinite(target_perm_cer_strict) THEN target_perm_cer_strict END AS c FROM train),
l AS (SELECT source_page_id, max(y) AS y, max(c) AS c FROM v WHERE dataset_tag LIKE 'lines%' GROUP BY 1), r AS (SELECT source_page_id, max(y) AS y, max(c) AS c FROM v WHERE dataset_tag LIKE 'rl%' GROUP BY 1)
SELECT coalesce(l.source_page_id, r.source_page_id) AS source_page_id, CASE WHEN l.source_page_id IS NOT NULL AND r.source_page_id IS NOT NULL THEN 'both' WHEN l.source_page_id IS NOT NULL THEN 'left' ELSE 'right' END AS side,
  round(l.y, 9) AS bow_f1_left, round(r.y, 9) AS bow_f1_right, round(r.y - l.y, 9) AS bow_f1_delta, round(l.c, 9) AS perm_cer_left, round(r.c, 9) AS perm_cer_right, round(r.c - l.c, 9) AS perm_cer_delta
FROM l FULL JOIN r ON l.source_page_id = r.source_page_id""",
    "metric_summary": f"""
WITH {_TRAIN}, m AS (SELECT split, x.metric, CASE WHEN isfinite(x.v) THEN x.v END AS v FROM train, LATERAL (VALUES ('target_bow_f1', target_bow_f1), ('target_perm_cer_strict', target_perm_cer_strict), ('n_lines', n_lines)) x(metric, v))
SELECT split, metric, count(v) AS n, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(stddev_pop(v), 9) AS std FROM m GROUP BY 1, 2""",
    "page_ranks": f"""
WITH {_TRAIN} SELECT row_no, rank() OVER (PARTITION BY csv_file ORDER BY round(target_bow_f1, 2) DESC) AS gt_rank, row_number() OVER (PARTITION BY csv_file ORDER BY line_conf_mean DESC, row_no) AS pred_rank
FROM train WHERE isfinite(target_bow_f1) AND isfinite(line_conf_mean)""",
    "top_bottom_pages": f"""
WITH {_TRAIN}, t AS (SELECT row_no, line_conf_mean AS s FROM train WHERE isfinite(line_conf_mean))
(SELECT row_no, 'top' AS part FROM t ORDER BY s DESC, row_no LIMIT 25) UNION ALL (SELECT row_no, 'bottom' AS part FROM t ORDER BY s, row_no LIMIT 25)""",
    "once_per_key": "SELECT stream_no, count(DISTINCT json_no) AS n_records FROM htr_json GROUP BY stream_no",
    "target_correlation": f"WITH {_TRAIN} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, round(corr({c}, target_bow_f1), 9) AS corr FROM train WHERE isfinite({c}) AND isfinite(target_bow_f1)" for c in FEATURES
    ),
    "usable_features": f"WITH {_TRAIN} "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM train WHERE isfinite({c}) HAVING min({c}) <> max({c})" for c in FEATURES),
    "weighted_errors": f"""
WITH {_TRAIN}, v AS (SELECT csv_file, target_bow_f1 AS y, line_conf_mean AS p FROM train WHERE isfinite(target_bow_f1) AND isfinite(line_conf_mean)), b AS (SELECT min(y) >= -0.05 AND max(y) <= 1.05 AS ok FROM v),
w AS (SELECT v.*, CASE WHEN ok THEN greatest(1.0, least(5.0, 1 + 2 * pow(1 - greatest(0.0, least(1.0, y)), 2))) ELSE 1.0 END::DOUBLE AS w FROM v, b)
SELECT csv_file, round(avg(abs(y - p)), 9) AS mae, round(sum(w * abs(y - p)) / sum(w), 9) AS wmae FROM w GROUP BY csv_file""",
    "constant_baseline": f"""
WITH {_TRAIN}, v AS (SELECT target_bow_f1 AS y, split FROM train WHERE isfinite(target_bow_f1)), m AS (SELECT avg(y) AS m FROM v)
SELECT round(max(m), 9) AS mean_used, count(*) AS n_val, round(avg(abs(y - m)), 9) AS val_mae FROM v, m WHERE split <> 'train'""",
    "holdout_split": f"""
WITH {_TRAIN}, n AS (SELECT count(*) AS n FROM train) SELECT 'val' AS split, CAST(ceil(n * 0.2) AS BIGINT) AS n_rows FROM n UNION ALL SELECT 'train', CAST(n - ceil(n * 0.2) AS BIGINT) FROM n""",
    "correlated_features": "SELECT unnest(['" + "', '".join(FEATURES) + "']) AS feature",
    "word_boxes": f"""
WITH {_LINES}, w AS (SELECT line_no, length(text) AS n, length(text) * 9 + line_pos % 7 AS width, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM lines WHERE length(text) > 0),
x AS (SELECT line_no, len(ws) AS k, least((width // n) * list_sum(list_transform(ws, lambda x: length(x) + 1)), width) AS x1 FROM w WHERE len(ws) > 0)
SELECT line_no, CAST(k AS BIGINT) AS n_words, CAST(x1 AS BIGINT) AS x1 FROM x""",
    "streamed_events": """
WITH h AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, event_type, n FROM h WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
