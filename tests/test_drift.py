import json

from pyspark.sql import functions as F

from pagelens.operators import drift

SCHEMA = "json_no long, stream_no long, export_no long, body string, path string, n long"


def exports(spark, *layouts, stream=1):
    rows, n = [], 0
    for e, records in enumerate(layouts, 1):
        for r in records:
            n += 1
            rows.append((n, stream, e, json.dumps(r) if r is not None else None, "clash", 1))
    return spark.createDataFrame(rows + rows[:1], SCHEMA)


def changes(df):
    return {(r.export_no, r.drift_kind, r.old_path, r.new_path) for r in drift.changes(df).collect()}


def lines(make, n=6):
    return [{"line_ref": f"l{i}", **make(i)} for i in range(n)]


def test_added_removed_renamed_retyped(spark):
    a = lines(lambda i: {"label": f"x{i}", "conf": i / 10, "gone": i, "a": {"s": f"s{i}"}})
    b = lines(lambda i: {"lab": f"x{i}" if i else None, "conf": str(i / 10), "new": True, "s": f"s{i}"})
    assert changes(exports(spark, a, b)) == {
        (2, "renamed", "label", "lab"), (2, "renamed", "a.s", "s"), (2, "retyped", "conf", "conf"), (2, "removed", "gone", ""), (2, "added", "", "new"),
    }


def test_object_replaced_reports_the_object_only(spark):
    a = lines(lambda i: {"a": {"x": i, "y": f"v{i}"}})
    b = lines(lambda i: {"a": json.dumps({"x": i})})
    assert changes(exports(spark, a, b, a)) == {(2, "retyped", "a", "a"), (3, "retyped", "a", "a")}


def test_null_is_absent_and_objects_are_not_fields(spark):
    a = lines(lambda i: {"a": None, "b": {"c": 1}})
    b = lines(lambda i: {"a": 7})
    assert changes(exports(spark, a, b)) == {(2, "added", "", "a"), (2, "removed", "b.c", "")}


def test_nulls_bad_bodies_and_empty(spark):
    df = exports(spark, lines(lambda i: {"a": i}), [None, {"line_ref": "z"}])
    assert changes(df) == {(2, "removed", "a", "")}
    bad = spark.createDataFrame([(1, None, 1, "{}", "", 1), (2, 1, None, "{}", "", 1), (3, 2, 1, "{oops", "", 1), (None, 2, 2, '{"a":1}', "", 1)], SCHEMA)
    assert changes(bad) == {(2, "added", "", "a")}
    assert changes(spark.createDataFrame([], SCHEMA)) == set()


def test_unified_follows_renames(spark):
    a = lines(lambda i: {"segmentation_label": f"x{i}", "segmentation_confidence": i / 10, "annotations": {"hand": "h"}})
    b = lines(lambda i: {"kind": f"x{i}", "segmentation_confidence": str(i / 10), "annotations": json.dumps({"hand": "h"})})
    c = lines(lambda i: {"cls": f"x{i}", "segmentation_confidence": "bad", "annotations": [{"name": "hand", "value": "h"}]})
    df = exports(spark, a, b, c)
    rows = drift.unified(df, drift.changes(df)).collect()
    assert len(rows) == 18 and all(r.label == f"x{r.line_ref[1:]}" and r.hand == "h" for r in rows)
    assert all((r.confidence == int(r.line_ref[1:]) / 10) if r.export_no < 3 else r.confidence is None for r in rows)


def unified(df):
    return drift.unified(df, drift.changes(df))


def test_unified_keeps_every_path(spark):
    a = lines(lambda i: {"seg_label": f"x{i}", "extra": i, "annotations": {"marginal": i % 2 == 0, "odd": {"z": i}}, "pipeline": {"model": f"m{i}"}})
    b = lines(lambda i: {"content": f"t{i}", "text": f"other {i}", "Label": "own", "annotations": "no object", "pipeline": json.dumps({"model": "n"})})
    df = exports(spark, a, stream=1).union(exports(spark, b, stream=2).withColumn("json_no", F.col("json_no") + 100)).union(
        spark.createDataFrame([(200, None, None, '{"seg_conf": 0.5}', "", 1), (201, 1, 1, "{oops", "", 1)], SCHEMA)
    )
    rows = {r.json_no: r for r in unified(df).collect()}
    assert len(rows) == 14
    assert all(rows[i + 1][c] == v for i in range(6) for c, v in {"label": f"x{i}", "extra": str(i), "is_marginal": "true" if i % 2 == 0 else "false", "annotations__odd": f'{{"z":{i}}}', "model": f"m{i}"}.items())
    assert all(rows[i + 101][c] == v for i in range(6) for c, v in {"text": f"other {i}", "content": f"t{i}", "Label_2": "own", "annotations": "no object", "model": "n"}.items())
    assert rows[200].confidence == 0.5 and rows[201].line_ref is None and rows[201].label is None


def test_unified_routes_by_stream(spark):
    """A name that means the label in one stream is the confidence's in another."""
    a, b = lines(lambda i: {"segmentation_label": f"x{i}"}), lines(lambda i: {"k": f"x{i}"})
    c, d = lines(lambda i: {"segmentation_confidence": f"0.{i}"}), lines(lambda i: {"k": f"0.{i}"})
    df = exports(spark, a, b, stream=1).union(exports(spark, c, d, stream=2).withColumn("json_no", F.col("json_no") + 100))
    for r in unified(df).collect():
        i = int(r.line_ref[1:])
        assert (r.label, r.confidence) == ((f"x{i}", None) if r.stream_no == 1 else (None, i / 10))


def test_a_rename_counts_in_its_own_stream(spark):
    a, b = lines(lambda i: {"text": f"t{i}"}), lines(lambda i: {"caption": f"t{i}"})
    c = lines(lambda i: {"text": f"t{i}", "caption": f"c{i}"})
    d = lines(lambda i: {"caption": f"c{i}"})
    df = exports(spark, a, b, stream=8).union(exports(spark, c, d, stream=9).withColumn("json_no", F.col("json_no") + 100))
    for r in unified(df).collect():
        i = r.line_ref[1:]
        if r.stream_no == 8:
            assert (r.text, r.caption) == (f"t{i}", None)
        else:
            assert (r.text, r.caption) == (f"t{i}" if r.export_no == 1 else None, f"c{i}")


def test_deep_fields_arrays_and_kinds_of_numbers(spark):
    a = lines(lambda i: {"meta": {"scan": {"dpi": 300 + i}}, "n": 1000, "tags": [{"k": f"a{i}"}, {"k": f"b{i}"}], "deep": {"x": {"y": {"z": 1}}}})
    b = lines(lambda i: {"meta": {"scan": {"resolution": 300 + i}}, "n": 1000.5, "tags": [{"key": f"a{i}"}, {"key": f"b{i}"}], "deep": "gone"})
    df = exports(spark, a, b)
    got = {(r.drift_kind, r.old_path, r.new_path, r.old_type, r.new_type) for r in drift.changes(df, depth=None, arrays=True, split_numbers=True).collect()}
    assert got == {
        ("renamed", "meta.scan.dpi", "meta.scan.resolution", "integer", "integer"), ("retyped", "n", "n", "integer", "number"),
        ("renamed", "tags[].k", "tags[].key", "string", "string"), ("retyped", "deep", "deep", "object", "string"),
    }
    assert changes(df) == {(2, "retyped", "deep", "deep")}
    assert unified(df).filter("export_no = 1").count() == 6


def test_versions(spark):
    a, b = lines(lambda i: {"a": i}), lines(lambda i: {"b": "x"})
    recs = drift.records(exports(spark, a, a, b, a))
    got = drift.fingerprints(recs, drift.layouts(drift.fields(recs))).orderBy("export_no").collect()
    assert [r.version for r in got] == [1, 1, 2, 3] and got[0].fingerprint == got[3].fingerprint
