import json

from pyspark.sql import functions as F

from pagelens.operators import nested

SCHEMA = "page_no long, body string, kind string"


def table(spark, bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b), "x") for i, b in enumerate(bodies)], SCHEMA)


def found(spark, bodies, **options):
    return nested.bridges(table(spark, bodies), **options)


def paths(df):
    return {(r.page_no, r.kind, r.node_path, r.parent_path) for r in df.collect()}


def test_paths_positions_and_lone_objects(spark):
    page = {
        "regions": [None, {"regions": {"lines": [{"polygon": "1,2;3,4", "words": [None, {"text": "a"}]}]}}],
        "lines": {"polygon": [None, {"x": 1, "y": 2}, [3, 4]]},
    }
    assert paths(found(spark, [page])) == {
        (0, "region", "r1", ""), (0, "region", "r1/r0", "r1"), (0, "line", "r1/r0/l0", "r1/r0"), (0, "word", "r1/r0/l0/w1", "r1/r0/l0"),
        (0, "point", "r1/r0/l0/p0", "r1/r0/l0"), (0, "point", "r1/r0/l0/p1", "r1/r0/l0"),
        (0, "line", "l0", ""), (0, "point", "l0/p1", "l0"), (0, "point", "l0/p2", "l0"),
    }


def test_equal_objects_have_one_identity_and_all_occurrences_stay(spark):
    line = {"polygon": "1,2 3,4", "words": [{"text": "a", "confidence": 0.5}]}
    same = {"words": {"confidence": 0.5, "text": "a", "extra": None}, "polygon": [{"x": 1, "y": 2.0}, [3, 4]]}
    bodies = [{"lines": [line, same]}, {"regions": [{"lines": [line]}]}]
    rows = found(spark, bodies).cache()
    ids = {r.object_id for r in rows.filter("kind = 'line'").collect()}
    assert len(ids) == 1
    assert rows.filter("kind = 'line'").count() == 3
    assert nested.objects(table(spark, bodies)).filter("kind = 'line'").first().n_occurrences == 3
    other = found(spark, [{"lines": [{**line, "words": []}]}]).filter("kind = 'line'").first().object_id
    assert other not in ids


def test_bad_bodies_and_repeats(spark):
    df = spark.createDataFrame([(1, "{", "k"), (2, None, "k"), (3, "[1]", "k"), (4, "{}", "k"), (5, '{"lines":[{}]}', "k"), (5, '{"lines":[{}]}', "k"), (None, '{"lines":[{}]}', None)], SCHEMA)
    assert paths(nested.bridges(df)) == {(5, "line", "l0", ""), (None, "line", "l0", "")}
    empty = spark.createDataFrame([], SCHEMA)
    assert nested.bridges(empty).count() == 0 and nested.objects(empty).count() == 0


def test_deep_nesting_and_long_text(spark):
    page = {"lines": [{"words": [{"text": "x" * 500_000}]}]}
    for _ in range(150):
        page = {"regions": [page]}
    assert found(spark, [page]).filter("kind = 'region'").count() == 150
    assert nested.objects(table(spark, [page])).agg(F.max(F.length("content"))).first()[0] > 500_000


def test_elements_that_are_no_objects_are_kept(spark):
    lines = [{"words": ["a"]}, {"words": ["b", "c"]}, {"words": "d"}, {"words": [None, {"t": 1}]}, {"words": [{"t": 1}]}, {"words": [["e"], {"t": 1}]}]
    rows = nested.flat_table(table(spark, [{"lines": lines}]), "line", {"words": "$.words"}).orderBy("node_path").collect()
    assert [r.words for r in rows] == ['{"0":"a"}', '{"0":"b","1":"c"}', "d", None, None, '{"0":["e"]}']
    assert len({r.object_id for r in rows}) == 6


def test_odd_polygons_are_kept(spark):
    odd = ["1,2 3", 7, [1, 2], [{"x": 1, "y": 2, "z": 3}], [[1, 2, 3]], "1,2 x,4"]
    plain = ["1,2 3,4", [[1, 2], [3, 4]], None, [None, {"x": 1, "y": 2}]]
    rows = nested.flat_table(table(spark, [{"lines": [{"polygon": p} for p in odd + plain]}]), "line", {"polygon": "$.polygon"}).orderBy("ordinal").collect()
    assert all(r.polygon is not None for r in rows[: len(odd)]) and all(r.polygon is None for r in rows[len(odd) :])
    assert len({r.object_id for r in rows}) == len(rows) - 1


def test_any_member_can_be_a_child(spark):
    page = {"meta": {"scan": {"dpi": 300}}, "regions": [{"polygon": "1,2", "tags": ["x", {"k": [{"v": 1}]}], "lines": [{"transcription": [{"text": "a"}]}]}]}
    rows = found(spark, [page], polygons=("region", "line"), rest=True).collect()
    assert {(r.kind, r.node_path, r.parent_path) for r in rows} == {
        ("meta", "meta0", ""), ("scan", "meta0/scan0", "meta0"), ("region", "r0", ""), ("point", "r0/p0", "r0"), ("tags", "r0/tags1", "r0"), ("k", "r0/tags1/k0", "r0/tags1"),
        ("line", "r0/l0", "r0"), ("transcription", "r0/l0/transcription0", "r0/l0"),
    }
    every = nested.objects(table(spark, [page]), rest=True, polygons=("region",)).collect()
    assert {r.content for r in every} >= {'{"dpi":300}', '{"tags":{"0":"x"}}', '{"v":1}', '{"text":"a"}'}


def test_a_page_can_be_put_together_again(spark, data):
    """Objects and bridges hold all of every body but nulls and the spelling of whole polygons."""
    pages = spark.read.parquet(f"{data}/page_documents.parquet")
    options = {"polygons": (), "rest": True}
    content = {r.object_id: json.loads(r.content) for r in nested.objects(pages, **options).collect()}
    kids = {}
    for r in nested.bridges(pages, **options).collect():
        kids.setdefault((r.page_no, r.parent_path), []).append(r)
    member = {k: m for m, k, _ in nested.CHILDREN}

    def build(page_no, path, own):
        out = {k: v for k, v in own.items()}
        for r in kids.get((page_no, path), []):
            out.setdefault(member.get(r.kind, r.kind), {})[str(r.ordinal)] = build(page_no, r.node_path, content[r.object_id])
        return out

    def bare(value, inside=None):
        """The body with arrays that hold objects as maps from position, without nulls and empty arrays of children."""
        if isinstance(value, dict):
            out = {}
            for k, v in value.items():
                if v is None:
                    continue
                child = k in member.values()
                if isinstance(v, dict):
                    v = {"0": bare(v)}
                elif isinstance(v, list) and (child or any(isinstance(x, dict) for x in v)):
                    v = {str(i): bare(x) if isinstance(x, dict) else x for i, x in enumerate(v) if x is not None}
                    if not v:
                        continue
                out[k] = v
            return out
        return value

    for page_no, body in {(r.page_no, r.body) for r in pages.collect()}:
        try:
            page = json.loads(body)
        except (TypeError, ValueError):
            continue
        top = bare(page)
        built = build(page_no, "", {})
        # The page's own scalars are no object of the tables; all that is below must be equal.
        assert {k: v for k, v in top.items() if k in built} == built


def test_every_parent_exists(spark, data):
    rows = nested.bridges(spark.read.parquet(f"{data}/page_documents.parquet")).cache()
    keys = {(r.page_no, r.node_path) for r in rows.collect()}
    assert len(keys) == rows.count()
    assert all((r.page_no, r.parent_path) in keys for r in rows.collect() if r.parent_path)


def test_flat_table(spark):
    pages = table(spark, [{"lines": [{"transcription": [{"text": "abc"}]}]}])
    r = nested.flat_table(pages, "line", {"text": "$.transcription[0].text"}).first()
    assert (r.node_path, r.parent_path, r.text) == ("l0", "", "abc")
