import json
import math
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.functions import stats as S
from pagelens.operators import boosting
from pagelens.plans import dataset, features, inference
from pagelens.sources import files, ground_truth, page_json, sinks
from pagelens.streaming import scoring

PAGE_XML = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page>
 <TextRegion><Coords points="0,0 100,0 100,40 0,40"/>
  <TextLine><Coords points="0,0 100,0 100,10 0,10"/>
   <TextEquiv conf="0.4"><Unicode>low</Unicode></TextEquiv><TextEquiv conf="0.9"><Unicode> high </Unicode></TextEquiv></TextLine>
  <TextLine><Word><TextEquiv><Unicode>two</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>words</Unicode></TextEquiv></Word></TextLine>
  <TextLine><Coords points="0,30 50,30 50,40 0,40"/></TextLine>
 </TextRegion></Page></PcGts>"""
ALTO_XML = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace>
 <TextBlock HPOS="5" VPOS="5" WIDTH="90" HEIGHT="50">
  <TextLine><String CONTENT="ham-" SUBS_CONTENT="hammar" HPOS="5" VPOS="6" WIDTH="20" HEIGHT="8"/><String CONTENT="ok" HPOS="30" VPOS="5" WIDTH="10" HEIGHT="10"/></TextLine>
  <TextLine><String CONTENT=""/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""


def current(lines, box="100,200 500,200 500,600 100,600"):
    return {"regions": [{"polygon": box, "annotations": {"segmentation_label": "TextRegion", "segmentation_confidence": 0.8}, "regions": lines}]}


def line(polygon, text="recognized text"):
    return {
        "polygon": polygon, "annotations": {"segmentation_label": "textline", "segmentation_confidence": 0.75},
        "transcription": [{"text": text, "confidence": 0.9, "token_scores": [["recognized", 0.7]]}], "regions": [],
    }


def test_ground_truth_page_and_alto():
    page = ground_truth.read_xml(PAGE_XML)
    assert [(x["text"], x["xmin"], x["ymax"]) for x in page["lines"]] == [("high", 0, 10), ("two words", None, None), ("", 0, 40)]
    assert page["regions"] == [{"xmin": 0, "ymin": 0, "xmax": 100, "ymax": 40}] and len(page["boxes"]) == 2
    alto = ground_truth.read_xml(ALTO_XML)
    assert [(x["text"], x["xmin"], x["ymin"], x["xmax"], x["ymax"]) for x in alto["lines"]] == [("hammar ok", 5, 5, 40, 15)]
    assert len(alto["geoms"]) == 2 and alto["geoms"][1]["xmin"] is None and alto["regions"] == [{"xmin": 5, "ymin": 5, "xmax": 95, "ymax": 55}]


def test_crop_local_lines_move_and_absolute_ones_do_not():
    local = page_json.read_page(json.dumps(current([line("10,20 390,20 390,60 10,60")])))
    absolute = page_json.read_page(json.dumps(current([line("110,220 490,220 490,260 110,260")])))
    for page in (local, absolute):
        assert (page["lines"][0]["xmin"], page["lines"][0]["ymin"]) == (110, 220)
        assert page["lines"][0]["tokens"] == [0.7] and page["lines"][0]["score"] == 0.9 and page["regions"][0]["seg_conf"] == 0.8
        assert [d["kind"] for d in page["detections"]] == ["region", "line"]


def test_legacy_layout_and_rules():
    page = page_json.read_page(json.dumps({"contains": [
        {"segmentation_label": "TextRegion", "segmentation_confidence": None, "annotations": {"segmentation_confidence": 0.5}, "bbox": {"xmin": 0, "ymin": 0, "xmax": 9, "ymax": 9},
         "contains": [{"segmentation_label": "TextLine", "bbox": {"xmin": 1, "ymin": 1, "xmax": 8, "ymax": 2}, "text_result": {"texts": [" "], "scores": [0.1]}}]},
        {"segmentation_label": "TextLine", "bbox": {"xmin": 0, "ymin": 0, "xmax": 5, "ymax": 1}, "text_result": {"texts": [""], "scores": []}},
    ]}))
    assert page["regions"][0]["seg_conf"] is None and page["regions"][0]["n_lines"] == 0
    assert [x["region_pos"] for x in page["lines"]] == [None] and page["lines"][0]["score"] is None
    assert [d["score"] for d in page["detections"]] == [1.0, 1.0, 1.0]


def test_unreadable_pages_become_errors(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, "{}"), (3, "{}")], "page_no long, body string")
    pages = page_json.pages(df).cache()
    assert {r.page_no for r in page_json.errors(pages).collect()} == {1, 2} and pages.count() == 3
    assert features.page_features(pages).first().num_lines == 0


def spec_stats(v):
    v = np.array([x for x in v if x is not None and math.isfinite(x)])
    if not len(v):
        return [math.nan] * 5
    return [v.mean(), v.std(), v.min(), v.max(), v.std() / v.mean() if v.mean() else math.nan]


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0], [5.0, 5.0], [], [None, math.nan, math.inf], [-1.0, 1.0], [0.3, 0.6, 0.7, 1.0]])
def test_array_statistics(spark, values):
    df = spark.createDataFrame([(values,)], "v array<double>")
    row = df.select(*(c.alias(n) for n, c in S.array_stats(F.col("v"), "p").items()), S.array_entropy(F.col("v")).alias("e"), *(c.alias(n) for n, c in S.array_histogram(F.col("v"), S.linspace(0, 1, 10), "h").items())).first()
    assert [row[f"p_{k}"] for k in S.STATS] == pytest.approx(spec_stats(values), nan_ok=True)
    finite = [x for x in values if x is not None and math.isfinite(x)]
    want, _ = np.histogram(finite, bins=10, range=(0, 1))
    assert [row[f"h_hist_bin_{i}"] for i in range(10)] == pytest.approx((want / max(1, want.sum())).tolist())
    if values == [1.0, 2.0, 4.0]:
        assert row.e == pytest.approx(0.8112781244591328) and row.p_cv == pytest.approx(0.5345224838248488)
    elif len(set(finite)) == 1:
        assert row.e == 0
    elif not finite:
        assert math.isnan(row.e)


def test_edges():
    assert S.sanitize_edges(None) == list(S.FALLBACK_EDGES) and S.sanitize_edges([0.5]) == list(S.FALLBACK_EDGES)
    e = S.sanitize_edges([0.9, 0.2, 0.9, 1.0, 1.0, math.nan])
    assert all(a < b for a, b in zip(e, e[1:])) and e[0] == 0 and e[-1] > 1


def test_page_features_against_a_plain_restatement(spark):
    rng = np.random.default_rng(4)
    body = current([line(f"{x},{y} {x + 50},{y} {x + 50},{y + 12} {x},{y + 12}", "ab 1! " * int(rng.integers(1, 4))) for x, y in rng.integers(110, 400, (6, 2)).tolist()])
    pages = page_json.pages(spark.createDataFrame([(1, json.dumps(body))], "page_no long, body string"))
    f = features.page_features(pages).first().asDict()
    assert len(f) == 145
    lines = page_json.read_page(json.dumps(body))["lines"]
    ys = sorted((x["ymin"] + x["ymax"]) / 2 for x in lines)
    gaps = [b - a for a, b in zip(ys, ys[1:]) if b > a]
    assert [f[f"line_spacing_{k}"] for k in S.STATS] == pytest.approx(spec_stats(gaps), nan_ok=True)
    stored = [(x["ymin"] + x["ymax"]) / 2 for x in lines]
    assert f["reading_order_inversions"] == sum(b < a for a, b in zip(stored, stored[1:]))
    over = sum(a["xmin"] < b["xmax"] and b["xmin"] < a["xmax"] and a["ymin"] < b["ymax"] and b["ymin"] < a["ymax"] for i, a in enumerate(lines) for b in lines[i + 1 :])
    assert f["line_overlap_count"] == over
    assert f["text_density"] == pytest.approx(sum((x["xmax"] - x["xmin"]) * (x["ymax"] - x["ymin"]) for x in lines) / 160000)
    assert f["region_xmin_std_mean"] == pytest.approx(np.std([x["xmin"] for x in lines]))
    text = "\n".join(x["text"] for x in lines)
    assert f["char_digit_ratio"] == pytest.approx(sum(c.isdigit() for c in text) / len(text))
    assert f["total_words"] == len(text.split())
    chars = [len(x["text"]) for x in lines]
    assert f["frac_short_lines"] == pytest.approx(np.mean(np.array(chars) < np.percentile(chars, 20)))
    hist, _ = np.histogram([(x["xmin"] + x["xmax"]) / 2 for x in lines], bins=10)
    assert f["num_columns_est"] == max(1, min(4, int((hist > 0.2 * hist.max()).sum())))
    with pytest.raises(ValueError):
        features.page_features(pages, ["nope"])


def test_build_dataset_and_exports(spark, tmp_path):
    gt, pred = tmp_path / "gt", tmp_path / "pred"
    (gt / "sub").mkdir(parents=True)
    pred.mkdir()
    (gt / "sub" / "a.xml").write_text(PAGE_XML)
    (gt / "b.xml").write_text("<broken")
    (gt / "only.xml").write_text(PAGE_XML)
    for n in "abc":
        (pred / f"{n}.json").write_text(json.dumps(current([line("110,220 490,220 490,260 110,260", "high")])))
    wide, failed = dataset.build(spark, [("t1", str(gt), str(pred)), ("t2", str(gt), str(pred))], ["text", "layout"], ["target_bow_f1"])
    assert {r.page_id for r in wide.collect()} == {"t1__a", "t2__a"} and wide.columns[:3] == ["page_id", "source_page_id", "dataset_tag"]
    assert wide.columns[3:] == sorted(wide.columns[3:])
    assert {(r.page_id, r.stage) for r in failed.collect()} == {("t1__b", "ground_truth"), ("t2__b", "ground_truth")}
    assert sinks.wide_csv(wide, str(tmp_path / "csv"), ["page_id"])
    assert files.csv_tables(spark, [str(tmp_path / "csv")]).count() == 2


def test_page_exports_read_back(spark):
    body = current([line("110,220 490,220 490,260 110,260", 'åäö <&> "q" bro-'), line("110,300 490,300 490,340 110,340", "ken next")])
    pages = page_json.pages(spark.createDataFrame([(7, json.dumps(body))], "page_no long, body string"))
    row = pages.select(*(sinks.serializer(n)().alias(n) for n in ("ALTO", "page", "json", "txt"))).first()
    page, alto = ground_truth.read_xml(row["page"]), ground_truth.read_xml(row["ALTO"])
    assert [x["text"] for x in page["lines"]] == ['åäö <&> "q" bro-', "ken next"] and page["lines"][0]["xmin"] == 110
    assert alto["text"].split("\n")[0] == 'åäö <&> "q" broken' and alto["regions"][0]["xmax"] == 500
    assert json.loads(row["json"])["page_no"] == 7 and row["txt"].endswith("ken next")
    assert [x["polygon"] for x in page["geoms"]] == ["110,220 490,220 490,260 110,260", "110,300 490,300 490,340 110,340"]
    boxes = [(float(s.get("HPOS")), float(s.get("WIDTH"))) for s in ET.fromstring(row["ALTO"].encode()).iter() if s.tag.endswith("String")]
    assert len(boxes) == 6 and len(set(boxes)) == 6 and all(110 <= x and x + w <= 490 for x, w in boxes)
    assert "recognised" in sinks.alto_page("x", [], [], ["recognised"]) and ground_truth.read_xml(sinks.alto_page("x", [], []))["lines"] == []
    with pytest.raises(ValueError):
        sinks.serializer("docx")


def test_json_leaves_out_what_is_empty(spark):
    body = current([{**line("110,220 490,220 490,260 110,260", ""), "transcription": [{"text": "", "confidence": 0.0}]}])
    pages = page_json.pages(spark.createDataFrame([(7, json.dumps(body)), (8, json.dumps({"lines": []}))], "page_no long, body string"))
    got = {r.page_no: json.loads(r.j) for r in pages.select("page_no", sinks.page_json().alias("j")).collect()}
    assert got[8] == {"page_no": 8}
    for x in got[7].get("lines", []):
        assert "text" not in x and x["tokens"] == [] and x["score"] == 0.0


def test_characters_without_a_form_in_xml():
    row = {"region_pos": None, "text": "a\x01b\x0c c", "score": None, "xmin": 0.0, "ymin": 0.0, "xmax": 90.0, "ymax": 9.0, "polygon": ""}
    assert ground_truth.read_xml(sinks.page_page("p", [], [row]))["lines"][0]["text"] == "ab c"
    assert ground_truth.read_xml(sinks.alto_page("p", [], [row]))["lines"][0]["text"] == "ab c"


def test_models_are_kept(spark, tmp_path):
    x = np.arange(40, dtype=float).reshape(20, 2)
    m = boosting.train(x, x[:, 0], ["a", "b"], boosting.Params(n_trees=3))
    sinks.save_models(spark, {"m": m}, str(tmp_path / "m"))
    assert np.allclose(sinks.load_models(spark, str(tmp_path / "m"))["m"].predict(x), m.predict(x))
    sinks.save_pca(spark, x[0], x[1:3], str(tmp_path / "p"))
    mean, components = sinks.load_pca(spark, str(tmp_path / "p"))
    assert np.allclose(mean, x[0]) and np.allclose(components, x[1:3])


def test_quality_is_written_into_the_tree(spark):
    """The prediction stands in the annotations of each page's own JSON, which is otherwise as it was."""
    bodies = [current([line("110,220 490,220 490,260 110,260", "high")]), {"lines": [], "annotations": {"x": 1, "quality_prediction": {"old": 2}}}]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(2, "{"), (3, None)]
    df = spark.createDataFrame(rows, "page_no long, body string")
    names = ["line_conf_mean", "num_lines"]
    x = np.array([[0.1, 1.0], [0.9, 5.0], [0.5, 2.0], [0.7, 3.0]] * 5)
    model = boosting.train(x, x[:, 1], names, boosting.Params(n_trees=5, min_child=0.1))
    got = {r.page_no: r for r in inference.annotated(df, {"target_bow_f1": model}).collect()}
    for i in (0, 1):
        out = json.loads(got[i].body)
        value = out["annotations"].pop("quality_prediction")
        assert value["target_bow_f1"] == pytest.approx(got[i].pred_target_bow_f1) and value.get("old") == (2 if i else None)
        before = dict(bodies[i])
        before["annotations"] = {k: v for k, v in (before.get("annotations") or {}).items() if k != "quality_prediction"}
        assert out == before
    assert got[2].body == "{" and got[2].pred_target_bow_f1 is None and got[3].body is None


def test_small_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# id\tword\n1\tab\n2\tcd\n\n3\tab\n")
    (tmp_path / "m.json").write_text(json.dumps([{"name": "t", "type": "table", "path": "t.tsv", "word_col": "word"}]))
    assert {(r[0], r[1]) for r in files.lexicons(spark, str(tmp_path / "m.json")).collect()} == {("t", "ab"), ("t", "cd")}
    (tmp_path / "s.txt").write_text("hus x..nn.1 a\nbil – b\n")
    assert [r[0] for r in files.dictionary_hits(spark, str(tmp_path / "s.txt")).collect()] == ["hus"]
    (tmp_path / "d.xml").write_text('<L><E><feat att="writtenForm" val="ord"/><x><feat att="writtenForm" val="två"/></x></E></L>')
    assert {r[0] for r in files.dmlex_words(spark, str(tmp_path / "d.xml")).collect()} == {"ord", "två"}
    (tmp_path / "c.txt").write_text("# head\n\none\n")
    assert [r[0] for r in files.corpus_lines(spark, str(tmp_path / "c.txt")).collect()] == ["one"]
    (tmp_path / "list").write_text("a\n\nb\n")
    assert files.inputs(listed=str(tmp_path / "list")) == ["a", "b"] and files.inputs(["x"]) == ["x"]
    with pytest.raises(ValueError):
        files.inputs(["x"], "y")
    sinks.save_edges(spark, {"line_conf": [0.0, 0.5, 1.0]}, str(tmp_path / "e.json"))
    assert sinks.load_edges(spark, str(tmp_path / "e.json"))["line_conf"][:2] == [0.0, 0.5]


def test_pages_are_scored_as_they_arrive(spark, tmp_path):
    body = json.dumps(current([line("110,220 490,220 490,260 110,260", "high")]))
    spark.createDataFrame([(1, body), (2, body)], "page_no long, body string").write.parquet(str(tmp_path / "in"))
    x = np.array([[1.0], [5.0]] * 10)
    model = boosting.train(x, x[:, 0], ["num_lines"], boosting.Params(n_trees=4, min_child=0.1))
    got = []
    stream = spark.readStream.schema("page_no long, body string").parquet(str(tmp_path / "in"))
    scoring.score_batches(stream, {"t": model}, None, lambda df, n: got.extend(df.select("page_no", "num_lines", "pred_t").collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.page_no for r in got) == [1, 2] and all(r.pred_t == pytest.approx(model.predict(np.array([[r.num_lines]]))[0]) for r in got)
