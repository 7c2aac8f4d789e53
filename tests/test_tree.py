import pytest
from pyspark.sql import functions as F

from pagelens import cli
from pagelens.functions import geometry as G
from pagelens.functions import text as T
from pagelens.operators import compare, tree
from pagelens.plans import training

NODES = "doc_id string, node_id long, parent_id long, depth int, pos long, conf double, xmin double, ymin double, xmax double, ymax double"


@pytest.fixture()
def nodes(spark):
    rows = [
        ("d", 0, None, 0, 0, None, 0.0, 0.0, 100.0, 100.0), ("d", 1, 0, 1, 0, 0.5, 10.0, 60.0, 60.0, 80.0), ("d", 2, 0, 1, 1, 0.9, 10.0, 10.0, 60.0, 40.0),
        ("d", 3, 2, 2, 0, 0.8, 10.0, 30.0, 60.0, 40.0), ("d", 4, 2, 2, 1, 0.7, 10.0, 10.0, 60.0, 20.0),
    ]
    return spark.createDataFrame(rows, NODES)


def test_attach(spark, nodes):
    kind = "doc_id string, node_id long, texts array<struct<conf:double,text:string>>"
    one = spark.createDataFrame([("d", 3, [(0.2, "low"), (None, "none"), (0.9, "high")])], kind)
    two = spark.createDataFrame([("d", 3, [(0.9, "late"), (0.95, "top")])], kind)
    got = {r.node_id: [x.text for x in r.texts] for r in tree.attach(tree.attach(nodes, one), two).collect()}
    assert got[3] == ["top", "high", "late", "low", "none"] and got[0] == []
    notes = lambda m: spark.createDataFrame([("d", 0, m)], "doc_id string, node_id long, annotations map<string,string>")
    got = {r.node_id: r.annotations for r in tree.attach(tree.attach(nodes, notes({"a": "1", "b": "2"})), notes({"b": "3"})).collect()}
    assert got[0] == {"a": "1", "b": "3"} and got[1] == {}
    more = spark.createDataFrame([("d", 2, 10, 0, 0.4, 1.0, 2.0, 3.0, 4.0), ("d", 1, 11, 0, 0.4, 1.0, 2.0, 3.0, 4.0)], "doc_id string, parent_id long, node_id long, pos long, conf double, xmin double, ymin double, xmax double, ymax double")
    got = {r.node_id: (r.parent_id, r.pos, r.depth) for r in tree.attach(nodes, more).collect()}
    assert got[10] == (2, 2, 2) and got[11] == (1, 0, 2) and len(got) == 7


def test_inference_goes_over_leaves(nodes):
    seen = []

    def model(leaves):
        seen.extend(sorted(r.node_id for r in leaves.collect()))
        return leaves.select("doc_id", "node_id", F.array(F.struct(F.lit(0.5).alias("conf"), F.concat(F.lit("t"), "node_id").alias("text"))).alias("texts"))

    done = tree.run(nodes, [("TextRecognition", {"model": model}), ("WordSegmentation", {})], log=True)
    rows = done.collect()
    assert seen == [1, 3, 4] and {r.texts[0].text for r in rows if r.texts} == {"t1", "t3", "t4"}
    words = [r for r in rows if r.text]
    assert {(r.parent_id, r.text, r.depth) for r in words} == {(1, "t1", 2), (3, "t3", 3), (4, "t4", 3)} and all(10 <= r.xmin < r.xmax <= 60 for r in words)
    assert all(r.steps[-1] == "WordSegmentation" for r in rows)


def test_orders_exports_and_predictions(spark, nodes):
    got = {r.node_id: r.pos for r in tree.run(nodes, [("OrderLines", {})]).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}
    space = G.box(*(F.lit(v) for v in (0.0, 50.0, 100.0, 100.0)))
    got = {r.node_id: r.pos for r in tree.run(nodes, [("ReadingOrderMarginalia", {"printspace": space})]).collect()}
    assert got[2] == 0 and got[1] == 1 and got[4] == 0 and got[3] == 1
    kept = []
    out = tree.run(nodes, [("Export", {"write": lambda n: kept.append(n.count())}), ("QualityPrediction", {"predictions": spark.createDataFrame([("d", 0.25)], "doc_id string, pred double"), "target": "t"})])
    assert kept == [5] and {r.node_id: r.annotations for r in out.collect()}[0] == {"quality_prediction.t": "0.25"}


def test_cycles_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(tree, "MAX_DEPTH", 5)
    loop = spark.createDataFrame([("d", 1, 2), ("d", 2, 1)], "doc_id string, node_id long, parent_id long")
    with pytest.raises(ValueError):
        tree.ancestors(loop)


def test_files_by_stem_and_unique_names(spark):
    files = spark.createDataFrame([("/a/x.png",), ("/b/x.JPG",), ("/b/x.txt",), ("/a/y.tif",)], "path string")
    wanted = spark.createDataFrame([("x",), ("z",)], "stem string")
    assert {tuple(r) for r in compare.all_existing(wanted, files, (".png", ".jpg")).collect()} == {("x", "/a/x.png"), ("x", "/b/x.JPG"), ("z", None)}
    same = spark.createDataFrame([("/a/p.xml",), ("/a//p.xml",), ("/A/./p.xml",), ("/b/p.xml",), ("/b/q.xml",)], "path string")
    got = compare.unique_files(same).collect()
    assert len(got) == 3 and len({r.name for r in got}) == 3 and "q.xml" in {r.name for r in got}
    assert all(r.name.startswith("p_") and len(r.name) == 18 for r in got if r.name != "q.xml")


def test_best_label(spark):
    df = spark.createDataFrame([([0.1, 3.0, 3.0],), ([],)], "l array<double>")
    assert [r[0] for r in df.select(T.best_label(["a", "b", "c"], F.col("l"))).collect()] == ["b", None]


@pytest.mark.parametrize(
    "argv",
    [
        ["build"], ["build", "--out", "x"], ["build", "--out", "x", "--dataset", "t", "g", "p", "--feature", "text,nope"], ["build", "--out", "x", "--dataset", "t", "g", "p", "--feature", "lm"],
        ["build", "--out", "x", "--dataset", "t", "g", "p", "--feature", "ngram"], ["build", "--out", "x", "--dataset", "t", "g", "p", "--target", "target_no"], ["train"], ["nothing"],
    ],
)
def test_wrong_arguments_are_told(argv, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(argv)
    assert e.value.code == 2 and capsys.readouterr().err


def test_lists_and_presets(capsys):
    assert cli.values(["a, b", "c,,"]) == ["a", "b", "c"] and cli.values([]) is None
    assert cli.main(["build", "--list-features"]) == 0 and "layout" in capsys.readouterr().out
    assert training.config("fixed", ["t"]).n_trials == 0 and training.config("stable", ["t"], top_k=3).top_k == 3
    with pytest.raises(ValueError):
        training.config("no", ["t"])
