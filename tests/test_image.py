import numpy as np
import pytest

from pagelens.functions import image as I


def test_distances_and_strokes():
    dark = np.zeros((9, 9), dtype=bool)
    dark[2:7, 2:7] = True
    d = I.distances(dark)
    assert d[4, 4] == pytest.approx(3 * I.STRAIGHT) and d[2, 2] == pytest.approx(I.STRAIGHT) and d[0, 0] == 0
    rng = np.random.default_rng(2)
    dark = rng.random((25, 31)) < 0.8
    light = np.argwhere(~dark)
    want = np.zeros(dark.shape)
    for y, x in np.argwhere(dark):
        dy, dx = np.abs(light - (y, x)).T
        want[y, x] = (np.minimum(dy, dx) * I.DIAGONAL + np.abs(dy - dx) * I.STRAIGHT).min()
    assert np.allclose(I.distances(dark), want)


def flood(mask, diagonal):
    left, n = {tuple(p) for p in np.argwhere(mask)}, 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    while left:
        n += 1
        stack = [left.pop()]
        while stack:
            y, x = stack.pop()
            for a, b in near:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    stack.append((y + a, x + b))
    return n


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    rng = np.random.default_rng(1)
    for density in (0.1, 0.4, 0.6, 0.9):
        mask = rng.random((30, 40)) < density
        n, runs, number = I.components(mask, diagonal)
        assert n == flood(mask, diagonal) and (runs[:, 2] - runs[:, 1]).sum() == mask.sum() and len(set(number.tolist())) == n
    assert I.components(np.zeros((3, 3), dtype=bool))[0] == 0


def text_page(height=900, width=700, margins=(200, 180, 560, 720), slope=0.0):
    g = np.full((height, width), 240.0)
    for y in range(margins[1], margins[3], 20):
        for x in range(margins[0], margins[2]):
            if x % 9 < 6:
                top = int(y + slope * (x - margins[0]))
                g[top : top + 12, x] = 20.0
    return g


def test_skew():
    assert I.skew(text_page() < 100) == pytest.approx(0.0, abs=0.3)
    for angle in (-6.0, 3.0, 10.0):
        found = I.skew(text_page(slope=np.tan(np.deg2rad(angle))) < 100)
        assert found == pytest.approx(angle, abs=0.6)
    assert np.isnan(I.skew(np.zeros((5, 5), dtype=bool)))


def test_printspace():
    x0, y0, x1, y1 = I.printspace(text_page(), window=60)
    assert abs(x0 - 200) <= 35 and abs(x1 - 560) <= 35 and abs(y0 - 180) <= 45 and abs(y1 - 720) <= 45
    bordered = text_page()
    bordered[:, :12] = bordered[:12] = 5.0
    again = I.printspace(bordered, window=60)
    assert all(abs(a - b) <= 15 for a, b in zip(again, (x0, y0, x1, y1)))
    assert I.printspace(np.full((50, 40), 200.0)) == (0, 0, 40, 50)


def test_fold():
    g = text_page(600, 1000, (60, 50, 440, 550))
    g[:, 520:] = np.minimum(g[:, 520:], text_page(600, 480, (40, 50, 420, 550)))
    assert I.fold(g) is None
    g[:, 503:507] = 10.0
    assert I.fold(g) in range(503, 507)


def test_features_over_a_table(spark):
    g = text_page(60, 80, (20, 15, 60, 50)).astype(np.uint8)
    df = spark.createDataFrame([(("a", 60, 80, 1, 0, bytearray(g.tobytes())),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    row = I.image_features(df).first()
    assert row.path == "a" and all(not np.isnan(row[n]) for n in I.NAMES) and row.cc_count > 5
    box = I.page_layout(df, 5).first()
    assert box.path == "a" and box.xmin <= box.xmax <= 80
