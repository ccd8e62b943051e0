"""Kernels on small tiles against whole rasters in plain numpy, lines against brute force, order statistics against sorting."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orestrata.operators import terrain, tiles
from orestrata.operators.selection import at_ranks, median


def pixels(spark, *pages, column="v"):
    rows = [(p, r, c, int(x[r, c])) for p, x in enumerate(pages) for r in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, f"page_id long, row_id int, col_id int, {column} long")


def array(df, page, shape, column):
    out = np.zeros(shape, dtype=np.int64)
    for r in df.where(f"page_id = {page}").collect():
        out[r.row_id, r.col_id] = r[column]
    return out


def pages():
    rng = np.random.default_rng(5)
    return [rng.integers(0, 256, (23, 31)), (rng.random((9, 40)) < 0.6) * 255]


def naive(x, shape, anchor, of, outside):
    out = np.empty_like(x)
    for r in range(x.shape[0]):
        for c in range(x.shape[1]):
            v = [outside]
            for i, j in zip(*np.nonzero(shape)):
                a, b = r + i - anchor[0], c + j - anchor[1]
                if 0 <= a < x.shape[0] and 0 <= b < x.shape[1]:
                    v.append(x[a, b])
            out[r, c] = of(v)
    return out


@pytest.mark.parametrize("shape", [tiles.SPOT2, tiles.SPOT3, np.ones((1, 5), int), np.ones((4, 3), int)], ids=["two", "three", "line", "box"])
def test_opening_and_closing_over_tile_edges(spark, shape):
    anchor = (shape.shape[0] // 2, shape.shape[1] // 2)
    least = lambda x: naive(x, shape, anchor, min, 10**9)
    most = lambda x: naive(x, shape, anchor, max, -(10**9))
    ps = pages()
    df = pixels(spark, *ps)
    a, b = tiles.opened(df, shape, side=16).cache(), tiles.closed(df, shape, side=16).cache()
    for k, x in enumerate(ps):
        x = x.astype(np.int64)
        assert (array(a, k, x.shape, "v") == most(least(x))).all()
        assert (array(b, k, x.shape, "v") == least(most(x))).all()


def test_threshold_over_tile_edges(spark):
    ps = pages()
    got = tiles.thresholded(pixels(spark, *ps), side=8).cache()
    w = tiles.gaussian(11)
    assert abs(w.sum() - 1) < 1e-12 and w[5] == w.max()
    for k, x in enumerate(ps):
        padded = np.pad(x.astype(float), 5, mode="edge")
        mean = np.rint(sum(w[i] * w[j] * padded[i : i + x.shape[0], j : j + x.shape[1]] for i in range(11) for j in range(11)))
        ink = np.where(x - mean > -2, 255, 0)
        ink = 255 - ink if ink.mean() > 127 else ink
        assert (array(got, k, x.shape, "ink") == ink).all()


def test_slopes_over_tile_edges(spark):
    z = np.random.default_rng(1).normal(size=(20, 33))
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(20) for c in range(33)], "row_id int, col_id int, z double")
    p = np.pad(z, 1, mode="symmetric")
    s = p[:-2] + 2 * p[1:-1] + p[2:]
    gx = s[:, 2:] - s[:, :-2]
    got = {(r.row_id, r.col_id): r.gx for r in tiles.on_tiles(df, tiles.sobel_kernel, 1, ["z"], "gx double, gy double", side=7).collect()}
    assert len(got) == z.size and all(abs(got[r, c] - gx[r, c]) < 1e-12 for r, c in got)
    assert terrain.slope_aspect(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1, 12), min_size=1, max_size=14), st.integers(1, 3))
def test_lower_envelope(heights, step):
    p = np.arange(len(heights)) * step
    h = np.array(heights)
    want = [min(((a - b) ** 2 + g * g for b, g in zip(p.tolist(), heights) if g >= 0), default=-1) for a in p.tolist()]
    assert tiles.lower_envelope(p, h).tolist() == want


def test_distances(spark):
    rng = np.random.default_rng(3)
    cells = [(r, c) for r in range(17) for c in range(23) if rng.random() < 0.9]
    points = [(3, 4), (3, 4), (16, 20), (9, 9), (99, 1)]
    grid, marks = spark.createDataFrame(cells, "row_id int, col_id int"), spark.createDataFrame(points, "row_id int, col_id int")
    on = [p for p in set(points) if p in set(cells)]
    got = {(r.row_id, r.col_id): r.d2 for r in tiles.squared_distances(grid, marks).collect()}
    assert got == {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in on) for r, c in cells}
    assert {r.d2 for r in tiles.squared_distances(grid, marks.where("row_id = 99")).collect()} == {None}


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    for x in ([1.0], [2.0, 1.0], [5.0] * 40 + [7.0], list(rng.normal(size=1001)), [1e308, -1e308, 0.0, 1e-300], [float("inf"), 1.0, float("-inf"), 2.0], list(np.exp(rng.normal(size=500) * 40))):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        assert median(df, "v") == float(np.median(x)), x[:5]
        assert at_ranks(df, "v", [0, len(x) - 1], bins=3) == [min(x), max(x)]
    assert median(df.limit(0), "v") is None
