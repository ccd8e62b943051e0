"""Runs, openings, connected shapes and angles against plain code on whole pages."""

import math

import numpy as np
import pytest

from orestrata.operators import layout, runs


def pixels(spark, *pages):
    rows = [(p, r, c, 255 * int(x[r, c])) for p, x in enumerate(pages) for r in range(x.shape[0]) for c in range(x.shape[1])]
    sizes = [(p, *map(int, x.shape)) for p, x in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, row_id int, col_id int, v int"), spark.createDataFrame(sizes, "page_id long, height int, width int")


def flood(free, seeds, steps):
    seen, todo = set(), [s for s in seeds if free[s]]
    while todo:
        s = todo.pop()
        if s in seen:
            continue
        seen.add(s)
        todo += [t for dr, dc in steps if 0 <= (t := (s[0] + dr, s[1] + dc))[0] < free.shape[0] and 0 <= t[1] < free.shape[1] and free[t]]
    return seen


EDGES = [(0, 1), (1, 0), (0, -1), (-1, 0)]
ALL = EDGES + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def boxes(x):
    """Boxes of shapes that touch the outside, by flooding."""
    padded = np.pad(x.astype(bool), 1)
    outside = flood(~padded, [(0, 0)], EDGES)
    left, out = {tuple(p) for p in np.argwhere(padded)}, []
    while left:
        shape = flood(padded, [next(iter(left))], ALL)
        left -= shape
        if any((r + a, c + b) in outside for r, c in shape for a, b in ALL):
            rs, cs = [r for r, _ in shape], [c for _, c in shape]
            out.append((min(cs) - 1, min(rs) - 1, max(cs) - min(cs) + 1, max(rs) - min(rs) + 1, len(shape)))
    return sorted(out)


def test_outer_shapes(spark):
    rng = np.random.default_rng(1)
    ring = np.zeros((12, 15), dtype=int)
    ring[2:10, 2:12] = 1
    ring[3:9, 3:11] = 0
    ring[5, 6] = 1  # in the hole
    ring[0, 14] = 1
    pages = [ring, (rng.random((20, 25)) < 0.35).astype(int), (rng.random((15, 15)) < 0.6).astype(int), np.eye(9, dtype=int), np.ones((4, 4), dtype=int)]
    px, sizes = pixels(spark, *pages)
    got = runs.outer_boxes(runs.ink_runs(px), sizes).collect()
    for p, x in enumerate(pages):
        assert sorted((r.x, r.y, r.w, r.h, r.pixels) for r in got if r.page_id == p) == boxes(x), p


@pytest.mark.parametrize("length", [5, 9])
def test_opening_by_a_line(spark, length):
    rng = np.random.default_rng(2)
    pages = [(rng.random((12, 30)) < 0.8).astype(int), np.ones((3, 4), dtype=int)]
    px, sizes = pixels(spark, *pages)
    kept = runs.long_runs(runs.ink_runs(px), sizes, length).collect()
    for p, x in enumerate(pages):
        half, want = length // 2, np.zeros_like(x)
        h, w = x.shape
        for r in range(h):
            stays = [c for c in range(w) if x[r, max(0, c - half) : c + half + 1].all()]
            for c in stays:
                want[r, max(0, c - half) : c + half + 1] = 1
        got = np.zeros_like(x)
        for k in kept:
            if k.page_id == p:
                got[k.row_id, k.x0 : k.x1 + 1] = 1
        assert (got == want).all(), p


def test_rulings_make_tables(spark):
    """A drawn table of three by three lines comes out as its intersections."""
    x = np.zeros((140, 160), dtype=int)
    for y in (10, 70, 130):
        x[y : y + 2, 20:141] = 1
    for c in (20, 80, 139):
        x[10:132, c : c + 2] = 1
    x[40:46, 30:45] = 1  # a word
    px, sizes = pixels(spark, x)
    lines = runs.ruled_lines(px, sizes)
    got = sorted((r.orientation, r.x, r.y, r.w, r.h) for r in lines.where("w > 50 or h > 50").collect())
    assert got == [("h", 20, 10, 121, 2), ("h", 20, 70, 121, 2), ("h", 20, 130, 121, 2), ("v", 20, 10, 2, 122), ("v", 80, 10, 2, 122), ("v", 139, 10, 2, 122)]
    numbered = lines.selectExpr("*", "monotonically_increasing_id() as line_ord")
    points = layout.intersections(numbered)
    assert sorted((r.x, r.y) for r in points.collect()) == [(21, 11), (21, 71), (21, 131), (81, 11), (81, 71), (81, 131), (140, 11), (140, 71), (140, 131)]


@pytest.mark.parametrize("angle", [0, 7, -20, 44])
def test_angle_of_a_page(spark, angle):
    t = math.radians(angle)
    h = w = 220
    r, c = np.mgrid[0:h, 0:w]
    u, v = (c - 110) * math.cos(t) + (r - 110) * math.sin(t), (r - 110) * math.cos(t) - (c - 110) * math.sin(t)
    x = ((abs(u) < 80) & (abs(v) < 45)).astype(int)
    rows = [(7, int(k), int(np.flatnonzero(x[k]).min()), int(np.flatnonzero(x[k]).max())) for k in range(h) if x[k].any()]
    got = runs.page_angles(spark.createDataFrame(rows, "page_id long, row_id int, x0 int, x1 int").repartition(4)).collect()
    assert len(got) == 1 and abs(got[0].angle - angle) < 1.5


def test_hulls_and_rectangles():
    assert runs.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert runs.least_rectangle([(0, 0), (2, 0), (2, 2), (0, 2)]) == (4.0, 0.0)
    area, angle = runs.least_rectangle([(0, 1), (1, 0), (3, 2), (2, 3)])
    assert abs(area - 4) < 1e-9 and abs(angle - 45) < 1e-9
    assert runs.least_rectangle([(5, 5)]) == (0.0, 0.0) and runs.least_rectangle([(0, 0), (1, 1)])[0] == 0.0
