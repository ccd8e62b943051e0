"""Rotated and reprojected grids against brute force."""

import math

import numpy as np
import pytest

from orestrata.operators import warp


def plain(z, frame, to, height, width, back):
    out = {}
    for r in range(height):
        for c in range(width):
            x, y = to.place(r + 0.5, c + 0.5)
            a, b = frame.pixel(*back(x, y))
            a, b = a - 0.5, b - 0.5
            i, j = math.floor(a), math.floor(b)
            total = weight = 0.0
            for k, l, w in ((i, j, (1 - a + i) * (1 - b + j)), (i + 1, j, (a - i) * (1 - b + j)), (i, j + 1, (1 - a + i) * (b - j)), (i + 1, j + 1, (a - i) * (b - j))):
                if 0 <= k < z.shape[0] and 0 <= l < z.shape[1]:
                    total, weight = total + w * z[k, l], weight + w
            if weight > 0:
                out[r, c] = total / weight
    return out


def table(spark, z):
    return spark.createDataFrame([(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "row_id int, col_id int, z double")


@pytest.mark.parametrize("turn", [0, 30, 90, -137])
def test_turned_grids(spark, turn):
    z = np.random.default_rng(0).normal(size=(19, 27))
    t = math.radians(turn)
    frame = warp.Frame(30.0, 0.0, 1000.0, 0.0, -30.0, 5000.0)
    to = warp.Frame(25 * math.cos(t), -25 * math.sin(t), 1200.0, -25 * math.sin(t), -25 * math.cos(t), 4900.0)
    got = {(r.row_id, r.col_id): r.z for r in warp.warped(table(spark, z), frame, to, 21, 24, side=8).collect()}
    want = plain(z, frame, to, 21, 24, lambda x, y: (x, y))
    assert got.keys() == want.keys() and len(want) > 20
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_same_grid_is_itself(spark):
    z = np.arange(12.0).reshape(3, 4)
    frame = warp.Frame(2.0, 0.0, -5.0, 0.0, -2.0, 7.0)
    assert {(r.row_id, r.col_id): r.z for r in warp.warped(table(spark, z), frame, frame, 3, 4, side=2).collect()} == {(r, c): z[r, c] for r in range(3) for c in range(4)}


def test_from_degrees_to_a_zone(spark):
    """A grid in degrees comes to UTM metres. Heights that are linear in longitude and latitude stay so."""
    h, w, step = 40, 50, 0.001
    frame = warp.Frame(step, 0.0, -122.5, 0.0, -step, 38.2)
    r, c = np.mgrid[0:h, 0:w]
    lon, lat = frame.place(r + 0.5, c + 0.5)
    z = 1000 * (lon + 122.5) + 500 * (lat - 38.2)
    to, height, width = warp.suggested(spark, h, w, frame, warp.utm_from_degrees(10), 100.0)
    assert 42 <= height <= 48 and 42 <= width <= 48
    back = warp.degrees_from_utm(10)
    got = warp.warped(table(spark, z), frame, to, height, width, back, side=16)
    from pyspark.sql import functions as F

    x, y = to.place(F.col("row_id") + 0.5, F.col("col_id") + 0.5)
    x, y = back(x, y)
    rows = got.select("z", x.alias("lon"), y.alias("lat")).collect()
    inner = [k for k in rows if -122.5 + step < k.lon < -122.5 + (w - 1) * step and 38.2 - (h - 1) * step < k.lat < 38.2 - step]
    assert len(inner) > 1200
    assert all(abs(k.z - (1000 * (k.lon + 122.5) + 500 * (k.lat - 38.2))) < 1e-6 for k in inner)


def test_zone_to_zone_and_back(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(700000.0, 4100000.0)], "x double, y double")
    x, y = warp.chained(warp.zone_to_zone(10, 11), warp.zone_to_zone(11, 10))(F.col("x"), F.col("y"))
    r = d.select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 700000) < 1e-3 and abs(r.y - 4100000) < 1e-3
    with pytest.raises(ValueError):
        warp.Frame(1, 1, 0, 1, 1, 0).pixel(0, 0)
