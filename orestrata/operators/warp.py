"""Rasters on other grids: any orientation, pixel size and projection, by the inverse map of each new pixel.

A raster is a table of pixels with an affine frame. Each pixel of the new grid is
mapped back to a place on the old one, and meets the pixels around that place in
the old grid's tile, so every pixel, old or new, is shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.functions import coords
from orestrata.operators.tiles import SIDE


class Frame(NamedTuple):
    """``x = a * col + b * row + c`` and ``y = d * col + e * row + f`` of the corners of pixels."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def place(self, row, col) -> tuple:
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def pixel(self, x, y) -> tuple:
        """Row and column of a place."""
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the frame has no inverse")
        u, v = x - self.c, y - self.f
        return (self.a * v - self.d * u) / det, (self.e * u - self.b * v) / det


#: Maps a place (columns) on the new grid's map to one on the old grid's.
Map = Callable[[Column, Column], tuple[Column, Column]]


def same(x: Column, y: Column) -> tuple[Column, Column]:
    return x, y


def utm_from_degrees(zone: int) -> Map:
    """Of longitude and latitude, the place in a UTM zone."""
    return lambda x, y: coords.latlon_to_utm(y, x, F.lit(zone))


def degrees_from_utm(zone: int, north: bool = True) -> Map:
    """Of a place in a UTM zone, longitude and latitude."""

    def of(x: Column, y: Column) -> tuple[Column, Column]:
        lat, lon = coords.utm_to_latlon(x, y, F.lit(zone), F.lit(north))
        return lon, lat

    return of


def chained(*maps: Map) -> Map:
    """One map after the other. Each takes the place that the one before has made, so the expression grows with their sum and not their product."""

    def by(m: Map) -> Callable[[Column], Column]:
        return lambda p: F.struct(*[v.alias(n) for v, n in zip(m(p["x"], p["y"]), "xy")])

    def of(x: Column, y: Column) -> tuple[Column, Column]:
        place = F.array(F.struct(x.alias("x"), y.alias("y")))
        for m in maps:
            place = F.transform(place, by(m))
        return F.get(place, 0)["x"], F.get(place, 0)["y"]

    return of


def zone_to_zone(zone: int, to: int, north: bool = True) -> Map:
    """Of a place in a UTM zone, that in another zone."""
    return chained(degrees_from_utm(zone, north), utm_from_degrees(to))


def suggested(spark: SparkSession, height: int, width: int, frame: Frame, forward: Map, pixel: float, steps: int = 21) -> tuple[Frame, int, int]:
    """A north-up frame of ``pixel`` for the box of a raster under ``forward``, and its height and width. The box is that of ``steps`` places along each edge and of the corners."""
    ends = np.linspace(0.0, 1.0, steps)
    edge = [(r * height, c * width) for t in ends for r, c in ((0, t), (1, t), (t, 0), (t, 1))]
    places = spark.createDataFrame([tuple(map(float, frame.place(r, c))) for r, c in edge], "x double, y double")
    x, y = forward(F.col("x"), F.col("y"))
    box = places.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    return Frame(pixel, 0.0, box["x0"], 0.0, -pixel, box["y1"]), math.ceil((box["y1"] - box["y0"]) / pixel), math.ceil((box["x1"] - box["x0"]) / pixel)


def warped(grid: DataFrame, frame: Frame, to: Frame, height: int, width: int, back: Map = same, column: str = "z", side: int = SIDE) -> DataFrame:
    """``row_id, col_id`` and the value of each of ``height * width`` pixels of the frame ``to``: that of its middle on ``grid``, between the middles of
    the four pixels around. Those that ``grid`` lacks have no weight; a pixel with none of the four has no row.
    """
    spark = grid.sparkSession
    lines = spark.range(height).select(F.col("id").cast("int").alias("row_id"))
    new = lines.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col_id")) if width > 0 else lines.select("row_id", F.lit(0).alias("col_id")).limit(0)
    x, y = back(*to.place(F.col("row_id") + 0.5, F.col("col_id") + 0.5))
    r, c = frame.pixel(x, y)
    new = new.select("row_id", "col_id", (r - 0.5).alias("r"), (c - 0.5).alias("c"))
    tile = lambda v: F.floor(F.floor(v) / side)
    new = new.withColumns({"_tr": tile(F.col("r")), "_tc": tile(F.col("c"))})
    # A pixel is needed in its own tile and, if it is a tile's first, in the one before.
    seen = lambda v: F.sequence(F.floor((F.col(v) - 1) / side), F.floor(F.col(v) / side))
    old = grid.select("row_id", "col_id", F.col(column).cast("double").alias("v")).withColumn("_tr", F.explode(seen("row_id"))).withColumn("_tc", F.explode(seen("col_id")))
    schema = T.StructType([*new.select("row_id", "col_id").schema.fields, T.StructField(column, T.DoubleType())])

    def gather(key: tuple, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if want.empty or have.empty:
            return pd.DataFrame({n: [] for n in schema.names})
        r0, c0 = int(key[0]) * side, int(key[1]) * side
        values = np.full((side + 1, side + 1), np.nan)
        values[have["row_id"].to_numpy() - r0, have["col_id"].to_numpy() - c0] = have["v"].to_numpy(dtype=float)
        r, c = want["r"].to_numpy() - r0, want["c"].to_numpy() - c0
        i, j = np.floor(r).astype(int), np.floor(c).astype(int)
        fr, fc = r - i, c - j
        total, weight = np.zeros(len(want)), np.zeros(len(want))
        near = np.zeros(len(want), dtype=bool)
        for di, wi in ((0, 1 - fr), (1, fr)):
            for dj, wj in ((0, 1 - fc), (1, fc)):
                v = values[i + di, j + dj]
                known = ~np.isnan(v)
                w = np.where(known, wi * wj, 0.0)
                total += w * np.where(known, v, 0.0)
                weight += w
                near |= known
        with np.errstate(invalid="ignore"):
            z = np.where(weight > 0, total / weight, np.nan)
        out = pd.DataFrame({"row_id": want["row_id"], "col_id": want["col_id"], column: z})
        return out[near & (weight > 0)]

    return new.groupBy("_tr", "_tc").cogroup(old.groupBy("_tr", "_tc")).applyInPandas(gather, schema)
