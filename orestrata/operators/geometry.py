"""Points, lines and polygons as a column: from GeoJSON, as well-known binary, and which polygon a point lies in."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``kind`` is Point, LineString or Polygon; a point and a line have one list of places, a polygon one a ring, the outer first.
GEOMETRY = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"
#: Codes of well-known binary.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3}


def from_geojson(text: Column) -> Column:
    """A GeoJSON geometry; null if it is of another kind or isn't one."""
    kind = F.get_json_object(text, "$.type")
    read = lambda shape: F.from_json(text, f"coordinates {shape}")["coordinates"]
    place = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    line = lambda ps: F.transform(ps, place)
    rings = (
        F.when(kind == "Point", F.array(F.array(place(read("array<double>")))))
        .when(kind == "LineString", F.array(line(read("array<array<double>>"))))
        .when(kind == "Polygon", F.transform(read("array<array<array<double>>>"), line))
    )
    return F.when(rings.isNotNull(), F.struct(kind.alias("kind"), rings.alias("rings"))).cast(GEOMETRY)


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))).alias("rings")).cast(GEOMETRY)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box of two corners, from its lower right corner counter-clockwise and closed."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0), corner(x1, y0))
    return F.struct(F.lit("Polygon").alias("kind"), F.array(ring).alias("rings")).cast(GEOMETRY)


def layer_geometry(geometry: Column) -> Column:
    """What a layer of locations holds: a polygon's outer ring alone, and the point (0, 0) where there is no geometry or an empty one."""
    some = geometry.isNotNull() & (F.size(F.get(geometry["rings"], 0)) > 0)
    outer = F.struct(geometry["kind"].alias("kind"), F.slice(geometry["rings"], 1, 1).alias("rings")).cast(GEOMETRY)
    return F.when(some, outer).otherwise(point(F.lit(0.0), F.lit(0.0)))


def _wkb(g) -> bytes | None:
    if g is None:
        return None
    rings = [[(p["x"], p["y"]) for p in ring] for ring in g["rings"]]
    flat = lambda ring: struct.pack(f"<{2 * len(ring)}d", *[v for p in ring for v in p])
    head = struct.pack("<BI", 1, CODES[g["kind"]])
    if g["kind"] == "Point":
        return head + flat(rings[0][:1])
    if g["kind"] == "LineString":
        return head + struct.pack("<I", len(rings[0])) + flat(rings[0])
    return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in rings)


def _from_wkb(raw) -> dict | None:
    if raw is None:
        return None
    order = "<" if raw[0] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", raw, 1)
    kind, at = {v: k for k, v in CODES.items()}[code], 5

    def places(n: int) -> list[dict]:
        nonlocal at
        v = struct.unpack_from(f"{order}{2 * n}d", raw, at)
        at += 16 * n
        return [{"x": x, "y": y} for x, y in zip(v[::2], v[1::2])]

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    rings = [places(1)] if kind == "Point" else [places(count())] if kind == "LineString" else [places(count()) for _ in range(count())]
    return {"kind": kind, "rings": rings}


def wkb(column: Column | str) -> Column:
    """Well-known binary, least byte first."""

    def of(g: pd.DataFrame) -> pd.Series:
        return pd.Series([None if k is None else _wkb({"kind": k, "rings": r}) for k, r in zip(g["kind"], g["rings"])], dtype=object)

    return F.pandas_udf(of, T.BinaryType())(column)


def from_wkb(column: Column | str) -> Column:
    """Geometries of well-known binary in either byte order."""

    def of(raw: pd.Series) -> pd.DataFrame:
        read = [_from_wkb(None if x is None else bytes(x)) or {"kind": None, "rings": None} for x in raw]
        return pd.DataFrame({"kind": [r["kind"] for r in read], "rings": [r["rings"] for r in read]})

    place = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    shape = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(place)))])
    d = F.pandas_udf(of, shape)(column)
    return F.when(d["kind"].isNotNull(), d)


def bounds(geometry: Column) -> list[Column]:
    """``x_min, y_min, x_max, y_max`` of all places."""
    places = F.flatten(geometry["rings"])
    return [f(places.getField(c)).alias(f"{c}_{n}") for f, n in ((F.array_min, "min"), (F.array_max, "max")) for c in ("x", "y")]


def encloses(geometry: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds a place: a ray to the right crosses its rings an odd number of times. A place on an edge belongs to one side of it."""

    def crossings(ring: Column) -> Column:
        ends = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        crosses = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
        return F.size(F.filter(ends, lambda e: (e["p"]["y"] != e["q"]["y"]) & crosses(e)))

    return F.aggregate(F.transform(geometry["rings"], crossings), F.lit(0), lambda a, n: a + n) % 2 == 1


def within(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y", geometry: str = "geometry", part: int = 2000) -> DataFrame:
    """``points`` with the columns of each polygon that holds them.

    Places meet shapes by square cells of ``cell`` width: a place lies in one, a polygon in those of its box. A cell of about a polygon's size keeps both the copies of
    polygons and the places they are compared with few. Equal places and equal shapes are compared once, and a crowded cell's places are dealt into parts of ``part`` at most or so.
    """
    of = lambda c: F.floor(c / cell)
    shapes = polygons.where(F.col(f"{geometry}.kind") == "Polygon").select(F.col(geometry).alias("_g")).distinct()
    spread = shapes.select("*", *[b.alias(f"_{n}") for b, n in zip(bounds(F.col("_g")), ("x0", "y0", "x1", "y1"))])
    spread = spread.withColumn("_cx", F.explode(F.sequence(of(F.col("_x0")), of(F.col("_x1"))))).withColumn("_cy", F.explode(F.sequence(of(F.col("_y0")), of(F.col("_y1")))))
    px, py = F.col("_px"), F.col("_py")
    places = points.select(F.col(x).alias("_px"), F.col(y).alias("_py")).distinct().withColumns({"_cx": of(px), "_cy": of(py)})
    crowds = places.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / part).alias("_parts"))
    places = places.join(crowds, ["_cx", "_cy"]).withColumn("_part", F.pmod(F.xxhash64("_px", "_py"), F.col("_parts"))).drop("_parts")
    spread = spread.join(crowds, ["_cx", "_cy"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    in_box = px.between(F.col("_x0"), F.col("_x1")) & py.between(F.col("_y0"), F.col("_y1"))
    held = places.join(spread, ["_cx", "_cy", "_part"]).where(in_box & encloses(F.col("_g"), px, py)).select("_px", "_py", "_g")
    near = points.join(held, (F.col(x) == px) & (F.col(y) == py)).drop("_px", "_py")
    return near.join(polygons, F.col("_g") == F.col(geometry)).drop("_g")
