"""Geometries by hand: well-known binary as its definition has it, holes, edges and closed exports."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from orestrata.operators import exports, geometry


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_well_known_binary(spark):
    g = lambda text: geometry.from_geojson(F.lit(text))
    assert bytes(one(spark, geometry.wkb(g('{"type":"Point","coordinates":[1.5,-2]}')))) == struct.pack("<BIdd", 1, 1, 1.5, -2.0)
    assert bytes(one(spark, geometry.wkb(g('{"type":"LineString","coordinates":[[0,1],[2,3]]}')))) == struct.pack("<BII4d", 1, 2, 2, 0, 1, 2, 3)
    ring = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]],[[0.1,0.1],[0.2,0.1],[0.1,0.2],[0.1,0.1]]]}'
    raw = bytes(one(spark, geometry.wkb(g(ring))))
    assert raw[:13] == struct.pack("<BIII", 1, 3, 2, 4) and len(raw) == 9 + 2 * (4 + 64)
    assert len(bytes(one(spark, geometry.wkb(geometry.layer_geometry(g(ring)))))) == 9 + 4 + 64
    for bad in ('{"type":"Circle","coordinates":[1,2]}', "no json", None):
        assert one(spark, g(bad)) is None
        assert bytes(one(spark, geometry.wkb(geometry.layer_geometry(g(bad))))) == struct.pack("<BIdd", 1, 1, 0, 0)


def test_most_significant_byte_first(spark):
    d = spark.createDataFrame([(bytearray(struct.pack(">BIII4d", 0, 3, 1, 2, 1, 2, 3, 4)),), (None,)], "raw binary").select(geometry.from_wkb("raw").alias("g")).collect()
    assert [d[0].g.kind, [(p.x, p.y) for p in d[0].g.rings[0]]] == ["Polygon", [(1.0, 2.0), (3.0, 4.0)]]


def test_points_in_polygons(spark):
    shape = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}'
    polygons = spark.createDataFrame([(1, shape), (2, shape.replace("10", "3")), (3, '{"type":"Point","coordinates":[1,1]}'), (4, None)], "k int, t string").select("k", geometry.from_geojson(F.col("t")).alias("geometry"))
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (-1.0, 5.0), (9.99, 9.99), (4.0, 3.9), (11.0, 1.0)], "x double, y double")
    for cell in (0.7, 4.0, 1000.0):
        got = sorted((r.x, r.y, r.k) for r in geometry.within(points, polygons, cell).collect())
        assert got == [(1.0, 1.0, 1), (1.0, 1.0, 2), (4.0, 3.9, 1), (5.0, 5.0, 2), (9.99, 9.99, 1)]  # ring 2's hole lies outside it


def test_copies_of_places_and_polygons_are_compared_once(spark, monkeypatch):
    """What is compared is distinct; every copy is told, and a crowded cell's places are dealt into parts."""
    rings = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]
    polygons = spark.createDataFrame([(k, ("Polygon", rings)) for k in range(30)], f"k int, geometry {geometry.GEOMETRY}")
    points = spark.createDataFrame([(i, float(i % 5 + 8), 5.0) for i in range(100)], "i int, x double, y double")
    seen = spark.sparkContext.accumulator(0)

    def encloses(g, x, y):
        count = F.udf(lambda v: seen.add(1) or v, "double").asNondeterministic()
        return plain(g, x, y) & (count(x) == x)

    plain = geometry.encloses
    monkeypatch.setattr(geometry, "encloses", encloses)
    got = geometry.within(points, polygons, 25.0, part=2)
    assert got.columns == ["i", "x", "y", "k", "geometry"]
    assert sorted((r.i, r.k) for r in got.collect()) == [(i, k) for i in range(100) if i % 5 < 2 for k in range(30)]
    assert 0 < seen.value <= 50


def test_boxes(spark):
    b = one(spark, geometry.box(*[F.lit(v) for v in (-1, -2, 3, 4)]))
    assert [(p.x, p.y) for p in b.rings[0]] == [(3, -2), (3, 4), (-1, 4), (-1, -2), (3, -2)]


def test_only_locations_or_samples(spark):
    l = spark.createDataFrame([(1, 7, "A", 1.0, 2.0)], "doc_id long, location_id long, name string, longitude double, latitude double")
    s = spark.createDataFrame([("S1", 7), ("S2", 9)], "sample_id string, location_id long")
    a, b = json.loads(exports.only(locations=l).first().geojson), json.loads(exports.only(samples=s, at=l).first().geojson)
    assert [f["properties"]["id"] for f in a["features"]] == ["7"] and "metadata" not in a
    assert [f["properties"]["id"] for f in b["features"]] == ["S1"] and b["features"][0]["geometry"]["coordinates"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        exports.only()
