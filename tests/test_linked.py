"""Linked-data nodes as texts worked out by hand, GeoJSON read back, and upload batches."""

import json

from orestrata.operators import linked
from orestrata.sources import reports


def test_nodes_by_hand(spark):
    l = spark.createDataFrame([(1, "7", None, "mine", None, 0.0, None, "", "Nevada", 0.5)], "doc_id long, id string, name string, location_type string, latitude double, easting double, elevation double, township string, state_province string, confidence double")
    got = json.loads(linked.location_nodes(l).first()["node"])
    assert got == {
        "@id": "urn:report/location/7", "@type": "geological:GeologicalLocation", "name": "Location 7", "description": "Geological mine", "geo": {"@type": "GeoCoordinates"},
        "address": {"@type": "PostalAddress", "addressLocality": "", "addressRegion": "Nevada", "addressCountry": ""},
        "additionalProperty": [{"@type": "PropertyValue", "name": "location_type", "value": "mine"}, {"@type": "PropertyValue", "name": "confidence", "value": 0.5}],
    }
    s = spark.createDataFrame(
        [(1, 'S"1', None, "core", 0.0, "", [("Au", 2.5, "ppm", 0.0)])], "doc_id long, sample_id string, location_id long, sample_type string, depth_from double, lithology string, assays array<struct<element:string,value:double,unit:string,detection_limit:double>>"
    )
    got = json.loads(linked.sample_nodes(s).first()["node"])
    assert got["@id"] == 'urn:report/sample/S"1' and "isLocatedAt" not in got and "dateCreated" not in got
    assert [p["name"] for p in got["additionalProperty"]] == ["sample_type", "confidence", "depth_from"] and "value" not in got["additionalProperty"][1]
    assert got["hasPart"] == [{"@type": "geological:AssayResult", "element": {"@type": "geological:ChemicalElement", "name": "Au"}, "value": 2.5, "unit": "ppm"}]


def test_document_without_entities(spark):
    m = spark.createDataFrame([(1, "a/b.c.pdf", 10)], "doc_id long, source_file string, file_size_bytes long")
    none = spark.createDataFrame([], "doc_id long, id string, node string")
    got = json.loads(linked.documents(m, none, none, none).first()["jsonld"])
    assert (got["@id"], got["name"], got["about"], got["mentions"], got["author"]["name"]) == ("urn:report/document/b.c", "Geological Report: b.c.pdf", [], [], "Unknown")
    assert [p.get("value") for p in got["additionalProperty"]] == ["a/b.c.pdf", 10, *[None] * 6]


def test_collections_are_read(spark, tmp_path):
    for name, text in (("a.geojson", '{"type":"FeatureCollection","features":[{"type":"Feature"},{}]}'), ("b.geojson", '{"type":"Feature"}'), ("c.geojson", "no"), ("d.json", "{}"), ("e.geojson", '{"features":[]}')):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/")[-1]: (r["valid"], r["n_features"]) for r in reports.read_collections(spark, str(tmp_path)).collect()}
    assert got == {"a.geojson": (True, 2), "b.geojson": (False, 0), "c.geojson": (False, 0), "e.geojson": (True, 0)}


def test_batch_goes_out_and_uploads_are_refused_whole(spark, tmp_path):
    f = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}')], "doc_id long, feature string")
    linked.write_batch(f, str(tmp_path / "batch"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "batch")).collect()) == ['{"a":1}', '{"a":2}']
    names = lambda *x: reports.upload_error(spark.createDataFrame([(n,) for n in x], "path string")).first()
    assert tuple(names("a.PDF", "b.pdf")) == (True, None)
    assert tuple(names("a.pdf", "z.txt", "b.doc")) == (False, "b.doc")
    assert tuple(names()) == (True, None)


def test_nulls_go_at_any_depth(spark):
    from orestrata.operators import linked

    d = spark.createDataFrame([('{"a":null,"b":{"c":null,"d":[1,null,{"e":null,"f":""}]},"g":[]}',), ("no json",), (None,)], "t string")
    assert [r.v for r in d.select(linked.without_nulls("t").alias("v")).collect()] == ['{"b":{"d":[1,{"f":""}]},"g":[]}', None, None]


def test_assays_go_with_samples(spark, tmp_path):
    from orestrata.operators import exports

    one, none = spark.range(1), spark.range(0)
    assert exports.write_tables(str(tmp_path / "a"), samples=one, assays=none, observations=none) == ["samples", "assays"]
    assert spark.read.csv(str(tmp_path / "a/assays.csv"), header=True).columns == ["id"]
    assert exports.write_tables(str(tmp_path / "b"), samples=none, assays=none) == []
