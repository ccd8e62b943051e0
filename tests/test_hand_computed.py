"""Operators against pages and tables that were worked out by hand."""

import math

from orestrata.operators import exports, extraction, forest, layout
from pyspark.sql import functions as F


def test_intersections_lie_at_the_middle_of_both_lines(spark):
    rows = [
        (1, 1, "h", 0, 100, 200, 6),  # its middle is at y = 103
        (1, 2, "v", 50, 103, 4, 80),  # begins at that middle, x = 52
        (1, 3, "v", 100, 0, 5, 102),  # ends at 102, above the middle but below the top edge
        (1, 4, "v", 200, 20, 3, 100),  # x = 201, just beyond the end
        (1, 5, "v", 197, 20, 6, 100),  # x = 200, at the end
        (1, 6, "h", 0, 100, 40, 3),  # too short
        (2, 7, "v", 50, 20, 4, 200),  # another page
        (1, 8, "h", 60, 150, 900, 3),  # in many stripes
    ]
    d = spark.createDataFrame(rows, "page_id long, line_ord long, orientation string, x long, y long, w long, h long")
    for stripe in (64, 7, 5000):
        got = {(r.page_id, r.h_ord, r.v_ord, r.x, r.y) for r in layout.intersections(d, stripe).collect()}
        assert got == {(1, 1, 2, 52, 103), (1, 1, 5, 200, 103)}


def test_blocks_are_classed_by_the_boxes_of_clusters(spark):
    """Two tables far apart on a page: a block between them lies in neither."""
    points = [(1, x, y, i, 0) for i, (x, y) in enumerate([(200, 200), (250, 200), (200, 250), (250, 250), (700, 800), (760, 800), (700, 860), (760, 860), (400, 600)])]
    tables = layout.table_clusters(spark.createDataFrame(points, "page_id long, x long, y long, h_ord long, v_ord long"))
    assert sorted((r.x_min, r.x_max, r.y_min, r.y_max, r.n_points) for r in tables.collect()) == [(200, 250, 200, 250, 4), (700, 760, 800, 860, 4)]
    blocks = [(1, 1, 200, 200, 50, 50), (1, 2, 400, 500, 50, 50), (1, 3, 750, 850, 20, 20), (1, 4, 220, 50, 10, 10), (1, 5, 710, 1001, 10, 10), (2, 6, 210, 210, 10, 10)]
    got = layout.classes(spark.createDataFrame(blocks, "page_id long, block_ord long, x long, y long, w long, h long"), tables)
    assert {r.block_ord: r.text_type for r in got.collect()} == {1: "table", 2: "paragraph", 3: "table", 4: "header", 5: "footer", 6: "paragraph"}


def test_scores_take_the_median_for_what_is_not_finite(spark):
    rows = [(0, i, float(i), 1.0 if i % 2 else float("nan")) for i in range(5)] + [(1, 0, float("inf"), 3.0), (1, 1, None, 5.0)]
    d = spark.createDataFrame(rows, "row_id int, col_id int, a double, b double")
    assert forest.medians(d, ("a", "b")) == {"a": 2.5, "b": 2.0}
    known = spark.createDataFrame([(0, i, float(i), float(i % 3), int(i > 30)) for i in range(60)], "row_id int, col_id int, a double, b double, label int")
    model = forest.train(known, ("a", "b"), trees=5, depth=4)
    got = {(r.row_id, r.col_id): r.proba for r in forest.score(model, d, ("a", "b")).collect()}
    want = {(r.row_id, r.col_id): r.proba for r in forest.score(model, spark.createDataFrame([(1, 0, 2.5, 3.0), (1, 1, 2.5, 5.0)], d.schema), ("a", "b")).collect()}
    assert len(got) == 7 and all(math.isclose(got[k], want[k]) for k in want)


def test_spatial_cross_validation(spark):
    rows = [(i // 20, i % 20, float(i % 20), float(i % 7), int(i % 20 > 9), i // 80) for i in range(400)]
    d = spark.createDataFrame(rows, "row_id int, col_id int, a double, b double, label int, block_id int")
    folds = spark.createDataFrame([(b, b % 5 + 1) for b in range(6)], "block_id int, fold int")
    got = forest.spatial_cv(d, folds, 7, ("a", "b"), trees=8, depth=5).collect()
    assert sorted((r.fold, r.label, r.support) for r in got) == [(f, lab, 40) for f in range(1, 6) for lab in (0, 1)]
    assert all(r.f1 == 1.0 for r in got)
    one_class = d.where("label = 1")
    assert forest.spatial_cv(one_class, folds, 5, ("a", "b"), trees=3, depth=3).count() == 0


def test_files_are_written_for_tables_with_rows(spark, tmp_path):
    s = spark.createDataFrame([("S1", 7, "core"), ("S2", None, "chip")], "sample_id string, location_id long, sample_type string")
    names = exports.write_tables(str(tmp_path), samples=exports.samples_table(s), observations=exports.observations_table(spark.createDataFrame([], "observation_id long, feature_type string")))
    assert names == ["samples"]
    back = spark.read.csv(f"{tmp_path}/samples.csv", header=True).orderBy("id").collect()
    assert back[0].asDict() == {**dict.fromkeys(exports.SAMPLES), "id": "S1", "location_id": "7", "sample_type": "core"} and len(back) == 2


def test_geojson_text(spark):
    l = spark.createDataFrame([(1, 5, "A", "mine", 1.5, 2.5, None)], "doc_id long, location_id long, name string, location_type string, latitude double, longitude double, elevation double")
    a = spark.createDataFrame([("S1", 2, "Au", 1.0, None), ("S1", 1, "Ag", 2.0, None)], "sample_id string, ord int, element string, value double, unit string")
    s = exports.with_assays(spark.createDataFrame([("S1", 5, "core"), ("S2", None, "core")], "sample_id string, location_id long, sample_type string"), a)
    assert exports.sample_features(s, l).first()["feature"] == (
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[2.5,1.5]},"properties":{"id":"S1","sample_type":"core","location_id":"5","location_name":"A","depth_from":null,"depth_to":null,"depth_unit":null,'
        '"lithology":null,"alteration":null,"mineralization":null,"collection_date":null,"confidence":null,"assays":[{"element":"Ag","value":2.0},{"element":"Au","value":1.0}]}}'
    )
    f = exports.location_features(l, s).select("doc_id", F.col("location_id").alias("place"), "feature")
    text = exports.collections(f, spark.createDataFrame([(1, 1, None)], "doc_id long, total_locations long, title string")).first()["geojson"]
    assert text.startswith('{"type":"FeatureCollection","crs":') and text.endswith('"samples":[{"sample_id":"S1","sample_type":"core"}]}}],"metadata":{"total_locations":1}}')


def test_entities_at_their_bounds(spark):
    item = "location_type string, confidence double, coordinates array<struct<latitude:double,longitude:double,easting:double,northing:double,utm_zone:string,confidence:double,source_text:string>>"
    at = lambda lat, lon: [(lat, lon, None, None, None, None, None)]
    rows = [(None, None, None), ("mine", 1.0, at(90.0, 180.0)), ("mine", 0.0, at(91.0, 120.0)), ("mine", 1.1, None), ("MINE", 0.5, None)]
    got = extraction.locations(spark.createDataFrame(rows, item)).collect()
    assert [(r.location_type, r.confidence, r.longitude, r.latitude) for r in got] == [("sample_site", 0.5, 0.0, 0.0), ("mine", 1.0, 180.0, 90.0), ("mine", 0.0, 0.0, 0.0)]
    item = "sample_id string, sample_type string, depth_from double, depth_to double, depth_unit string, confidence double, assays array<struct<element:string,value:double,unit:string,detection_limit:double,confidence:double>>"
    rows = [(None, None, 0.0, 1.0, None, None, None), ("a", "core", 1.0, 0.0, "m", 0.9, None), ("b", "core", None, 1.0, "m", 0.9, [("Au", -1.0, "ppm", None, None)]), ("c", "core", None, None, "ft", 0.9, [("Au", None, None, None, None)])]
    got = extraction.samples(spark.createDataFrame(rows, item)).collect()
    assert [(r.sample_id, r.sample_type, r.depth_unit, [tuple(a) for a in r.assays]) for r in got] == [("", "rock", "m", []), ("c", "core", "ft", [("Au", 0.0, "ppm", None, 0.5)])]
