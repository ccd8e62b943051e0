"""Queries over geometries, whole exports and rasters as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orestrata.operators import exports, geometry, linked, terrain
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection
from orestrata.session import read_table, shared_folder
from orestrata.sources import rasters


def _shaped(spark, sf_dir):
    """Locations as points, lines and polygons with a hole, and some without a geometry."""
    i, x, y = F.col("location_id"), F.col("longitude"), F.col("latitude")
    at = lambda dx, dy: F.concat(F.lit("["), (x + dx).cast("string"), F.lit(","), (y + dy).cast("string"), F.lit("]"))
    chain = lambda *ps: F.concat(F.lit("["), F.concat_ws(",", *[at(*p) for p in ps]), F.lit("]"))
    outer, hole = chain((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), chain((1, 1), (2, 1), (2, 2), (1, 1))
    text = (
        F.when(i % 4 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), at(0, 0), F.lit("}")))
        .when(i % 4 == 1, F.concat(F.lit('{"type":"LineString","coordinates":'), chain((0, 0), (1, 2), (3, -1)), F.lit("}")))
        .when(i % 4 == 2, F.concat(F.lit('{"type":"Polygon","coordinates":['), outer, F.lit(","), hole, F.lit("]}")))
    )
    coordinates = F.array(F.struct("latitude", "longitude", F.lit("EPSG:4326").alias("coordinate_system")))
    return projection(spark, sf_dir, "geo_location").withColumns({"coordinates": coordinates, "geometry": geometry.from_geojson(text)})


@register(
    "location_geometries",
    cte("geo_location")
    + """select location_id::varchar as id, location_type, case location_id % 4 when 1 then 'LineString' when 2 then 'Polygon' else 'Point' end as kind,
 case location_id % 4 when 1 then 3 when 2 then 5 else 1 end::int as n_places, case when location_id % 4 = 3 then 0 else longitude end::double as x_min, case location_id % 4 when 1 then latitude - 1 when 3 then 0 else latitude end::double as y_min,
 case location_id % 4 when 1 then longitude + 3 when 2 then longitude + 4 when 3 then 0 else longitude end::double as x_max, case location_id % 4 when 1 then latitude + 2 when 2 then latitude + 4 when 3 then 0 else latitude end::double as y_max,
 case location_id % 4 when 1 then 57 when 2 then 93 else 21 end::int as n_bytes from geo_location""",
)
def location_geometries(spark, sf_dir):
    """The layer's well-known binary, read back."""
    d = linked.location_geometries(_shaped(spark, sf_dir)).withColumn("g", geometry.from_wkb("geom"))
    ends = [F.round(b, 9).alias(n) for b, n in zip(geometry.bounds(F.col("g")), ("x_min", "y_min", "x_max", "y_max"))]
    return d.select("id", "location_type", F.col("g.kind").alias("kind"), F.size(F.flatten("g.rings")).alias("n_places"), *ends, F.octet_length("geom").alias("n_bytes"))


@register(
    "points_in_polygons",
    cte("geo_location")
    + """, p as (select doc_id, (doc_id * 17) % 300 - 170 + 0.037::double as x, (doc_id * 11) % 120 - 75 + 0.013::double as y from (select distinct doc_id from geo_location))
select l.location_id, p.doc_id as polygon_id from geo_location l join p on l.latitude > p.y and l.latitude <= p.y + 20
 and (l.longitude - p.x) * 20 > 15 * (l.latitude - p.y) and (p.x + 30 - l.longitude) * 20 >= 15 * (l.latitude - p.y)
 and not (l.latitude > p.y + 2 and l.latitude <= p.y + 6 and (l.longitude - p.x - 12) * 4 > 3 * (l.latitude - p.y - 2) and (p.x + 18 - l.longitude) * 4 >= 3 * (l.latitude - p.y - 2))""",
)
def points_in_polygons(spark, sf_dir):
    """Locations in triangles with a hole; corners lie off the locations' lattice, so none is on an edge."""
    l = projection(spark, sf_dir, "geo_location")
    p = l.select("doc_id").distinct().select("doc_id", ((F.col("doc_id") * 17) % 300 - 170 + 0.037).alias("px"), ((F.col("doc_id") * 11) % 120 - 75 + 0.013).alias("py"))
    corner = lambda dx, dy: F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y"))
    ring = lambda *c: F.array(*[corner(*k) for k in c])
    shape = F.struct(F.lit("Polygon").alias("kind"), F.array(ring((0, 0), (30, 0), (15, 20), (0, 0)), ring((12, 2), (18, 2), (15, 6), (12, 2))).alias("rings")).cast(geometry.GEOMETRY)
    polygons = p.select(F.col("doc_id").alias("polygon_id"), shape.alias("geometry"))
    return geometry.within(l.select("location_id", "longitude", "latitude"), polygons, 25.0, "longitude", "latitude").select("location_id", "polygon_id")


@register(
    "combined_records",
    cte("geo_location", "doc_sample", "doc_assay", "geo_observation")
    + """, r as (select doc_id, 0 as kind, location_id::varchar as id, row_number() over (partition by doc_id order by location_id) as ord, 0 as within, 'location' as record_type, null as element, location_type as what from geo_location
union all select s.doc_id, 1, s.sample_id, order_key, 0, 'sample', null, sample_type from doc_sample s
union all select s.doc_id, 1, s.sample_id, order_key, row_number() over (partition by s.doc_id, s.sample_id order by a.ord, a.element, a.value, a.unit), 'assay', element, null from doc_sample s join doc_assay a on s.doc_id = a.doc_id and s.sample_id = a.sample_id
union all select l.doc_id, 2, observation_id::varchar, observation_id, 0, 'observation', null, feature_type from geo_observation o join geo_location l on o.location_id = l.location_id)
select doc_id, row_number() over (partition by doc_id order by kind, ord, within)::int as line, record_type, id, element, what from r""",
)
def combined_records(spark, sf_dir):
    """Records of each document in order: each sample comes before its assays."""
    from pyspark.sql import Window

    l = projection(spark, sf_dir, "geo_location")
    placed = l.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("location_id")).cast("long")).withColumn("coordinates", F.array(F.struct("latitude", "longitude")))
    samples = exports.with_assays(projection(spark, sf_dir, "doc_sample"), projection(spark, sf_dir, "doc_assay").select("doc_id", "sample_id", "ord", "element", "value", "unit")).withColumn("ord", F.col("order_key").cast("long"))
    seen = projection(spark, sf_dir, "geo_observation").join(l.select("location_id", "doc_id"), "location_id").withColumn("ord", F.col("observation_id").cast("long"))
    d = exports.combined_table(placed.withColumn("id", F.col("location_id")), samples, seen)
    what = F.coalesce("location_type", "sample_type", "feature_type")
    return d.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).alias("line"), "record_type", "id", "element", what.alias("what"))


@register(
    "location_coordinates",
    cte("geo_location") + "select location_id, 2::int as n_coordinates, latitude, longitude, 'EPSG:4326' as coordinate_system, 2::int as n_fields from geo_location",
)
def location_coordinates(spark, sf_dir):
    """Coordinates in the features of locations, without what they lack."""
    one = F.struct("latitude", "longitude", F.lit("EPSG:4326").alias("coordinate_system"), F.lit(None).cast("string").alias("township"))
    two = F.struct(F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit("EPSG:26910").alias("coordinate_system"), F.lit("T1N").alias("township"))
    d = exports.location_features(projection(spark, sf_dir, "geo_location").withColumn("coordinates", F.array(one, two)))
    read = F.from_json("feature", "properties struct<coordinates:array<map<string,string>>>")["properties"]["coordinates"]
    return d.select("location_id", F.size(read).alias("n_coordinates"), *[read[0][c].cast("double").alias(c) for c in ("latitude", "longitude")], read[0]["coordinate_system"].alias("coordinate_system"), F.size(read[1]).alias("n_fields"))


@register(
    "hotspot_features",
    cte("dem_grid") + "select row_id, col_id, round(z, 6) as score, 500000.0::double + col_id * 30 as x_min, 4200000.0::double - row_id * 30 as y_max, 5::int as n_corners from dem_grid order by z desc, row_id desc, col_id desc limit 10",
)
def hotspot_features(spark, sf_dir):
    """The hotspots' boxes as GeoJSON, read back."""
    top = terrain.hotspots(projection(spark, sf_dir, "dem_grid"), 10, "z")
    d = exports.hotspot_features(terrain.pixel_boxes(top, 500000.0, 4200000.0).join(top, ["row_id", "col_id"]), "z")
    read = F.from_json("feature", "properties struct<row_id:int,col_id:int,score:double>, geometry struct<coordinates:array<array<array<double>>>>")
    ring = F.get(read["geometry"]["coordinates"], 0)
    least, most = (lambda k: F.array_min(F.transform(ring, lambda p: F.get(p, k)))), (lambda k: F.array_max(F.transform(ring, lambda p: F.get(p, k))))
    return d.select(*[read["properties"][c].alias(c) for c in ("row_id", "col_id")], F.round(read["properties"]["score"], 6).alias("score"), least(0).alias("x_min"), most(1).alias("y_max"), F.size(ring).alias("n_corners"))


@register(
    "class_report_rows",
    """with d as (select quality as t, toxic as p from labels where quality is not null and toxic is not null), k as (select distinct t as label from d union select distinct p from d),
r as (select label, (select count(*) from d where t = label and p = label) as hit, (select count(*) from d where p = label) as said, (select count(*) from d where t = label) as support from k),
s as (select label, coalesce(hit / nullif(said, 0)::double, 0) as precision, coalesce(hit / nullif(support, 0)::double, 0) as recall, support from r),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from s)
select label::varchar as label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from f
union all select 'accuracy', null, null, round((select count(*) from d where t = p) / count(*)::double, 9), count(*) from d
union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::bigint from f
union all select 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::bigint from f""",
)
def class_report_rows(spark, sf_dir):
    """The classes, accuracy, and both means."""
    d = terrain.report_rows(read_table(spark, sf_dir, "labels").where("quality is not null and toxic is not null"), "quality", "toxic")
    return d.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("raster_round_trip", cte("dem_grid") + "select row_id, col_id, round((z::float)::double, 3) as z from dem_grid")
def raster_round_trip(spark, sf_dir):
    """The grid written as a raster of files and read back."""
    g = projection(spark, sf_dir, "dem_grid")
    ends = g.agg(F.max("row_id").alias("r"), F.max("col_id").alias("c")).first()
    path = f"{shared_folder(spark)}/raster-{uuid.uuid4().hex}"
    rasters.write_raster(g, path, (30.0, 0.0, 500000.0, 0.0, -30.0, 4200000.0), (ends["r"] or 0) + 1, (ends["c"] or 0) + 1)
    return spark.read.format("raster").load(path).withColumn("z", F.round("z", 3))
