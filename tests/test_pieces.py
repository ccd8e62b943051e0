"""Documents in pieces: their texts are those of whole documents, and no group holds more than ids."""

import json

from pyspark.sql import functions as F

from orestrata.operators import exports, linked
from orestrata.plans import export_queries as q


def texts(d):
    rows = sorted(d.collect(), key=lambda r: (r.doc_id, *map(str, r.place[:1]), *r.place[1:]))
    out = {}
    for r in rows:
        out[r.doc_id] = out.get(r.doc_id, "") + r.text
    return out


def frames(spark):
    l = spark.createDataFrame([(1, 7, "A", 1.0, 2.0), (1, 8, "B", 3.0, 4.0), (2, 9, "C", 5.0, 6.0)], "doc_id long, location_id long, name string, longitude double, latitude double")
    s = spark.createDataFrame([("S1", 8, 0.5, [("Au", 1.0, "ppm")]), ("S2", 8, None, []), ("S3", 7, 1.0, [("Ag", 2.0, "%"), ("Cu", 3.0, "g/t")]), ("S4", 99, 1.0, [])], "sample_id string, location_id long, depth_to double, assays array<struct<element:string,value:double,unit:string>>")
    return l, s


def test_geojson_pieces(spark):
    l, s = frames(spark)
    m = spark.createDataFrame([(1, 2)], "doc_id long, total_locations long")
    a = exports.location_features(l, s).select("doc_id", F.struct(F.lit(0).alias("kind"), F.format_string("%020d", "location_id").alias("id")).alias("place"), "feature")
    b = exports.sample_features(s, l).select("doc_id", F.struct(F.lit(1).alias("kind"), F.col("sample_id").alias("id")).alias("place"), "feature")
    want = {r.doc_id: r.geojson for r in exports.collections(a.unionByName(b), m).collect()}
    got = texts(exports.pieces(l, s, m))
    assert got == want and json.loads(got[1])["features"][1]["properties"]["samples"][1]["sample_id"] == "S2"


def test_jsonld_pieces(spark):
    l, s = frames(spark)
    m = spark.createDataFrame([(1, "in/a.pdf"), (2, "b.pdf"), (3, "c.pdf")], "doc_id long, source_file string")
    nodes = linked.location_nodes(l.withColumn("id", F.col("location_id"))), linked.sample_nodes(s.join(l.select("location_id", "doc_id"), "location_id")), linked.location_nodes(l.withColumn("id", F.col("location_id"))).limit(0)
    want = {r.doc_id: r.jsonld for r in linked.documents(m, *nodes).collect()}
    got = texts(linked.pieces(m, *nodes))
    assert got == want and len(json.loads(got[1])["hasPart"]) == 3 and json.loads(got[3])["about"] == []


def test_queries_gather_no_document(spark, sf_dir):
    for query in (q.geojson_documents, q.jsonld_documents):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        gathered = [line for line in plan.splitlines() if "collect_list" in line]
        assert gathered and all("sample_id" in line and "ord" in line for line in gathered)  # a sample's assays alone
