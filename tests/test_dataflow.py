"""Extraction over blocks with engines that are slow, fail at first, or fail for good; nested checks worked out by hand."""

import asyncio
import time

from pyspark.sql import functions as F

from orestrata.functions import checks
from orestrata.operators import dataflow, extraction


def test_rows_keep_their_order_and_failures_are_rows(spark):
    async def engine(text):
        await asyncio.sleep(0.02 if text.startswith("slow") else 0)
        if text == "slow 3":
            raise RuntimeError("down")
        return text.upper()

    rows = spark.createDataFrame([(k, None if k == 5 else f"slow {k}" if k % 2 else f"fast {k}") for k in range(40)], "k int, text string").coalesce(1)
    got = dataflow.asked(rows, engine, tries=2, wait=0.0).collect()
    assert [r.k for r in got] == list(range(40))
    assert (got[3].answer, got[3].asked, got[3].error) == (None, 2, "down")
    assert (got[5].answer, got[5].asked, got[5].error) == (None, 0, None)
    assert all((r.answer, r.asked, r.error) == (r.text.upper(), 1, None) for r in got if r.k not in (3, 5))


def test_questions_are_open_together_up_to_a_bound(spark, tmp_path):
    path = str(tmp_path / "log")

    async def engine(text):
        with open(path, "a") as f:
            f.write("+")
        await asyncio.sleep(0.05)
        with open(path, "a") as f:
            f.write("-")
        return text

    rows = spark.createDataFrame([(str(k),) for k in range(24)], "text string").coalesce(1)
    assert dataflow.asked(rows, engine, at_once=4).count() == 24 and dataflow.asked(rows, engine, at_once=4).where("answer = text").count() == 24
    now = most = 0
    for c in open(path).read():
        now += 1 if c == "+" else -1
        most = max(most, now)
    assert most == 4


def test_second_tries_and_limits(spark, tmp_path):
    path = str(tmp_path / "seen")

    def engine(text):
        with open(path, "a") as f:
            f.write("x")
        n = len(open(path).read())
        if text == "late":
            time.sleep(0.3)
        elif n < 3:
            raise ValueError("not yet")
        return "yes"

    one = spark.createDataFrame([("first",)], "text string")
    r = dataflow.asked(one, engine, tries=3, wait=0.0).first()
    assert (r.answer, r.asked, r.error) == ("yes", 3, None)
    r = dataflow.asked(spark.createDataFrame([("late",)], "text string"), engine, tries=1, limit=0.05).first()
    assert (r.answer, r.asked, r.error) == (None, 1, "TimeoutError")


def test_entities_of_answers(spark):
    good = '{"locations":[{"name":"A","location_type":"mine","coordinates":[{"latitude":10.5,"longitude":20.0}],"confidence":0.9},{"location_type":"hill"}],"samples":[{"id":"S1","assays":[{"value":2.0}]},{"id":"S2","depth_unit":"km"}],"geological_observations":[{"measurements":{"plunge":91}},{"measurements":{"plunge":90}}],"document_metadata":{"title":"T"}}'
    rows = [(1, 1, 0, "A S1", good, None), (1, 1, 1, "x", 'words {"document_metadata":{"title":"U"}} words', None), (1, 2, 0, "y", "no json", None), (1, 2, 1, "z", None, "down")]
    e = dataflow.extracted(spark.createDataFrame(rows, "doc_id long, page_id long, block_ord long, text string, answer string, error string").withColumn("asked", F.lit(1)))
    assert [(r.name, r.latitude, r.longitude, r.confidence) for r in e.locations.collect()] == [("A", 10.5, 20.0, 0.9)]
    assert [(r.sample_id, r.assays[0].element, r.assays[0].unit, r.depth_unit) for r in e.samples.collect()] == [("S1", "", "ppm", "m")]
    assert [(r.item, r.feature_type, r.plunge) for r in e.observations.collect()] == [(1, "contact", 90.0)]
    assert [r.metadata["title"] for r in e.metadata.collect()] == ["T"]
    assert sorted((r.page_id, r.block_ord, r.error) for r in e.failed.collect()) == [(2, 0, "the answer isn't JSON"), (2, 1, "down")]
    assert [(r.sample_id, r.linked_id.block_ord) for r in dataflow.linked(e).collect()] == [("S1", 0)]


def test_nested_messages(spark):
    a = "array<struct<element:string,value:double,unit:string,detection_limit:double,confidence:double>>"
    rows = [("", 5.0, 5.0, 2.0, [("", -1.0, "ppm", None, 1.0), ("Au", 1.0, "x", 2.0, 1.5)]), ("S", None, None, 0.5, [])]
    d = spark.createDataFrame(rows, f"sample_id string, depth_from double, depth_to double, confidence double, assays {a}")
    got = [list(r.e) for r in d.select(checks.sample_errors(F.col("assays")).alias("e")).collect()]
    assert got == [["no id", "from not above to", "Assay 0: no element", "Assay 0: negative value", "Assay 1: unknown unit", "Assay 1: detection limit above value", "Assay 1: confidence out of range", "confidence out of range"], []]


def test_bounds_of_observations(spark):
    rows = [(0, 360.0, 90.0, 1.0), (1, 360.5, 90.0, 1.0), (2, 0.0, 90.5, 1.0), (3, 0.0, 0.0, 1.5), (4, None, None, None)]
    d = spark.createDataFrame(rows, "k int, trend double, plunge double, measurement_confidence double").selectExpr("*", "cast(null as string) feature_type", "cast(null as string) description", "cast(null as double) confidence", "cast(null as double) strike", "cast(null as double) dip")
    assert [r.k for r in extraction.observations(d).orderBy("k").collect()] == [0, 4]
