from orestrata.functions import coords
from orestrata.sources import reports
from orestrata.streaming import ingest
from pyspark.sql import functions as F


def test_scan_and_rules(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"x")
    d = reports.scan(spark, str(tmp_path))
    assert d.select(reports.file_error(F.col("path"), F.col("length")).alias("e")).collect()[0]["e"] is None and d.count() == 1


def test_recognise_failure_is_a_row(spark):
    pages = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "page_id long, image binary")

    def engine(image):
        if image == b"bad":
            raise ValueError("unreadable")
        return [{"text": "Au 2.5", "x": 1, "y": 2, "w": 3, "h": 4, "confidence": 0.9}]

    got = {r["page_id"]: (r["text"], r["error"]) for r in reports.recognise(pages, engine, "toy").collect()}
    assert got == {1: ("Au 2.5", None), 2: (None, "unreadable")}


def test_answers(spark):
    d = spark.createDataFrame([('{"a": 1}',), ('Here: {"a": 2} ok',), ("none",)], "s string")
    assert [r["answer"] and r["answer"]["a"] for r in reports.answers(d, "s", "a int").collect()] == [1, 2, None]


def test_occurrences(spark, tmp_path):
    (tmp_path / "m.csv").write_text("LonDec,latdec,commod1\n-116.1,35.4,REE\n,35.0,Au\n")
    assert [(r["lon"], r["lat"]) for r in reports.occurrences(spark, str(tmp_path / "m.csv")).collect()] == [(-116.1, 35.4)]


def test_utm_reference_point(spark):
    e, n = coords.latlon_to_utm(F.lit(45.0), F.lit(-123.0), F.lit(10))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r["e"] - 500000) < 1e-3 and abs(r["n"] - 4982950.400) < 1e-2


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, 1L as page_id, 0.5D as confidence union all select timestamp'2024-01-01 00:01:00', 1L, 0.7D").write.parquet(str(tmp_path / "in"))
    s = ingest.page_confidence(ingest.blocks(spark, str(tmp_path / "in"), "ts timestamp, page_id long, confidence double"))
    q = s.writeStream.outputMode("complete").format("memory").queryName("pc").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        r = spark.sql("select * from pc").first()
    finally:
        q.stop()
    assert r["n_blocks"] == 2 and abs(r["confidence"] - 0.6) < 1e-9


def test_files_that_are_missing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    named = spark.createDataFrame([("in/a.pdf",), ("in/gone.pdf",)], "path string")
    d = reports.listed(spark, named, str(tmp_path))
    assert {r.path: r.e for r in d.select("path", reports.file_error(F.col("path"), F.col("length")).alias("e")).collect()} == {"in/a.pdf": None, "in/gone.pdf": "no such file"}


def test_engines_take_over(spark):
    pages = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate((b"easy", b"hard", b"worse", b"lost", b"faint"))], "page_id long, image binary")

    def first(image):
        if image in (b"hard", b"lost"):
            raise ValueError("first can't")
        return [{"text": "one", "confidence": {b"easy": 0.9, b"worse": 0.3, b"faint": 0.4}[image]}]

    def second(image):
        if image == b"lost":
            raise ValueError("second can't")
        return [{"text": "two", "confidence": {b"hard": 0.9, b"worse": 0.8, b"faint": 0.2}[image]}]

    got = {r.page_id: (r.engine, r.text, r.error) for r in reports.recognised(pages, {"b": second, "a": first}, prefer="a", least=0.5).collect()}
    assert got == {0: ("a", "one", None), 1: ("b", "two", None), 2: ("b", "two", None), 3: ("b", None, "second can't"), 4: ("a", "one", None)}
