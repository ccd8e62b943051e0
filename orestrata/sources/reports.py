"""Reports as files: the scan, its validity, and pluggable page rendering and recognition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orestrata.session import checkpointed

MAX_BYTES = 100 * 1024 * 1024
MAX_PAGES = 1000


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, modificationTime, length, content`` of the files; their content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def file_error(path: Column, length: Column, pages: Column | None = None) -> Column:
    """The first rule that a file breaks, or null."""
    e = F.when(length.isNull(), "no such file").when(~F.lower(path).endswith(".pdf"), "not a pdf").when(length > MAX_BYTES, "too large").when(length <= 0, "empty")
    if pages is not None:
        e = e.when(pages < 1, "no pages").when(pages > MAX_PAGES, "too many pages")
    return e


def is_scanned(pages: DataFrame) -> DataFrame:
    """Documents (``doc_id``) whose first three pages hold less than 100 characters of text."""
    chars = F.sum(F.when(F.col("page") < 3, F.length(F.trim(F.coalesce("text", F.lit(""))))).otherwise(0))
    return pages.groupBy("doc_id").agg((chars < 100).alias("scanned"))


def recognise(pages: DataFrame, engine: Callable[[bytes], list[dict]], name: str) -> DataFrame:
    """Blocks of every page image (``page_id, image``) by a pluggable engine.

    An engine returns dicts with ``text, x, y, w, h, confidence``. A page on which it fails gives one row with
    ``error``, so that other engines can take over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, image in zip(b["page_id"], b["image"], strict=True):
                try:
                    found = engine(bytes(image) if image is not None else b"")
                    out += [(page, i, k.get("text"), k.get("x"), k.get("y"), k.get("w"), k.get("h"), float(k.get("confidence") or 0.0), name, None) for i, k in enumerate(found)]
                except Exception as x:  # the engine is foreign code; its failure is data
                    out.append((page, None, None, None, None, None, None, 0.0, name, str(x)))
            yield pd.DataFrame(out, columns=["page_id", "block_ord", "text", "x", "y", "w", "h", "confidence", "engine", "error"])

    return pages.select("page_id", "image").mapInPandas(
        run, "page_id long, block_ord long, text string, x long, y long, w long, h long, confidence double, engine string, error string"
    )


def listed(spark: SparkSession, paths: DataFrame, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, length`` of the files that ``paths`` names, by their names in ``folder``; those that aren't there have no length."""
    there = scan(spark, folder, pattern).select(F.element_at(F.split("path", "/"), -1).alias("_name"), "length")
    return paths.select("path", F.element_at(F.split("path", "/"), -1).alias("_name")).join(there, "_name", "left").drop("_name")


def recognised(pages: DataFrame, engines: dict[str, Callable[[bytes], list[dict]]], prefer: str | None = None, least: float = 0.0) -> DataFrame:
    """Blocks of every page by the preferred engine (else the first), and by the next where one fails or is less sure than ``least`` on average.

    A page that no engine is sure of has the blocks of the one that is surest; one on which all fail has the last error. Each engine reads only
    the pages that are left to it.
    """
    order = sorted(engines, key=lambda e: e != prefer)
    left, out, weak = pages.select("page_id", "image"), None, None
    for k, name in enumerate(order):
        blocks = checkpointed(recognise(left, engines[name], name))
        sure = blocks.groupBy("page_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"))
        done = sure.where((F.col("failed") == 0) & (F.col("mean") >= least)).select("page_id")
        kept, rest = blocks.join(done, "page_id", "left_semi"), blocks.join(done, "page_id", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        weak = rest if weak is None else weak.unionByName(rest)
        # An engine that finds nothing on a page gives no row; such a page is left to the next.
        left = left.join(done, "page_id", "left_anti")
        if k + 1 < len(order) and left.isEmpty():
            break
    rank = F.create_map(*[F.lit(x) for k, e in enumerate(order) for x in (e, k)])
    each = weak.join(left.select("page_id"), "page_id", "left_semi").withColumn("rank", F.element_at(rank, F.col("engine")))
    best = each.groupBy("page_id", "engine", "rank").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.avg("confidence").alias("mean"))
    # The surest that didn't fail, the first of them in order; if all failed, the last.
    surest = best.groupBy("page_id").agg(F.max_by("engine", F.struct(F.col("failed") == 0, F.when(F.col("failed") == 0, F.col("mean")).otherwise(0.0), F.when(F.col("failed") == 0, -F.col("rank")).otherwise(F.col("rank")))).alias("engine"))
    return out.unionByName(weak.join(surest, ["page_id", "engine"], "left_semi").select(*out.columns))


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Mineral occurrences from CSV with ``lon`` and ``lat``; the columns are ``longitude``/``latitude`` or ``londec``/``latdec``."""
    d = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in d.columns}
    pair = next(((names[a], names[b]) for a, b in (("longitude", "latitude"), ("londec", "latdec")) if a in names and b in names), None)
    if pair is None:
        raise ValueError("no longitude and latitude columns")
    return d.withColumn("lon", F.expr(f"try_cast(`{pair[0]}` as double)")).withColumn("lat", F.expr(f"try_cast(`{pair[1]}` as double)")).dropna(subset=["lon", "lat"])


def answers(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A model's JSON answer parsed, its text kept as ``answer_text``; an answer with words around it gives its outermost braces."""
    whole = F.from_json(column, schema)
    inner = F.from_json(F.regexp_extract(column, r"(?s)\{.*\}", 0), schema)
    return rows.withColumn("answer_text", F.col(column)).withColumn("answer", F.when(F.trim(column).startswith("{"), F.coalesce(whole, inner)).otherwise(inner))


def upload_error(files: DataFrame, name: str = "path") -> DataFrame:
    """``accepted, rejected``: one row; a batch with any file that isn't a PDF by its name is refused as a whole, and the least such name says why."""
    bad = F.min(F.when(~F.lower(F.coalesce(name, F.lit(""))).endswith(".pdf"), F.coalesce(name, F.lit(""))))
    return files.agg(bad.alias("rejected")).select(F.col("rejected").isNull().alias("accepted"), "rejected")


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """``path, valid, n_features`` of GeoJSON files, one document a file; a file without a list of features isn't valid."""
    d = spark.read.option("wholetext", True).option("pathGlobFilter", "*.geojson").text(path)
    n = F.size(F.from_json("value", "features array<string>")["features"])
    ok = F.from_json("value", "features array<string>")["features"].isNotNull()
    return d.select(F.col("_metadata.file_path").alias("path"), ok.alias("valid"), F.when(ok, n).otherwise(0).alias("n_features"))
