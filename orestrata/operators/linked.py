"""Linked-data documents (JSON-LD), geographic layers and metadata tables of report entities, as frames.

Rows hold JSON as text. Absent values leave no key; empty text stays.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.functions import dates
from orestrata.operators import exports, geometry

BASE = "urn:report"
# The metadata of a document in their order; the layer has all but the last two.
METADATA = (
    "source_file", "file_size_bytes", "processing_date", "confidence_score", "ocr_engine", "llm_model", "language", "page_count", "document_type", "title",
    "author", "company", "report_date", "report_type", "pages_processed", "ocr_confidence_avg", "extraction_confidence_avg", "processing_time_seconds", "errors", "warnings",
)
#: Those that a linked document always names, and those that it names where they are known.
ALWAYS, KNOWN = METADATA[:8], ("document_type", "report_type")
# The terms of the context that every document carries.
CONTEXT = (
    ("coordinates", "geo:coordinates", "geo:Point"),
    ("latitude", "geo:lat", "xsd:double"),
    ("longitude", "geo:long", "xsd:double"),
    ("elevation", "geo:alt", "xsd:double"),
    ("location_type", "geological:locationType", "geological:LocationType"),
    ("sample_type", "geological:sampleType", "geological:SampleType"),
    ("feature_type", "geological:featureType", "geological:FeatureType"),
    ("assay_result", "geological:assayResult", "geological:AssayResult"),
    ("element", "geological:element", "geological:ChemicalElement"),
    ("confidence", "geological:confidence", "xsd:double"),
)


def _text(d: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in d.columns else F.lit(None)).cast(kind)


def _json(value: Column) -> Column:
    """One value as JSON; null stays null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def _object(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of names and JSON values; a null value leaves no key."""
    return F.concat(F.lit("{"), F.array_join(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]), ","), F.lit("}"))


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _property(name: str, value: Column) -> Column:
    return _object(("@type", F.lit('"PropertyValue"')), ("name", F.lit(f'"{name}"')), ("value", _json(value)))


def _properties(always: list[tuple[str, Column]], known: list[tuple[str, Column]]) -> Column:
    """Property values: those of ``always`` in any case, those of ``known`` where they aren't null."""
    return _array(F.array(*[_property(k, v) for k, v in always], *[F.when(v.isNotNull(), _property(k, v)) for k, v in known]))


def _some(value: Column, nothing="") -> Column:
    return F.nullif(value, F.lit(nothing))


def _id(base: str, kind: str, value: Column) -> Column:
    return _json(F.concat(F.lit(f"{base}/{kind}/"), value.cast("string")))


def location_nodes(locations: DataFrame, base: str = BASE) -> DataFrame:
    """``doc_id, id, node`` of locations with the columns of ``exports.locations_table`` and ``doc_id``."""
    d, t = locations, lambda c: _text(locations, c)
    number = lambda c: _text(d, c, "double")
    geo = _object(("@type", F.lit('"GeoCoordinates"')), *[(c, _json(number(c))) for c in ("latitude", "longitude", "elevation")])
    parts = (("addressLocality", "county"), ("addressRegion", "state_province"), ("addressCountry", "country"))
    address = _object(("@type", F.lit('"PostalAddress"')), *[(k, _json(F.coalesce(t(c), F.lit("")))) for k, c in parts])
    grid = [(c, _some(number(c), 0.0)) for c in ("easting", "northing")] + [(c, _some(t(c))) for c in ("utm_zone", "township", "range", "section")]
    node = _object(
        ("@id", _id(base, "location", F.col("id"))), ("@type", F.lit('"geological:GeologicalLocation"')), ("name", _json(F.coalesce(_some(t("name")), F.concat(F.lit("Location "), F.col("id").cast("string"))))),
        ("description", _json(F.concat(F.lit("Geological "), t("location_type")))), ("geo", geo), ("address", address),
        ("additionalProperty", _properties([("location_type", t("location_type")), ("confidence", number("confidence"))], grid)),
    )
    return d.select("doc_id", F.col("id").cast("string").alias("id"), node.alias("node"))


def sample_nodes(samples: DataFrame, base: str = BASE) -> DataFrame:
    """``doc_id, id, node`` of samples (``sample_id``, ``assays`` an array of structs)."""
    d, t = samples, lambda c: _text(samples, c)
    number = lambda c: _text(d, c, "double")
    known = [("depth_from", number("depth_from")), ("depth_to", number("depth_to")), *[(c, _some(t(c))) for c in ("depth_unit", "lithology", "alteration", "mineralization")]]
    have = {f.name for f in d.schema["assays"].dataType.elementType.fields} if "assays" in d.columns else set()
    of = lambda a, c, kind="double": (a[c] if c in have else F.lit(None)).cast(kind)
    assay = lambda a: _object(
        ("@type", F.lit('"geological:AssayResult"')), ("element", _object(("@type", F.lit('"geological:ChemicalElement"')), ("name", _json(a["element"])))), ("value", _json(of(a, "value"))), ("unit", _json(a["unit"])),
        ("confidence", _json(of(a, "confidence"))), ("detectionLimit", _json(_some(of(a, "detection_limit"), 0.0))), ("method", _json(_some(of(a, "method", "string")))),
    )
    parts = F.when(F.size("assays") > 0, _array(F.transform("assays", assay))) if have else F.lit(None).cast("string")
    node = _object(
        ("@id", _id(base, "sample", F.col("sample_id"))), ("@type", F.lit('"geological:GeologicalSample"')), ("name", _json(F.concat(F.lit("Sample "), F.col("sample_id").cast("string")))),
        ("description", _json(F.concat(t("sample_type"), F.lit(" sample")))), ("additionalProperty", _properties([("sample_type", t("sample_type")), ("confidence", number("confidence"))], known)),
        ("dateCreated", _json(t("collection_date"))), ("hasPart", parts), ("isLocatedAt", F.when(F.col("location_id").isNotNull(), _object(("@id", _id(base, "location", F.col("location_id")))))),
    )
    return d.select("doc_id", F.col("sample_id").cast("string").alias("id"), node.alias("node"))


def observation_nodes(observations: DataFrame, base: str = BASE) -> DataFrame:
    """``doc_id, id, node`` of observations (``observation_id``; rock types and minerals are arrays)."""
    d, t = observations, lambda c: _text(observations, c)
    lists = [(c, _some(F.array_join(c, "; "))) for c in ("rock_types", "minerals") if c in d.columns]
    turns = [(c, _text(d, c, "double")) for c in ("strike", "dip", "trend", "plunge")]
    node = _object(
        ("@id", _id(base, "observation", F.col("observation_id"))), ("@type", F.lit('"geological:GeologicalObservation"')), ("name", _json(F.concat(t("feature_type"), F.lit(" observation")))), ("description", _json(t("description"))),
        ("additionalProperty", _properties([("feature_type", t("feature_type")), ("confidence", _text(d, "confidence", "double"))], lists + turns)),
        ("isLocatedAt", F.when(F.col("location_id").isNotNull(), _object(("@id", _id(base, "location", F.col("location_id")))))),
    )
    return d.select("doc_id", F.col("observation_id").cast("string").alias("id"), node.alias("node"))


KINDS = ("about", "hasPart", "mentions")


def _frame(metadata: DataFrame, base: str, vocab: str) -> DataFrame:
    """``doc_id, head, tail``: the members of each document before and after its lists of nodes, in braces."""
    m = metadata.select("doc_id", *[_text(metadata, c, metadata.schema[c].dataType.simpleString() if c in metadata.columns else "string").alias(c) for c in METADATA])
    file = F.regexp_extract(F.col("source_file").cast("string"), r"([^/]*)$", 1)
    terms = [(k, F.lit(f'{{"@id":"{i}","@type":"{t}"}}')) for k, i, t in CONTEXT]
    spaces = [("@vocab", _json(F.lit("https://schema.org/"))), ("geo", _json(F.lit("https://www.w3.org/2003/01/geo/wgs84_pos#"))), ("geological", _json(F.lit(vocab)))]
    head = _object(
        ("@context", _object(*spaces, *terms)), ("@id", _id(base, "document", F.regexp_replace(file, r"(?<=.)\.[^.]+$", ""))), ("@type", F.lit('"geological:GeologicalDocument"')),
        ("name", _json(F.coalesce(_some(F.col("title")), F.concat(F.lit("Geological Report: "), file)))), ("description", _json(F.concat(F.lit("Geological data extracted from "), file))), ("dateCreated", _json(F.col("processing_date"))),
        ("author", _object(("@type", F.lit('"Person"')), ("name", _json(F.coalesce(_some(F.col("author")), F.lit("Unknown")))))),
        ("publisher", _object(("@type", F.lit('"Organization"')), ("name", _json(_some(F.col("company")))))),
    )
    tail = _object(("additionalProperty", _properties([(c, F.col(c)) for c in ALWAYS], [(c, _some(F.col(c))) for c in KNOWN])))
    return m.select("doc_id", head.alias("head"), tail.alias("tail"))


def _opened(head: Column) -> Column:
    return F.substring(head, F.lit(1), F.length(head) - 1)


def documents(metadata: DataFrame, locations: DataFrame, samples: DataFrame, observations: DataFrame, base: str = BASE, vocab: str = "urn:report:vocab#") -> DataFrame:
    """``doc_id, jsonld``: one document with its context, its metadata and its nodes (``doc_id, id, node``), each kind by id.

    Nodes meet in one shuffle by document; ``metadata`` has one row a document. A document is one text here; :func:`pieces` has no such bound.
    """
    nodes = None
    for k, d in zip(KINDS, (locations, samples, observations)):
        d = d.select("doc_id", F.lit(k).alias("kind"), F.struct("id", "node").alias("n"))
        nodes = d if nodes is None else nodes.unionByName(d)
    lists = nodes.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("n")))).alias(k) for k in KINDS])
    nodes_of = lambda k: F.concat(F.lit(f',"{k}":'), _array(F.transform(F.coalesce(k, F.array().cast("array<struct<id:string,node:string>>")), lambda n: n["node"])))
    text = F.concat(_opened(F.col("head")), *[nodes_of(k) for k in KINDS], F.lit(","), F.substring("tail", F.lit(2), F.length("tail")))
    return _frame(metadata, base, vocab).join(lists, "doc_id", "left").select("doc_id", text.alias("jsonld"))


def pieces(metadata: DataFrame, locations: DataFrame, samples: DataFrame, observations: DataFrame, base: str = BASE, vocab: str = "urn:report:vocab#") -> DataFrame:
    """``doc_id, place, part, text``: the document of :func:`documents` in pieces that, one after another by ``place``, are its text.

    A document may have any number of nodes, so it isn't put together: no task holds more than a piece, and only ids are grouped.
    ``part`` is ``head``, ``tail``, the name of a list (its nodes), or ``between`` two lists. The nodes of a list differ in their ids.
    """
    frame, none = _frame(metadata, base, vocab), F.lit("")
    place = lambda at, node=none: F.struct(F.lit(at).alias("at"), node.alias("id")).alias("place")
    piece = lambda at, part, text: frame.select("doc_id", place(at), F.lit(part).alias("part"), text.alias("text"))
    out = piece(0, "head", F.concat(_opened(F.col("head")), F.lit(f',"{KINDS[0]}":[')))
    for n, (k, d) in enumerate(zip(KINDS, (locations, samples, observations))):
        least = frame.select("doc_id").join(d.groupBy("doc_id").agg(F.min("id").alias("_least")), "doc_id")
        text = F.concat(F.when(F.col("id") == F.col("_least"), "").otherwise(","), "node")
        out = out.unionByName(d.join(least, "doc_id").select("doc_id", place(2 * n + 1, F.col("id")), F.lit(k).alias("part"), text.alias("text")))
        if n + 1 < len(KINDS):
            out = out.unionByName(piece(2 * n + 2, "between", F.lit(f'],"{KINDS[n + 1]}":[')))
    return out.unionByName(piece(2 * len(KINDS), "tail", F.concat(F.lit("],"), F.substring("tail", F.lit(2), F.length("tail")))))


def location_layer(locations: DataFrame) -> DataFrame:
    """The layer of locations: their flat columns (without the quarter section), a place, and empty text or EPSG:4326 where nothing is known.

    The place is ``longitude, latitude`` of the location itself, else (0, 0).
    """
    at = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in (("longitude", "x"), ("latitude", "y"))]
    columns = [c for c in exports.LOCATIONS if c != "quarter_section"]
    filled = {c: F.coalesce(c, F.lit("EPSG:4326" if c == "coordinate_system" else "")) for c in ("utm_zone", "township", "range", "section", "coordinate_system")}
    return exports.flat(exports.locations_flat(locations.select("*", *at)), (*columns, "x", "y")).withColumns(filled)


def without_nulls(node: Column | str) -> Column:
    """JSON text without members and elements that are null, at any depth; text that isn't JSON is null."""

    def pruned(x):
        if isinstance(x, dict):
            return {k: pruned(v) for k, v in x.items() if v is not None}
        return [pruned(v) for v in x if v is not None] if isinstance(x, list) else x

    def of(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(pruned(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return F.pandas_udf(of, T.StringType())(node)


def location_geometries(locations: DataFrame, geometry_column: str = "geometry") -> DataFrame:
    """The layer of locations with a ``geom`` column in well-known binary: points, lines, and polygons by their outer ring; (0, 0) where there is no geometry."""
    columns = [c for c in exports.LOCATIONS if c != "quarter_section"]
    d = exports.locations_flat(locations).withColumn("geom", geometry.wkb(geometry.layer_geometry(F.col(geometry_column))))
    given = {c: F.coalesce(c, F.lit("EPSG:4326" if c == "coordinate_system" else "")) for c in ("utm_zone", "township", "range", "section", "coordinate_system")}
    return d.select(*exports.flat_columns(d, tuple(columns)), "geom").withColumns(given)


def metadata_table(metadata: DataFrame) -> DataFrame:
    """``doc_id, place, field, value``: the twenty values of each document as text, in order; what is missing is empty."""
    values = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), F.coalesce(_text(metadata, c), F.lit("")).alias("value")) for i, c in enumerate(METADATA)]
    return metadata.select("doc_id", F.explode(F.array(*values)).alias("v")).select("doc_id", "v.*")


def metadata_layer(metadata: DataFrame) -> DataFrame:
    """The metadata table without errors and warnings, at (0, 0)."""
    return metadata_table(metadata).where(F.col("place") < len(METADATA) - 2).withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})


def process_metadata(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """A model's metadata (a map): empty values go, and so does a report date in no known notation; one that is known is in ISO form."""
    day = F.date_format(dates.report_date(F.col(column)["report_date"]), "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.map_filter(column, lambda k, v: (k != "report_date") & (v != ""))
    return rows.withColumn(column, F.when(day.isNotNull(), F.map_concat(rest, F.create_map(F.lit("report_date"), day))).otherwise(rest))


def write_batch(features: DataFrame, folder: str) -> None:
    """The features of all documents, one a line (GeoJSON text sequences), so that no task holds a whole batch."""
    features.select("feature").write.mode("overwrite").text(folder)
