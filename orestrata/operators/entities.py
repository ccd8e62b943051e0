"""Joins, nesting, links and exports of report entities (locations, samples, assays, observations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_features(samples: DataFrame, locations: DataFrame) -> DataFrame:
    """Samples with a location, at its place."""
    return samples.join(locations.select("location_id", "longitude", "latitude"), "location_id")


def layer(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """All rows; those without a location lie at (0, 0)."""
    j = rows.join(locations.select("location_id", "longitude", "latitude"), "location_id", "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("longitude", "latitude")})


def orphans(samples: DataFrame, locations: DataFrame) -> DataFrame:
    return samples.join(locations.select("location_id").distinct(), "location_id", "left_anti")


def sample_keys(*frames: DataFrame) -> list[str]:
    """What names a sample in all of ``frames``: its number within its document. Reports number their samples themselves, so
    several have an "S1"; frames of a single document may lack ``doc_id``."""
    return ["doc_id", "sample_id"] if all("doc_id" in d.columns for d in frames) else ["sample_id"]


def assay_counts(assays: DataFrame) -> DataFrame:
    return assays.groupBy(*sample_keys(assays)).agg(F.count("*").alias("assay_count"))


def nested_samples(samples: DataFrame, locations: DataFrame) -> DataFrame:
    """One row a location with its samples' ids in order."""
    ids = samples.groupBy("location_id").agg(F.array_sort(F.collect_list("sample_id")).alias("samples"))
    return locations.join(ids, "location_id", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def link_first(samples: DataFrame, locations: DataFrame, reach: int = 100) -> DataFrame:
    """Each sample with the first location of its document whose name and whose mention of the sample stand less than
    ``reach`` characters apart (a text that isn't found stands before the first character).

    An equi-join on the document with a running least location, so no list of pairs is kept.
    """
    s, l = samples.alias("s"), locations.alias("l")
    place = lambda text, what: F.when(F.coalesce(what, F.lit("")) == "", 1).otherwise(F.instr(text, what))
    apart = F.abs(place(F.col("s.source_text"), F.col("l.name")) - place(F.col("l.source_text"), F.col("s.sample_id")))
    near = (F.col("s.source_text") != "") & (F.col("l.source_text") != "") & (apart < reach)
    found = s.join(l, F.col("s.doc_id") == F.col("l.doc_id")).where(near).groupBy("s.doc_id", "s.sample_id").agg(F.min("l.location_id").alias("linked_id"))
    return samples.join(found, ["doc_id", "sample_id"], "left")


def combined(locations: DataFrame, samples: DataFrame, assays: DataFrame, observations: DataFrame) -> DataFrame:
    """All records in one table; columns that a kind lacks are null."""
    parts = [d.withColumn("record_type", F.lit(k)) for k, d in (("location", locations), ("sample", samples), ("assay", assays), ("observation", observations))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def geojson(locations: DataFrame) -> DataFrame:
    """One GeoJSON FeatureCollection a document; base properties keep their nulls."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    props = F.struct("location_id", "name", "location_type", "elevation", "state_province", "country", "confidence")
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))
    per_doc = locations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("location_id", feature.alias("f")))).alias("fs"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit("urn:ogc:def:crs:EPSG::4326").alias("name")).alias("properties"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.transform("fs", lambda x: x["f"]).alias("features"))
    return per_doc.select("doc_id", F.size("fs").alias("n_features"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("geojson"))


def jsonld(locations: DataFrame) -> DataFrame:
    """One JSON-LD node a location; nulls are left out."""
    place = F.struct(F.lit("GeoCoordinates").alias("@type"), "latitude", "longitude", "elevation")
    node = F.struct(
        F.concat(F.lit("urn:location:"), F.col("location_id").cast("string")).alias("@id"), F.lit("Place").alias("@type"), "name", place.alias("geo"), F.col("country").alias("addressCountry")
    )
    return locations.select("location_id", F.to_json(node).alias("jsonld"))


def pivot_elements(assays: DataFrame, elements: list[str]) -> DataFrame:
    """Mean value of each element by sample, 0 where there is none. The elements are given, so no pass looks for them."""
    return assays.groupBy(*sample_keys(assays)).pivot("element", elements).agg(F.avg("value")).fillna(0.0)


def summary(locations: DataFrame, samples: DataFrame) -> DataFrame:
    """Per kind: rows, rows without an error, errors. Both have a column ``errors``."""
    out = None
    for kind, d in (("location", locations), ("sample", samples)):
        one = d.agg(F.count("*").alias("n"), F.count_if(F.size("errors") == 0).alias("n_valid"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("n_errors"))
        one = one.select(F.lit(kind).alias("entity"), "n", "n_valid", "n_errors")
        out = one if out is None else out.unionByName(one)
    return out


def key_values(rows: DataFrame, key: str) -> DataFrame:
    """``key, field, value``: one row for each other column, as text; a missing value is empty."""
    pairs = [F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in rows.columns if c != key]
    return rows.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.field", "p.value")


def cross_warnings(samples: DataFrame, locations: DataFrame, coordinates: DataFrame, spread: float = 0.1) -> DataFrame:
    """``warning, subject``: samples without a location, and places (``place, latitude, longitude``) whose several
    coordinates lie more than ``spread`` degrees apart."""
    far = lambda c: (F.max(c) - F.min(c)) > spread
    places = coordinates.groupBy("place").agg(F.count("*").alias("n"), far("latitude").alias("latitude"), far("longitude").alias("longitude")).where("n > 1")
    out = orphans(samples, locations).select(F.lit("orphan").alias("warning"), F.col("sample_id").cast("string").alias("subject"))
    for c in ("latitude", "longitude"):
        out = out.unionByName(places.where(c).select(F.lit(c).alias("warning"), F.col("place").cast("string").alias("subject")))
    return out


def cross_messages(samples: DataFrame, locations: DataFrame, coordinates: DataFrame, spread: float = 0.1) -> DataFrame:
    """``warning``: the messages across entities. One says how many samples have no location, one that some name a location that isn't there
    (or none), and one for each place and axis whose several coordinates lie too far apart."""
    lost = orphans(samples, locations).agg(F.count("*").alias("n"), F.count_if(F.col("location_id").isNull()).alias("unplaced"))
    unplaced = F.when(F.col("unplaced") > 0, F.concat(F.col("unplaced").cast("string"), F.lit(" samples without a location")))
    absent = F.when(F.col("n") > 0, F.lit("samples name locations that aren't there"))
    out = lost.select(F.explode(F.array_compact(F.array(unplaced, absent))).alias("warning"))
    far = cross_warnings(samples.limit(0), locations, coordinates, spread)
    return out.unionByName(far.select(F.concat("subject", F.lit(": several values of "), "warning").alias("warning")))


def report(locations: DataFrame, samples: DataFrame, warnings: DataFrame) -> DataFrame:
    """``entity, n, errors, warnings, valid``: a row for each kind (both have ``errors``), one for the warnings across them, and the totals."""
    one = lambda d, kind: d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("errors")).select(F.lit(kind).alias("entity"), "n", "errors", F.lit(0).cast("long").alias("warnings"))
    none = F.lit(0).cast("long")
    rows = one(locations, "locations").unionByName(one(samples, "samples"))
    rows = rows.unionByName(warnings.agg(F.count("*").alias("warnings")).select(F.lit("cross_validation").alias("entity"), none.alias("n"), none.alias("errors"), "warnings"))
    valid = F.when(F.col("entity").isin("locations", "samples"), F.col("errors") == 0)
    whole = rows.agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings")).select(F.lit("total").alias("entity"), none.alias("n"), "errors", "warnings")
    return rows.unionByName(whole).withColumn("valid", valid)
