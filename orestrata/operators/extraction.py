"""Entities from a model's parsed answers: defaults, checks and geometry, as column expressions; bad items are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orestrata.functions import coords

# The kinds that are known, and what an absent field is taken for.
LOCATION_TYPES = ("drill_hole", "sample_site", "mine", "claim", "prospect", "outcrop")
SAMPLE_TYPES = ("core", "chip", "grab", "channel", "soil", "rock", "drill_cuttings")
FEATURE_TYPES = ("fault", "fold", "contact", "mineralization", "alteration", "vein", "dike", "sill", "unconformity", "bedding")
LENGTH_UNITS = ("m", "ft")
ASSAY_UNITS = ("ppm", "%", "g/t", "oz/t", "ppb", "wt%")
DEFAULTS = {"location_type": "sample_site", "sample_type": "rock", "feature_type": "contact", "depth_unit": "m", "unit": "ppm", "confidence": 0.5, "value": 0.0, "description": ""}
# Factors of units to parts of one, as they are given.
UNIT_FACTORS = {"ppm": 1e-6, "ppb": 1e-9, "ppt": 1e-12, "%": 0.01, "wt%": 0.01, "g/t": 1e-6, "mg/t": 1e-9, "oz/t": 3.11035e-5, "lb/t": 1.10231e-6, "vol%": 0.01}

COORDINATE = "struct<latitude:double,longitude:double,easting:double,northing:double,utm_zone:string,confidence:double,source_text:string>"


def default(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(DEFAULTS[column])).alias(column)


def unit_factor(unit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in UNIT_FACTORS.items() for x in (k, v)]), unit)


def grid_reference_valid(easting: Column, northing: Column) -> Column:
    """Whether a grid reference lies in the range of a zone, its ends included; a missing part is no fault."""
    return F.coalesce(easting.between(0, 1e6), F.lit(True)) & F.coalesce(northing.between(0, 1e7), F.lit(True))


def coordinate(c: Column) -> Column:
    """A coordinate: what its text says, else its numbers if they are in range (confidence 0.5 if absent), else null."""
    said = coords.parse(c["source_text"])
    of = lambda name: F.coalesce(said[name], F.when(said.isNull(), c[name]))
    ok = F.coalesce(c["latitude"].between(-90, 90), F.lit(True)) & F.coalesce(c["longitude"].between(-180, 180), F.lit(True))
    confidence = F.coalesce(said["confidence"], c["confidence"], F.lit(0.5))
    out = F.struct(*[of(n).alias(n) for n in ("latitude", "longitude", "easting", "northing", "utm_zone")], F.coalesce(said["crs"], F.lit("EPSG:4326")).alias("coordinate_system"), confidence.alias("confidence"), c["source_text"].alias("source_text"))
    return F.when(said.isNotNull() | (ok & confidence.between(0, 1)), out)


def geometry(coordinates: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the first coordinate; (0, 0) where there is none."""
    first = F.get(coordinates, 0)
    both = first["longitude"].isNotNull() & first["latitude"].isNotNull()
    return F.when(both, first["longitude"]).otherwise(0.0), F.when(both, first["latitude"]).otherwise(0.0)


def locations(items: DataFrame) -> DataFrame:
    """Locations of ``items`` (fields may be absent); unknown types and elevation units and confidences out of range are dropped, and coordinates that don't parse."""
    d = items.withColumns({"location_type": default("location_type"), "confidence": default("confidence")})
    d = d.withColumn("coordinates", F.filter(F.transform(F.coalesce("coordinates", F.array().cast(f"array<{COORDINATE}>")), coordinate), lambda c: c.isNotNull()))
    lon, lat = geometry(F.col("coordinates"))
    d = d.where(F.col("location_type").isin(*LOCATION_TYPES) & F.col("confidence").between(0, 1))
    if "elevation_unit" in d.columns:
        d = d.withColumn("elevation_unit", F.coalesce("elevation_unit", F.lit("m"))).where(F.col("elevation_unit").isin(*LENGTH_UNITS))
    return d.withColumns({"longitude": lon, "latitude": lat})


def samples(items: DataFrame) -> DataFrame:
    """Samples with defaults; those of unknown type or depth unit, with inverted depths or an assay that can't be are dropped.

    An assay without an element has an empty one. Samples are linked to locations later.
    """
    d = items.withColumns({c: default(c) for c in ("sample_type", "depth_unit", "confidence")}).withColumn("sample_id", F.coalesce("sample_id", F.lit("")))
    assay = lambda a: F.struct(
        F.coalesce(a["element"], F.lit("")).alias("element"), F.coalesce(a["value"], F.lit(DEFAULTS["value"])).alias("value"), F.coalesce(a["unit"], F.lit(DEFAULTS["unit"])).alias("unit"),
        a["detection_limit"].alias("detection_limit"), F.coalesce(a["confidence"], F.lit(DEFAULTS["confidence"])).alias("confidence"),
    )
    d = d.withColumn("assays", F.transform(F.coalesce("assays", F.array().cast(items.schema["assays"].dataType)), assay))
    good = F.forall("assays", lambda a: (a["value"] >= 0) & a["unit"].isin(*ASSAY_UNITS) & a["confidence"].between(0, 1))
    depths = F.coalesce(F.col("depth_to") > F.col("depth_from"), F.lit(True))
    return d.where(good & depths & F.col("depth_unit").isin(*LENGTH_UNITS) & F.col("sample_type").isin(*SAMPLE_TYPES) & F.col("confidence").between(0, 1))


def observations(items: DataFrame) -> DataFrame:
    """Observations with defaults; unknown kinds and measurements out of range are dropped. A measurement's confidence is ``measurement_confidence``."""
    d = items.withColumns({c: default(c) for c in ("feature_type", "description", "confidence")})
    ranges = {"strike": 360, "dip": 90, "trend": 360, "plunge": 90, "measurement_confidence": 1}
    good = F.col("feature_type").isin(*FEATURE_TYPES) & F.col("confidence").between(0, 1)
    for c, most in ranges.items():
        if c in d.columns:
            good = good & F.coalesce(F.col(c).between(0, most), F.lit(True))
    return d.where(good)


def first_metadata(blocks: DataFrame) -> DataFrame:
    """``doc_id`` and the first ``metadata`` (a map) that holds anything, by page and block."""
    some = blocks.where(F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))) > 0)
    return some.groupBy("doc_id").agg(F.min_by("metadata", F.struct("page_id", "block_ord")).alias("metadata"))


def batch_counts(results: DataFrame) -> DataFrame:
    """Documents that went through and documents that failed (``error``)."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))
