"""Exports of report entities as frames: flat tables with fixed columns, and GeoJSON collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orestrata.operators.entities import sample_keys

# The columns of the flat tables, in order.
COORDINATE_FIELDS = ("latitude", "longitude", "easting", "northing", "utm_zone", "township", "range", "section", "quarter_section", "coordinate_system")
LOCATIONS = ("id", "name", "location_type", *COORDINATE_FIELDS, "elevation", "elevation_unit", "county", "state_province", "country", "confidence", "source_text")
SAMPLES = ("id", "location_id", "sample_type", "depth_from", "depth_to", "depth_unit", "lithology", "alteration", "mineralization", "collection_date", "confidence", "source_text")
ASSAYS = ("sample_id", "element", "value", "unit", "detection_limit", "method", "confidence")
OBSERVATIONS = ("id", "feature_type", "description", "location_id", "strike", "dip", "trend", "plunge", "measurement_type", "rock_types", "minerals", "confidence", "source_text")
NUMBERS = ("latitude", "longitude", "easting", "northing", "elevation", "depth_from", "depth_to", "value", "detection_limit", "strike", "dip", "trend", "plunge", "confidence", "x", "y")
#: Text that is empty where it is missing; the other columns keep their nulls.
EMPTY = ("name", "county", "state_province", "country", "source_text", "location_id", "lithology", "alteration", "mineralization", "collection_date", "method", "measurement_type", "rock_types", "minerals")


def flat(rows: DataFrame, columns: tuple[str, ...], **given: Column) -> DataFrame:
    """``columns`` of ``rows`` as numbers or text; ``given`` says how one is made, and one that isn't there is missing."""
    return rows.select(*flat_columns(rows, columns, **given))


def flat_columns(rows: DataFrame, columns: tuple[str, ...], **given: Column) -> list[Column]:
    out = []
    for c in columns:
        x = given.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast("double" if c in NUMBERS else "string")
        out.append((F.coalesce(x, F.lit("")) if c in EMPTY else x).alias(c))
    return out


def locations_flat(locations: DataFrame) -> DataFrame:
    """Locations with ``id`` and the fields of their primary coordinate, the first of ``coordinates``; x and y of the place stay as they are."""
    first = F.get("coordinates", 0)
    have = {f.name for f in locations.schema["coordinates"].dataType.elementType.fields}
    return locations.withColumns({"id": F.col("location_id"), **{f: first[f] if f in have else F.lit(None) for f in COORDINATE_FIELDS}})


def locations_table(locations: DataFrame) -> DataFrame:
    """One row a location with its primary coordinate."""
    return flat(locations_flat(locations), LOCATIONS)


def samples_table(samples: DataFrame) -> DataFrame:
    return flat(samples, SAMPLES, id=F.col("sample_id"))


def assays_table(samples: DataFrame) -> DataFrame:
    """One row an assay of ``assays`` (an array of structs), with its sample's id, and its document's where there is one; samples without one have none."""
    keys = sample_keys(samples)
    d = samples.select(*keys, F.explode("assays").alias("a")).select(*keys, "a.*")
    return flat(d, ("doc_id", *ASSAYS) if "doc_id" in keys else ASSAYS)


def observations_table(observations: DataFrame) -> DataFrame:
    """Lists are joined by "; "."""
    lists = {c: F.array_join(c, "; ") for c in ("rock_types", "minerals") if c in observations.columns}
    return flat(observations, OBSERVATIONS, id=F.col("observation_id"), **lists)


def with_assays(samples: DataFrame, assays: DataFrame) -> DataFrame:
    """Samples with their assays as an array in order (``ord``); a sample without one has an empty array."""
    keys = sample_keys(samples, assays)
    fields = [c for c in assays.columns if c not in ("doc_id", "sample_id")]
    lists = assays.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"]))).alias("assays"))
    d = samples.join(lists, keys, "left")
    return d.withColumn("assays", F.coalesce("assays", F.array().cast(lists.schema["assays"].dataType)))


def write_tables(folder: str, **tables: DataFrame) -> list[str]:
    """Each table as CSV with a header in a folder of its own; a table without rows is left out. The names written.

    ``assays`` go with the ``samples``: where there are samples, their table is written even if it has no rows.
    """
    written = []
    for name, d in tables.items():
        if not (tables["samples"] if name == "assays" and "samples" in tables else d).isEmpty():
            # A table without rows is one file with its header.
            (d.coalesce(1) if d.isEmpty() else d).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
            written.append(name)
    return written


def _point() -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))


def _with_member(object_text: Column, name: str, value: Column) -> Column:
    """The text of an object with one more member at its end."""
    return F.concat(F.substring(object_text, F.lit(1), F.length(object_text) - 1), F.lit(f',"{name}":'), value, F.lit("}"))


def location_features(locations: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``doc_id, location_id, feature``: GeoJSON text with base properties, nulls kept; samples without assays only where there are some, nulls left out."""
    base = [F.col(c) if c in locations.columns else F.lit(None).cast("string").alias(c) for c in ("name", "location_type", "elevation", "elevation_unit", "county", "state_province", "country", "confidence")]
    props = F.to_json(F.struct(F.col("location_id").cast("string").alias("id"), *base), {"ignoreNullFields": "false"})
    d = locations.withColumn("_props", props).withColumn("_point", F.to_json(_point()))
    if "coordinates" in locations.columns:
        # What a coordinate lacks is left out, as text is made of it; a location without any has no list.
        d = d.withColumn("_props", F.when(F.size("coordinates") > 0, _with_member(F.col("_props"), "coordinates", F.to_json("coordinates"))).otherwise(F.col("_props")))
    if samples is not None:
        nested = samples.groupBy("location_id").agg(F.array_sort(F.collect_list(F.struct(*_nested_fields(samples)))).alias("_samples"))
        d = d.join(nested, "location_id", "left")
        more = _with_member(F.col("_props"), "samples", F.to_json("_samples"))
        d = d.withColumn("_props", F.when(F.col("_samples").isNotNull(), more).otherwise(F.col("_props")))
    return d.select("doc_id", "location_id", F.concat(F.lit('{"type":"Feature","geometry":'), "_point", F.lit(',"properties":'), "_props", F.lit("}")).alias("feature"))


def _nested_fields(samples: DataFrame) -> list[str]:
    return [c for c in samples.columns if c not in ("location_id", "assays", "doc_id")]


def sample_features(samples: DataFrame, locations: DataFrame) -> DataFrame:
    """``doc_id, sample_id, feature`` of samples with a location, at its place, with their assays if there are any."""
    here = locations.select("location_id", "doc_id", "longitude", "latitude", F.col("name").alias("location_name"))
    d = samples.drop("doc_id").join(here, "location_id")
    base = [F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in SAMPLES[2:11]]
    props = F.to_json(F.struct(F.col("sample_id").alias("id"), base[0], F.col("location_id").cast("string").alias("location_id"), "location_name", *base[1:]), {"ignoreNullFields": "false"})
    if "assays" in d.columns:
        assays = F.to_json(F.transform("assays", lambda a: F.struct(*[a[f.name].alias(f.name) for f in d.schema["assays"].dataType.elementType.fields if f.name in ASSAYS])))
        props = F.when(F.size("assays") > 0, _with_member(props, "assays", assays)).otherwise(props)
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.to_json(_point()), F.lit(',"properties":'), props, F.lit("}"))
    return d.select("doc_id", "sample_id", text.alias("feature"))


def totals(locations: DataFrame, samples: DataFrame, observations: DataFrame) -> DataFrame:
    """``doc_id`` and how many locations, samples and observations it has (samples and observations by ``doc_id``)."""
    parts = []
    for k, d in enumerate((locations, samples, observations)):
        parts.append(d.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", *[(F.col("n") if i == k else F.lit(0).cast("long")).alias(c) for i, c in enumerate(("total_locations", "total_samples", "total_observations"))]))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("doc_id is not null")
    return whole.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("total_locations", "total_samples", "total_observations")])


_HEAD = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::4326"}},'


def pieces(locations: DataFrame, samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """``doc_id, place, part, text``: each document's collection with nested samples in pieces that, one after another by ``place``, are its text.

    A document or a location may have any number of samples, so none is put together: no task holds more than a piece, and nothing as wide as a piece is grouped.
    ``part`` is ``open``, ``feature``, ``location`` (a feature up to its samples), ``nested``, ``end`` or ``close``. The text is that of :func:`collections`;
    the samples of a location differ from each other.
    """
    none, kinds = F.lit(""), {"open": 0, "location": 1, "sample": 2, "close": 3}
    place = lambda kind, a=none, b=0, c=none: F.struct(F.lit(kinds[kind]).alias("kind"), a.alias("id"), F.lit(b).alias("step"), c.alias("nested")).alias("place")
    fields = F.struct(*_nested_fields(samples))
    least = samples.groupBy("location_id").agg(F.min(fields).alias("_least"))
    first = locations.groupBy("doc_id").agg(F.min("location_id").alias("_first"))
    own = location_features(locations).join(least, "location_id", "left").join(first, "doc_id")
    comma = lambda first: F.when(first, "").otherwise(",")
    lid, has = F.format_string("%020d", "location_id"), F.col("_least").isNotNull()
    text = F.concat(comma(F.col("location_id") == F.col("_first")), F.when(has, F.concat(F.substring("feature", F.lit(1), F.length("feature") - 2), F.lit(',"samples":['))).otherwise(F.col("feature")))
    heads = own.select("doc_id", place("location", lid), F.when(has, "location").otherwise("feature").alias("part"), text.alias("text"))
    ends = own.where(has).select("doc_id", place("location", lid, 2), F.lit("end").alias("part"), F.lit("]}}").alias("text"))
    within = samples.select("location_id", fields.alias("_s")).join(least, "location_id").join(locations.select("location_id", "doc_id"), "location_id")
    nested = within.select("doc_id", place("location", lid, 1, F.col("_s.sample_id").cast("string")), F.lit("nested").alias("part"), F.concat(comma(F.col("_s") == F.col("_least")), F.to_json("_s")).alias("text"))
    features = sample_features(samples, locations).select("doc_id", place("sample", F.col("sample_id").cast("string")), F.lit("feature").alias("part"), F.concat(F.lit(","), "feature").alias("text"))
    opened = first.select("doc_id", place("open"), F.lit("open").alias("part"), F.lit(_HEAD + '"features":[').alias("text"))
    told = metadata.select("doc_id", F.to_json(F.struct(*[c for c in metadata.columns if c != "doc_id"])).alias("_m"))
    closed = first.join(told, "doc_id", "left").select("doc_id", place("close"), F.lit("close").alias("part"), F.concat(F.lit("]"), F.coalesce(F.concat(F.lit(',"metadata":'), "_m"), F.lit("")), F.lit("}")).alias("text"))
    out = opened
    for d in (heads, nested, ends, features, closed):
        out = out.unionByName(d)
    return out


def collections(features: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One GeoJSON FeatureCollection a document. ``features`` has ``doc_id, place`` (its order) and ``feature``; ``metadata`` a row a document, whose nulls are left out."""
    d = features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature"))).alias("fs"))
    body = F.concat(F.lit('"features":['), F.array_join(F.transform("fs", lambda f: f["feature"]), ","), F.lit("]"))
    if metadata is not None:
        d = d.join(metadata.select("doc_id", F.to_json(F.struct(*[c for c in metadata.columns if c != "doc_id"])).alias("_m")), "doc_id", "left")
        body = F.concat(body, F.coalesce(F.concat(F.lit(',"metadata":'), "_m"), F.lit("")))
    head = F.lit(_HEAD)
    return d.select("doc_id", F.size("fs").alias("n_features"), F.concat(head, body, F.lit("}")).alias("geojson"))



# The columns of the combined table, in order.
COMBINED = (
    "record_type", "id", "name", "location_type", "latitude", "longitude", "easting", "northing", "utm_zone", "township", "range", "section", "elevation", "county", "state_province", "country",
    "sample_type", "depth_from", "depth_to", "depth_unit", "lithology", "alteration", "mineralization", "element", "value", "unit", "detection_limit",
    "feature_type", "description", "strike", "dip", "rock_types", "minerals", "confidence", "source_text",
)


def combined_table(locations: DataFrame, samples: DataFrame, observations: DataFrame) -> DataFrame:
    """All records of a document in one table with a ``place``: locations, then each sample with its assays after it, then observations.

    Each has ``ord``, its number among its kind in its document (``doc_id``). What a kind lacks is missing. Places sort records; nothing is sorted here.
    """
    place = lambda kind, within: F.struct(F.lit(kind).alias("kind"), F.col("ord").alias("ord"), within.alias("within")).alias("place")
    none = F.lit(0)

    def rows(d: DataFrame, kind: str, at: Column, **given: Column) -> DataFrame:
        return d.select("doc_id", at, *flat_columns(d, COMBINED, record_type=F.lit(kind), **given))

    own = rows(samples, "sample", place(1, none), id=F.col("sample_id"))
    assays = samples.select("doc_id", "ord", "sample_id", F.posexplode("assays").alias("k", "a")).select("doc_id", "ord", "sample_id", "k", *[F.col(f"a.{f.name}").alias(f.name) for f in samples.schema["assays"].dataType.elementType.fields if f.name in ASSAYS])
    under = rows(assays, "assay", place(1, F.col("k") + 1), id=F.col("sample_id"))
    lists = {c: F.array_join(c, "; ") for c in ("rock_types", "minerals") if c in observations.columns}
    seen = rows(observations, "observation", place(2, none), id=F.col("observation_id"), **lists)
    return rows(locations_flat(locations), "location", place(0, none)).unionByName(own).unionByName(under).unionByName(seen)


def hotspot_features(boxes: DataFrame, score: str = "score") -> DataFrame:
    """``feature``: the box of each hotspot (``x_min, y_min, x_max, y_max``) as a GeoJSON polygon on the raster's own map, with its place and score."""
    corner = lambda x, y: F.array(f"{x}", f"{y}")
    ring = F.array(corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"), corner("x_min", "y_min"), corner("x_max", "y_min"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    props = F.struct("row_id", "col_id", F.col(score).alias("score"))
    return boxes.select("row_id", "col_id", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))


def only(locations: DataFrame | None = None, samples: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """Collections of locations alone (``locations``), or of samples alone at the locations ``at``; without metadata."""
    if (locations is None) == (samples is None):
        raise ValueError("either locations or samples")
    if locations is not None:
        d = location_features(locations).select("doc_id", F.struct(F.lit(0).alias("kind"), F.col("location_id").cast("string").alias("id")).alias("place"), "feature")
    else:
        d = sample_features(samples, at).select("doc_id", F.struct(F.lit(1).alias("kind"), F.col("sample_id").alias("id")).alias("place"), "feature")
    return collections(d)
