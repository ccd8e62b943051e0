"""Queries over the extraction dataflow: blocks, a stand-in engine's answers, entities, and the checks of nested entities."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from orestrata.functions import checks
from orestrata.operators import dataflow, entities, exports
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection
from orestrata.session import checkpointed


async def stand_in(text: str) -> str:
    """An engine that answers from the block's own words (``event number``, some with a degree sign), and fails for some numbers."""
    kind, said = text.split(" ", 1)
    number = float(said.rstrip("°N"))
    if 13 <= number < 14:
        raise RuntimeError("the engine is down")
    if 14 <= number < 15:
        return "no idea"
    found: dict = {"locations": [], "samples": [], "geological_observations": []}
    if said.endswith("°N"):
        found["locations"] = [{"name": kind, "location_type": "mine", "coordinates": [{"latitude": number, "longitude": -number}]}, {"name": kind, "location_type": "volcano"}]
    else:
        found["samples"] = [{"id": f"S{int(number)}", "assays": [{"value": number}], "depth_from": 1.0, "depth_to": 1.0 + number - 2}]
    if kind == "purchase":
        found["geological_observations"] = [{"description": kind, "measurements": {"strike": number * 10, "trend": 370 if number < 5 else 5}}]
    if kind == "view" and number > 40:
        found["document_metadata"] = {"title": said}
    return ("Here it is: " if number > 50 else "") + json.dumps(found)


def _extracted(spark, sf_dir):
    blocks = projection(spark, sf_dir, "ocr_block").select(F.col("page_id").alias("doc_id"), "page_id", "block_ord", "text")
    return dataflow.extracted(checkpointed(dataflow.asked(dataflow.questions(blocks), stand_in, wait=0.0)))


_READ = """, q as (select page_id, block_ord, text, split_part(text, ' ', 1) as kind, split_part(text, ' ', 2) as said, replace(split_part(text, ' ', 2), '°N', '')::double as x from ocr_block),
ok as (select * from q where not (x >= 13 and x < 15)) """


@register(
    "extracted_entities",
    cte("ocr_block")
    + _READ
    + """select page_id, block_ord, 'location' as entity, kind as name, x as value, 0.5::double as confidence from ok where said like '%°N'
union all select page_id, block_ord, 'sample', 'S' || floor(x)::int, x, 0.5 from ok where said not like '%°N' and 1 + x - 2 > 1
union all select page_id, block_ord, 'observation', 'contact', x * 10, 0.5 from ok where kind = 'purchase' and x >= 5 and x * 10 <= 360
union all select page_id, block_ord, 'failed', case when x < 14 then 'the engine is down' else 'the answer isn''t JSON' end, case when x < 14 then 3 else 1 end, null from q where x >= 13 and x < 15""",
)
def extracted_entities(spark, sf_dir):
    """Every entity and every failure of all blocks."""
    e = _extracted(spark, sf_dir)
    row = lambda d, entity, name, value, confidence: d.select("page_id", "block_ord", F.lit(entity).alias("entity"), F.col(name).alias("name"), value.cast("double").alias("value"), confidence.cast("double").alias("confidence"))
    out = row(e.locations, "location", "name", F.col("latitude"), F.col("confidence"))
    out = out.unionByName(row(e.samples, "sample", "sample_id", F.get("assays", 0)["value"], F.col("confidence")))
    out = out.unionByName(row(e.observations, "observation", "feature_type", F.col("strike"), F.col("confidence")))
    return out.unionByName(row(e.failed, "failed", "error", F.col("asked"), F.lit(None)))


@register(
    "extracted_metadata",
    cte("ocr_block") + _READ + "select page_id as doc_id, arg_min(said, block_ord) as title from ok where kind = 'view' and x > 40 group by page_id",
)
def extracted_metadata(spark, sf_dir):
    return _extracted(spark, sf_dir).metadata.select("doc_id", F.col("metadata")["title"].alias("title"))


_ASSAY = """list_filter([case when coalesce({a}.element, '') = '' then 'no element' end,
 case when {a}.element not in ('', 'Au','Ag','Cu','Pb','Zn','Fe','c') then 'unknown element' end,
 case when {a}.value < 0 then 'negative value' end, case when {a}.value > 1000000 then 'value too large' end,
 case when {a}.unit not in ('ppm','ppb','ppt','%','wt%','g/t','mg/t','oz/t','lb/t','vol%') then 'unknown unit' end,
 case when {a}.detection_limit < 0 then 'negative detection limit' end, case when {a}.detection_limit > {a}.value then 'detection limit above value' end,
 case when not {a}.confidence between 0 and 1 then 'confidence out of range' end], lambda e: e is not null)"""


def _assays(spark, sf_dir):
    a = projection(spark, sf_dir, "geo_assay")
    return a.withColumn("element", F.when(F.col("ord") != 3, F.col("element")).otherwise("")).withColumn("confidence", F.col("ord") / 5.0)


@register(
    "validate_sample_assays",
    cte("geo_sample", "geo_assay")
    + f""", a as (select sample_id, ord, case when ord = 3 then '' else element end as element, value, unit, detection_limit, ord / 5.0::double as confidence from geo_assay),
n as (select sample_id, row_number() over (partition by sample_id order by ord, detection_limit nulls first, element, unit, value) - 1 as i, {_ASSAY.format(a="a")} as e from a),
m as (select sample_id, flatten(list(list_transform(e, lambda x: concat('Assay ', i, ': ', x)) order by i)) as e from n group by sample_id)
select s.sample_id, array_to_string(list_concat(list_filter([case when depth_from >= depth_to then 'from not above to' end, case when depth_from < 0 then 'negative from' end, case when depth_to < 0 then 'negative to' end],
 lambda x: x is not null), coalesce(m.e, []), list_filter([case when confidence not between 0 and 1 then 'confidence out of range' end], lambda x: x is not null)), '; ') as errors from geo_sample s left join m using (sample_id)""",
)
def validate_sample_assays(spark, sf_dir):
    """Faults of samples with those of their assays, of which some lack an element or have a confidence above 1."""
    d = exports.with_assays(projection(spark, sf_dir, "geo_sample"), _assays(spark, sf_dir).select("sample_id", "ord", "detection_limit", "element", "unit", "value", "confidence"))
    return d.select("sample_id", F.array_join(checks.sample_errors(F.col("assays")), "; ").alias("errors"))


@register(
    "validate_location_coordinates",
    cte("geo_location")
    + """, c as (select *, list_filter([case when latitude * 1.2 not between -90 and 90 then 'Coordinate 0: latitude out of range' end, case when elevation * 100 not between 0 and 1e6 then 'Coordinate 0: easting out of range' end,
 case when longitude * 1.1 not between -180 and 180 then 'Coordinate 1: longitude out of range' end, case when confidence * 1.5 > 1 then 'Coordinate 1: confidence out of range' end,
 case when elevation not between -1000 and 10000 then 'elevation out of range' end], lambda x: x is not null) as e from geo_location)
select location_id, array_to_string(e, '; ') as errors from c""",
)
def validate_location_coordinates(spark, sf_dir):
    """Faults of locations of two coordinates each."""
    none = F.lit(None).cast("double")
    one = F.struct((F.col("latitude") * 1.2).alias("latitude"), none.alias("longitude"), (F.col("elevation") * 100).alias("easting"), none.alias("northing"), F.lit(0.5).alias("confidence"))
    two = F.struct(none.alias("latitude"), (F.col("longitude") * 1.1).alias("longitude"), none.alias("easting"), none.alias("northing"), (F.col("confidence") * 1.5).alias("confidence"))
    d = projection(spark, sf_dir, "geo_location").withColumn("coordinates", F.array(one, two))
    return d.select("location_id", F.array_join(checks.location_errors(F.col("coordinates")), "; ").alias("errors"))


@register(
    "validation_report",
    cte("geo_location", "geo_sample")
    + """, l as (select count(*) as n, count(*) filter (elevation not between -1000 and 10000) as e from geo_location),
s as (select count(*) as n, sum((depth_from >= depth_to)::int + (depth_from < 0)::int + (depth_to < 0)::int)::bigint as e, count(*) filter (location_id is null) as unplaced,
 count(*) filter (location_id is null or location_id not in (select location_id from geo_location)) as orphans from geo_sample),
w as (select (unplaced > 0)::int + (orphans > 0)::int + (select sum((max_lat - min_lat > 0.1)::int + (max_lon - min_lon > 0.1)::int) from
 (select max(latitude) as max_lat, min(latitude) as min_lat, max(longitude) as max_lon, min(longitude) as min_lon from geo_location group by country having count(*) > 1)) as n from s)
select 'locations' as entity, n, e as errors, 0 as warnings, e = 0 as valid from l union all select 'samples', n, e, 0, e = 0 from s union all select 'cross_validation', 0, 0, n::bigint, null from w
union all select 'total', 0, l.e + s.e, w.n::bigint, null from l, s, w""",
)
def validation_report(spark, sf_dir):
    """The summary with the warnings across entities; places are countries."""
    l, s = projection(spark, sf_dir, "geo_location"), projection(spark, sf_dir, "geo_sample")
    places = l.select(F.col("country").alias("place"), "latitude", "longitude")
    return entities.report(l.withColumn("errors", checks.location_errors()), s.withColumn("errors", checks.sample_errors()), entities.cross_messages(s, l, places))
