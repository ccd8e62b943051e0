"""Queries over extracted report entities."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from orestrata.functions import checks
from orestrata.operators import entities, exports
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection


@register(
    "locations_by_type",
    cte("geo_location")
    + """select location_type, count(*) as n, min(latitude) as min_lat, max(latitude) as max_lat,
  min(longitude) as min_lon, max(longitude) as max_lon
from geo_location group by location_type""",
)
def locations_by_type(spark, sf_dir):
    return (
        projection(spark, sf_dir, "geo_location")
        .groupBy("location_type")
        .agg(
            F.count("*").alias("n"),
            F.min("latitude").alias("min_lat"),
            F.max("latitude").alias("max_lat"),
            F.min("longitude").alias("min_lon"),
            F.max("longitude").alias("max_lon"),
        )
    )


def _p(name):
    return lambda spark, sf_dir: projection(spark, sf_dir, name)


location, sample, assay, observation = (_p(f"geo_{x}") for x in ("location", "sample", "assay", "observation"))


@register("samples_at_location", cte("geo_sample") + "select sample_id, sample_type from geo_sample where location_id = 7")
def samples_at_location(spark, sf_dir):
    return sample(spark, sf_dir).where("location_id = 7").select("sample_id", "sample_type")


@register("observations_by_type", cte("geo_observation") + "select observation_id, description from geo_observation where feature_type = 'fault'")
def observations_by_type(spark, sf_dir):
    return observation(spark, sf_dir).where("feature_type = 'fault'").select("observation_id", "description")


@register("with_assays", cte("geo_assay") + "select sample_id, count(*) as assay_count from geo_assay group by sample_id")
def with_assays(spark, sf_dir):
    return entities.assay_counts(assay(spark, sf_dir))


@register(
    "sample_features_inner",
    cte("geo_sample", "geo_location") + "select sample_id, s.location_id, sample_type, longitude, latitude from geo_sample s join geo_location l on s.location_id = l.location_id",
)
def sample_features_inner(spark, sf_dir):
    return entities.sample_features(sample(spark, sf_dir), location(spark, sf_dir)).select("sample_id", "location_id", "sample_type", "longitude", "latitude")


_LAYER = "coalesce(longitude, 0.0::double) as longitude, coalesce(latitude, 0.0::double) as latitude"


@register(
    "sample_layer_left",
    cte("geo_sample", "geo_location", "geo_assay")
    + f"""select s.sample_id, {_LAYER}, coalesce(n, 0) as assay_count from geo_sample s left join geo_location l on s.location_id = l.location_id
left join (select sample_id, count(*) as n from geo_assay group by sample_id) a on s.sample_id = a.sample_id""",
)
def sample_layer_left(spark, sf_dir):
    d = entities.layer(sample(spark, sf_dir), location(spark, sf_dir)).join(entities.assay_counts(assay(spark, sf_dir)), "sample_id", "left")
    return d.select("sample_id", "longitude", "latitude", F.coalesce("assay_count", F.lit(0)).alias("assay_count"))


@register(
    "obs_layer_left",
    cte("geo_observation", "geo_location") + f"select observation_id, feature_type, {_LAYER} from geo_observation o left join geo_location l on o.location_id = l.location_id",
)
def obs_layer_left(spark, sf_dir):
    return entities.layer(observation(spark, sf_dir), location(spark, sf_dir)).select("observation_id", "feature_type", "longitude", "latitude")


@register(
    "location_nested_samples",
    cte("geo_sample", "geo_location")
    + """select l.location_id, count(s.sample_id) as n_samples, coalesce(string_agg(s.sample_id, ',' order by s.sample_id), '') as samples
from geo_location l left join geo_sample s on s.location_id = l.location_id group by l.location_id""",
)
def location_nested_samples(spark, sf_dir):
    d = entities.nested_samples(sample(spark, sf_dir), location(spark, sf_dir))
    return d.select("location_id", F.size("samples").cast("long").alias("n_samples"), F.array_join("samples", ",").alias("samples"))


@register(
    "orphan_samples",
    cte("geo_sample", "geo_location")
    + "select sample_id, location_id from geo_sample s where not exists (select 1 from geo_location l where l.location_id = s.location_id)",
)
def orphan_samples(spark, sf_dir):
    return entities.orphans(sample(spark, sf_dir), location(spark, sf_dir)).select("sample_id", "location_id")


@register(
    "link_first_match",
    cte("geo_sample", "geo_location")
    + """, s as (select sample_id, cast(floor(location_id / 3) as bigint) as doc_id, concat(repeat('-', (coalesce(location_id, 0) % 150)::int), coalesce(sample_type, ''), ' Supplier#', coalesce(location_id, 0)::varchar) as t from geo_sample),
l as (select location_id, doc_id, name, concat(name, ' ', location_type) as t from geo_location),
m as (select s.sample_id, min(l.location_id) as linked_id from s join l on s.doc_id = l.doc_id and abs(strpos(s.t, l.name) - strpos(l.t, s.sample_id)) < 100 group by s.sample_id)
select s.sample_id, linked_id from s left join m on s.sample_id = m.sample_id""",
)
def link_first_match(spark, sf_dir):
    at = F.coalesce("location_id", F.lit(0))
    text = F.concat(F.repeat(F.lit("-"), (at % 150).cast("int")), F.coalesce("sample_type", F.lit("")), F.lit(" Supplier#"), at.cast("string"))
    s = sample(spark, sf_dir).select("sample_id", F.floor(F.col("location_id") / 3).alias("doc_id"), text.alias("source_text"))
    l = location(spark, sf_dir).withColumn("source_text", F.concat("name", F.lit(" "), "location_type"))
    return entities.link_first(s, l).select("sample_id", "linked_id")


@register(
    "link_first_by_document",
    cte("doc_sample", "geo_location")
    + """, s as (select *, concat(repeat('-', (location_id % 150)::int), sample_type, ' Supplier#', location_id::varchar) as t from doc_sample),
l as (select location_id, doc_id, name, concat(name, ' ', location_type) as t from geo_location),
m as (select s.doc_id, s.sample_id, min(l.location_id) as linked_id from s join l on s.doc_id = l.doc_id and abs(strpos(s.t, l.name) - strpos(l.t, s.sample_id)) < 100 group by all)
select s.doc_id, s.sample_id, linked_id from s left join m on s.doc_id = m.doc_id and s.sample_id = m.sample_id""",
)
def link_first_by_document(spark, sf_dir):
    """Samples whose numbers start anew in every document."""
    text = F.concat(F.repeat(F.lit("-"), (F.col("location_id") % 150).cast("int")), F.col("sample_type"), F.lit(" Supplier#"), F.col("location_id").cast("string"))
    s = projection(spark, sf_dir, "doc_sample").select("doc_id", "sample_id", text.alias("source_text"))
    l = location(spark, sf_dir).withColumn("source_text", F.concat("name", F.lit(" "), "location_type"))
    return entities.link_first(s, l).select("doc_id", "sample_id", "linked_id")


@register(
    "assays_by_document",
    cte("doc_sample", "doc_assay")
    + """select s.doc_id, s.sample_id, count(a.ord) as assay_count, coalesce(string_agg(element, ',' order by ord, element, value), '') as elements
from doc_sample s left join doc_assay a on s.doc_id = a.doc_id and s.sample_id = a.sample_id group by s.doc_id, s.sample_id""",
)
def assays_by_document(spark, sf_dir):
    """Assays nested in samples whose numbers start anew in every document."""
    d = exports.with_assays(projection(spark, sf_dir, "doc_sample"), projection(spark, sf_dir, "doc_assay"))
    return d.select("doc_id", "sample_id", F.size("assays").cast("long").alias("assay_count"), F.array_join(F.col("assays.element"), ",").alias("elements"))


_ASSAY = """array_to_string(list_filter([
 case when element not in ('Au','Ag','Cu','Pb','Zn','Fe') and element not in ('c') then 'unknown element' end,
 case when value < 0 then 'negative value' end, case when value > 1000000 then 'value too large' end,
 case when unit not in ('ppm','ppb','ppt','%','wt%','g/t','mg/t','oz/t','lb/t','vol%') then 'unknown unit' end,
 case when detection_limit < 0 then 'negative detection limit' end,
 case when detection_limit > value then 'detection limit above value' end], lambda x: x is not null), '; ')"""
_SAMPLE = """list_filter([case when coalesce(sample_id, '') = '' then 'no id' end, case when depth_from >= depth_to then 'from not above to' end,
 case when depth_from < 0 then 'negative from' end, case when depth_to < 0 then 'negative to' end,
 case when confidence not between 0 and 1 then 'confidence out of range' end], lambda x: x is not null)"""
_LOCATION = """list_filter([case when location_type not in ('drill_hole','sample_site','mine','claim','prospect','outcrop') then 'unknown type' end,
 case when latitude not between -90 and 90 then 'latitude out of range' end, case when longitude not between -180 and 180 then 'longitude out of range' end,
 case when elevation not between -1000 and 10000 then 'elevation out of range' end,
 case when confidence not between 0 and 1 then 'confidence out of range' end], lambda x: x is not null)"""


@register("validate_assay", cte("geo_assay") + f"select {_ASSAY} as errors, count(*) as n from geo_assay group by 1")
def validate_assay(spark, sf_dir):
    return assay(spark, sf_dir).groupBy(F.array_join(checks.assay_errors(), "; ").alias("errors")).agg(F.count("*").alias("n"))


@register("validate_sample", cte("geo_sample") + f"select sample_id, array_to_string({_SAMPLE}, '; ') as errors from geo_sample")
def validate_sample(spark, sf_dir):
    return sample(spark, sf_dir).select("sample_id", F.array_join(checks.sample_errors(), "; ").alias("errors"))


@register("validate_location", cte("geo_location") + f"select location_id, array_to_string({_LOCATION}, '; ') as errors from geo_location")
def validate_location(spark, sf_dir):
    return location(spark, sf_dir).select("location_id", F.array_join(checks.location_errors(), "; ").alias("errors"))


@register(
    "validation_summary",
    cte("geo_location", "geo_sample")
    + f"""select 'location' as entity, count(*) as n, count(*) filter (len(e) = 0) as n_valid, sum(len(e))::bigint as n_errors from (select {_LOCATION} as e from geo_location)
union all select 'sample', count(*), count(*) filter (len(e) = 0), sum(len(e))::bigint from (select {_SAMPLE} as e from geo_sample)""",
)
def validation_summary(spark, sf_dir):
    return entities.summary(location(spark, sf_dir).withColumn("errors", checks.location_errors()), sample(spark, sf_dir).withColumn("errors", checks.sample_errors()))


_ELEMENTS = ["Au", "Ag", "Cu", "Pb", "Zn", "Fe"]


@register(
    "pivot_elements",
    cte("geo_assay") + "select sample_id, " + ", ".join(f"round(coalesce(avg(value) filter (element = '{e}'), 0), 4) as {e.lower()}" for e in _ELEMENTS) + " from geo_assay group by sample_id",
)
def pivot_elements(spark, sf_dir):
    return entities.pivot_elements(assay(spark, sf_dir), _ELEMENTS).select("sample_id", *[F.round(e, 4).alias(e.lower()) for e in _ELEMENTS])


@register(
    "element_corr",
    cte("geo_assay")
    + ", w as (select sample_id, "
    + ", ".join(f"coalesce(avg(value) filter (element = '{e}'), 0) as {e}" for e in _ELEMENTS)
    + " from geo_assay group by sample_id) select "
    + ", ".join(f"round(corr({a}, {b}), 6) as {a.lower()}_{b.lower()}" for a, b in combinations(_ELEMENTS, 2))
    + " from w",
)
def element_corr(spark, sf_dir):
    w = entities.pivot_elements(assay(spark, sf_dir), _ELEMENTS)
    return w.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}_{b}".lower()) for a, b in combinations(_ELEMENTS, 2)])


@register(
    "combined_union",
    cte("geo_location", "geo_sample", "geo_assay", "geo_observation")
    + """select record_type, count(*) as n, count(confidence) as with_confidence, count(element) as with_element from (
select 'location' as record_type, confidence, null as element from geo_location union all select 'sample', confidence, null from geo_sample
union all select 'assay', null, element from geo_assay union all select 'observation', null, null from geo_observation) group by record_type""",
)
def combined_union(spark, sf_dir):
    d = entities.combined(location(spark, sf_dir), sample(spark, sf_dir), assay(spark, sf_dir), observation(spark, sf_dir))
    return d.groupBy("record_type").agg(F.count("*").alias("n"), F.count("confidence").alias("with_confidence"), F.count("element").alias("with_element"))


@register("bbox_clip", cte("geo_location") + "select location_id, longitude, latitude from geo_location where longitude between -116.6 and 15.9 and latitude between -35.3 and 35.8")
def bbox_clip(spark, sf_dir):
    return location(spark, sf_dir).where(F.col("longitude").between(-116.6, 15.9) & F.col("latitude").between(-35.3, 35.8)).select("location_id", "longitude", "latitude")


@register("geojson_counts", cte("geo_location") + "select doc_id, count(*)::int as n_features from geo_location group by doc_id")
def geojson_counts(spark, sf_dir):
    d = entities.geojson(location(spark, sf_dir))
    return d.select("doc_id", F.size(F.from_json("geojson", "features array<struct<type:string>>")["features"]).alias("n_features"))


@register("geojson_doc")
def geojson_doc(spark, sf_dir):
    return entities.geojson(location(spark, sf_dir))


@register("jsonld_doc")
def jsonld_doc(spark, sf_dir):
    return entities.jsonld(location(spark, sf_dir))


@register(
    "metadata_kv",
    cte("geo_location")
    + """, m as (select doc_id, count(*) as n_locations, count(distinct location_type) as n_types, min(country) as country from geo_location group by doc_id)
select doc_id, 'n_locations' as field, n_locations::varchar as value from m union all select doc_id, 'n_types', n_types::varchar from m union all select doc_id, 'country', coalesce(country, '') from m""",
)
def metadata_kv(spark, sf_dir):
    m = location(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_locations"), F.countDistinct("location_type").alias("n_types"), F.min("country").alias("country"))
    return entities.key_values(m, "doc_id")


_SPREAD = "select '{0}', country from geo_location group by country having count(*) > 1 and max({0}) - min({0}) > 0.1"


@register(
    "cross_validate",
    cte("geo_location", "geo_sample")
    + "select 'orphan' as warning, sample_id as subject from geo_sample s where not exists (select 1 from geo_location l where l.location_id = s.location_id) union all "
    + _SPREAD.format("latitude")
    + " union all "
    + _SPREAD.format("longitude"),
)
def cross_validate(spark, sf_dir):
    l = location(spark, sf_dir)
    return entities.cross_warnings(sample(spark, sf_dir), l, l.select(F.col("country").alias("place"), "latitude", "longitude"))
