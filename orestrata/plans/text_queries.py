"""Queries over text: coordinates, suspicious characters, terms and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from orestrata.functions import checks, coords, dates
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection
from orestrata.session import read_table


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _g(pattern: str, group: int) -> str:
    return f"regexp_extract(t, {_q(pattern)}, {group})"


def _n(pattern: str, group: int) -> str:
    return f"try_cast({_g(pattern, group)} as double)"


_OK = "{0} between -90 and 90 and {1} between -180 and 180"
_PARSED = f"""
, x as (select text_id, trim(source_text) as t from coord_text),
c as (select *,
  case when upper({_g(coords.DECIMAL_DEGREES, 2)}) = 'N' then {_n(coords.DECIMAL_DEGREES, 1)} else -{_n(coords.DECIMAL_DEGREES, 1)} end as a_lat,
  case when upper({_g(coords.DECIMAL_DEGREES, 4)}) = 'E' then {_n(coords.DECIMAL_DEGREES, 3)} else -{_n(coords.DECIMAL_DEGREES, 3)} end as a_lon,
  ({_n(coords.DMS, 1)} + {_n(coords.DMS, 2)} / 60 + {_n(coords.DMS, 3)} / 3600) * case when upper({_g(coords.DMS, 4)}) in ('S', 'W') then -1 else 1 end as b_lat,
  ({_n(coords.DMS, 5)} + {_n(coords.DMS, 6)} / 60 + {_n(coords.DMS, 7)} / 3600) * case when upper({_g(coords.DMS, 8)}) in ('S', 'W') then -1 else 1 end as b_lon,
  {_n(coords.DECIMAL_SIMPLE, 1)} as e_lat, {_n(coords.DECIMAL_SIMPLE, 2)} as e_lon from x),
k as (select *, case when {_OK.format("a_lat", "a_lon")} then 'decimal_degrees' when {_OK.format("b_lat", "b_lon")} then 'dms'
  when regexp_matches(t, {_q(coords.UTM)}) then 'utm' when regexp_matches(t, {_q(coords.TOWNSHIP_RANGE)}) then 'township_range'
  when {_OK.format("e_lat", "e_lon")} then 'decimal_simple' when regexp_matches(t, {_q(coords.STATE_PLANE)}) then 'state_plane' end as kind from c)
"""


@register(
    "coord_parse_ordered",
    cte("coord_text")
    + _PARSED
    + f"""select text_id, kind, round(case kind when 'decimal_degrees' then a_lat when 'dms' then b_lat when 'decimal_simple' then e_lat end, 6) as latitude,
  round(case kind when 'decimal_degrees' then a_lon when 'dms' then b_lon when 'decimal_simple' then e_lon end, 6) as longitude,
  case kind when 'utm' then {_n(coords.UTM, 1)} when 'state_plane' then {_n(coords.STATE_PLANE, 1)} end as easting,
  case kind when 'utm' then {_n(coords.UTM, 2)} when 'state_plane' then {_n(coords.STATE_PLANE, 2)} end as northing,
  case when kind = 'utm' then nullif({_g(coords.UTM_ZONE, 1)}, '') end as utm_zone,
  case when kind = 'township_range' then {_g(coords.TOWNSHIP_RANGE, 3)} end as section from k""",
)
def coord_parse_ordered(spark, sf_dir):
    d = projection(spark, sf_dir, "coord_text").withColumn("c", coords.parse(F.col("source_text")))
    return d.select("text_id", "c.kind", F.round("c.latitude", 6).alias("latitude"), F.round("c.longitude", 6).alias("longitude"), "c.easting", "c.northing", "c.utm_zone", "c.section")


@register(
    "coord_sentences",
    cte("coord_text") + "select text_id, count(*) as n_sentences from (select text_id, unnest(string_split_regex(source_text, '[.!?]')) as s from coord_text) where trim(s) <> '' group by text_id",
)
def coord_sentences(spark, sf_dir):
    d = projection(spark, sf_dir, "coord_text").select("text_id", F.explode(F.split("source_text", "[.!?]")).alias("s"))
    return d.where(F.trim("s") != "").groupBy("text_id").agg(F.count("*").alias("n_sentences"))


@register("sentence_coordinates")
def sentence_coordinates(spark, sf_dir):
    """At most one coordinate per sentence; the split leaves decimals whole."""
    d = projection(spark, sf_dir, "coord_text").select("text_id", F.posexplode(F.split("source_text", r"[.!?](?!\d)")).alias("sentence", "s"))
    return d.withColumn("c", coords.parse(F.col("s"))).where(F.col("c").isNotNull()).select("text_id", "sentence", "c.kind", "c.latitude", "c.longitude")


@register(
    "utm_round_trip",
    cte("coord_text") + _PARSED + f"select text_id, {_n(coords.UTM, 1)} as easting, {_n(coords.UTM, 2)} as northing from k where kind = 'utm' and regexp_matches(t, {_q(coords.UTM_ZONE)})",
)
def utm_round_trip(spark, sf_dir):
    """Through latitude and longitude and back: what comes out is what was read."""
    d = projection(spark, sf_dir, "coord_text").withColumn("c", coords.parse(F.col("source_text"))).where((F.col("c.kind") == "utm") & F.col("c.utm_zone").isNotNull())
    zone = F.regexp_extract("c.utm_zone", r"(\d+)", 1).cast("int")
    lat, lon = coords.utm_to_latlon(F.col("c.easting"), F.col("c.northing"), zone, F.upper("c.utm_zone").endswith("N"))
    d = d.select("text_id", zone.alias("zone"), lat.alias("lat"), lon.alias("lon"))
    e, n = coords.latlon_to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    return d.select("text_id", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@register(
    "ocr_suspects",
    "select doc_id, ("
    + " + ".join(f"(contains(text, '{a}') and contains(text, '{b}'))::int" for a, b in checks.CONFUSED)
    + r" + len(list_filter(regexp_extract_all(text, '\d+\.?\d*'), lambda x: x::double > 1000000)))::int as n_suspects from documents",
)
def ocr_suspects(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", checks.ocr_suspects(F.col("text")).alias("n_suspects"))


@register("geo_terms", "select doc_id, (" + " + ".join(f"contains(lower(text), '{w}')::int" for w in checks.TERMS) + ")::int as n_terms from documents")
def geo_terms(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", checks.terms_found(F.col("text")).alias("n_terms"))


@register("keyword_filter", f"select doc_id from documents where regexp_matches(lower(coalesce(text, 'nan')), {_q('|'.join(checks.RARE_EARTH))})")
def keyword_filter(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where(checks.rare_earth(F.col("text"))).select("doc_id")


@register("coord_blocks", cte("ocr_block") + f"select block_ord, text from ocr_block where regexp_matches(text, {_q(coords.COORDINATE_BLOCK)})")
def coord_blocks(spark, sf_dir):
    return projection(spark, sf_dir, "ocr_block").where(F.col("text").rlike(coords.COORDINATE_BLOCK)).select("block_ord", "text")


def _dates(*formats: str) -> str:
    tries = ", ".join(f"try_strptime(date_text, '{f}')" for f in formats)
    return cte("date_text") + f"select text_id, strftime(coalesce({tries}), '%Y-%m-%d %H:%M:%S') as parsed from date_text"


@register("date_parse", _dates("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"))
def date_parse(spark, sf_dir):
    return projection(spark, sf_dir, "date_text").select("text_id", F.date_format(dates.sample_date(F.col("date_text")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("report_dates", _dates("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y"))
def report_dates(spark, sf_dir):
    return projection(spark, sf_dir, "date_text").select("text_id", F.date_format(dates.report_date(F.col("date_text")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))
