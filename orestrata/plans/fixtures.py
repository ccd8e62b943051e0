"""Projections of the driver tables that stand in for extracted report data.

Each statement is plain SQL accepted unchanged by Spark and by the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orestrata.session import read_table

PROJECTIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "geo_location": (
        ("supplier", "nation", "region"),
        """select s_suppkey as location_id, cast(floor(s_suppkey / 3) as bigint) as doc_id, s_name as name,
  case s_suppkey % 6 when 0 then 'drill_hole' when 1 then 'sample_site' when 2 then 'mine'
       when 3 then 'claim' when 4 then 'prospect' else 'outcrop' end as location_type,
  cast((s_suppkey * 37) % 1800 as double) / 10 - 90 as latitude,
  cast((s_suppkey * 91) % 3600 as double) / 10 - 180 as longitude,
  cast((s_suppkey * 53) % 12000 as double) - 1500 as elevation,
  n_name as state_province, r_name as country,
  cast(s_suppkey % 11 as double) / 10 as confidence
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    "geo_sample": (
        ("orders",),
        """select concat('S', cast(o_orderkey as string)) as sample_id,
  case when o_orderkey % 97 = 0 then null else o_custkey % 120 end as location_id,
  case o_orderkey % 7 when 0 then 'core' when 1 then 'chip' when 2 then 'grab' when 3 then 'channel'
       when 4 then 'soil' when 5 then 'rock' else 'drill_cuttings' end as sample_type,
  cast(o_orderkey % 200 as double) / 2 - 1 as depth_from,
  cast(o_orderkey % 200 as double) / 2 - 1 + case when o_orderkey % 50 = 0 then -1 else 1.5 end as depth_to,
  cast(o_orderkey % 11 as double) / 10 as confidence
from orders""",
    ),
    "geo_assay": (
        ("lineitem",),
        """select concat('S', cast(l_orderkey as string)) as sample_id, l_linenumber as ord,
  case l_partkey % 8 when 0 then 'Au' when 1 then 'Ag' when 2 then 'Cu' when 3 then 'Pb' when 4 then 'Zn'
       when 5 then 'Fe' when 6 then 'Gold' else 'c' end as element,
  l_quantity * 25000 as value,
  case l_linenumber when 1 then 'ppm' when 2 then '%' when 3 then 'g/t' when 4 then 'oz/t'
       when 5 then 'ppb' when 6 then 'wt%' else 'mg/kg' end as unit,
  case when l_linenumber % 2 = 0 then l_extendedprice else null end as detection_limit
from lineitem""",
    ),
    "geo_observation": (
        ("part",),
        """select p_partkey as observation_id, p_partkey % 140 as location_id,
  case p_partkey % 10 when 0 then 'fault' when 1 then 'fold' when 2 then 'contact' when 3 then 'mineralization'
       when 4 then 'alteration' when 5 then 'vein' when 6 then 'dike' when 7 then 'sill'
       when 8 then 'unconformity' else 'bedding' end as feature_type,
  p_name as description, cast((p_partkey * 7) % 361 as double) as strike, cast(p_partkey % 91 as double) as dip
from part""",
    ),
    "ocr_block": (
        ("events",),
        """select user_id as page_id, event_id as block_ord, (event_id * 17) % 800 as x, (event_id * 29) % 1100 as y,
  40 + event_id % 60 as w, 12 + event_id % 9 as h, value / 500 as confidence,
  event_id % 23 as line_num, event_id % 3 as par_num,
  concat(event_type, ' ', cast(event_id % 90 as string), '.', cast(event_id % 97 as string),
         case when event_id % 4 = 0 then '°N' else '' end) as text
from events""",
    ),
    "page_block": (
        ("events",),
        """select user_id as page_id, row_number() over (partition by user_id order by event_id) - 1 as block_ord, (event_id * 17) % 800 as x, (event_id * 29) % 1100 as y,
  40 + event_id % 60 as w, 12 + event_id % 9 as h from events""",
    ),
    "page_pixel": (
        ("orders",),
        """select cast(floor(o_orderkey / 3000) as bigint) as page_id, cast(floor(o_orderkey % 3000 / 60) as int) as row_id, cast(o_orderkey % 60 as int) as col_id,
  (o_orderkey * 7919 + o_custkey * 104729) % 256 as v from orders""",
    ),
    "doc_sample": (
        ("orders",),
        """select cast(floor(o_custkey % 120 / 3) as bigint) as doc_id, o_custkey % 120 as location_id,
  concat('S', cast(row_number() over (partition by floor(o_custkey % 120 / 3) order by o_orderkey) as string)) as sample_id,
  case o_orderkey % 3 when 0 then 'core' when 1 then 'chip' else 'grab' end as sample_type, o_orderkey as order_key
from orders""",
    ),
    "doc_assay": (
        ("lineitem", "orders"),
        """select doc_id, sample_id, l_linenumber as ord,
  case l_partkey % 6 when 0 then 'Au' when 1 then 'Ag' when 2 then 'Cu' when 3 then 'Pb' when 4 then 'Zn' else 'Fe' end as element,
  l_quantity * 25000 as value, case l_linenumber % 3 when 1 then 'ppm' when 2 then '%' else 'g/t' end as unit
from lineitem join (select o_orderkey, cast(floor(o_custkey % 120 / 3) as bigint) as doc_id,
  concat('S', cast(row_number() over (partition by floor(o_custkey % 120 / 3) order by o_orderkey) as string)) as sample_id from orders) s on l_orderkey = o_orderkey""",
    ),
    "ocr_engine_page": (
        ("events",),
        """select user_id as page_id, case when event_type in ('view','click') then 'paddle' else 'tesseract' end as engine,
  avg(value) / 500 as confidence, case when count(*) < 3 then 'failed' else null end as error
from events group by 1, 2""",
    ),
    "ocr_line": (
        ("lineitem",),
        """select cast(floor(l_orderkey / 20) as bigint) as page_id, l_orderkey * 10 + l_linenumber as line_ord,
  case when l_linenumber % 2 = 0 then 'h' else 'v' end as orientation,
  (l_orderkey * 13) % 700 as x, (l_orderkey * 19 + l_linenumber * 40) % 1000 as y,
  case when l_linenumber % 2 = 0 then 60 + l_orderkey % 300 else 3 end as w,
  case when l_linenumber % 2 = 0 then 3 else 60 + l_orderkey % 300 end as h
from lineitem""",
    ),
    "coord_text": (
        ("customer",),
        """select c_custkey as text_id, case c_custkey % 7
  when 0 then concat(cast(c_custkey % 90 as string), '.', cast(c_custkey as string), '°N, ', cast(c_custkey % 180 as string), '.5°W')
  when 1 then concat(cast(c_custkey % 90 as string), '°', cast(c_custkey % 60 as string), chr(39), cast(c_custkey % 60 as string), '.2', chr(34), 'S, ',
                     cast(c_custkey % 180 as string), '°', cast(c_custkey % 60 as string), chr(39), '24.1', chr(34), 'E')
  when 2 then concat(cast(500000 + c_custkey * 7 as string), 'E, ', cast(5000000 + c_custkey * 11 as string), 'N (Zone ', cast(10 + c_custkey % 3 as string), 'N)')
  when 3 then concat('T', cast(c_custkey % 40 as string), 'N R', cast(c_custkey % 30 as string), 'W Section ', cast(c_custkey % 36 as string))
  when 4 then concat('-', cast(c_custkey % 120 as string), '.25, ', cast(c_custkey % 200 as string), '.75')
  when 5 then concat(cast(1000 + c_custkey as string), '.5E, ', cast(5000 + c_custkey as string), '.5N')
  else c_name end as source_text
from customer""",
    ),
    "date_text": (
        ("orders",),
        """select o_orderkey as text_id, case o_orderkey % 7
  when 0 then concat(cast(1950 + o_orderkey % 70 as string), '-', lpad(cast(1 + o_orderkey % 12 as string), 2, '0'), '-', lpad(cast(1 + o_orderkey % 28 as string), 2, '0'))
  when 1 then concat(lpad(cast(1 + o_orderkey % 12 as string), 2, '0'), '/', lpad(cast(1 + o_orderkey % 31 as string), 2, '0'), '/', cast(1950 + o_orderkey % 70 as string))
  when 2 then concat(lpad(cast(13 + o_orderkey % 16 as string), 2, '0'), '/', lpad(cast(1 + o_orderkey % 12 as string), 2, '0'), '/', cast(1950 + o_orderkey % 70 as string))
  when 3 then concat(cast(1950 + o_orderkey % 70 as string), '-', lpad(cast(1 + o_orderkey % 12 as string), 2, '0'), '-', lpad(cast(1 + o_orderkey % 28 as string), 2, '0'), 'T10:20:30')
  when 4 then cast(1950 + o_orderkey % 70 as string)
  when 5 then 'undated'
  else null end as date_text
from orders""",
    ),
    "dem_grid": (
        ("orders",),
        """select cast(floor(o_orderkey / 100) as int) as row_id, cast(o_orderkey % 100 as int) as col_id,
  1000 + 50 * sin(cast(floor(o_orderkey / 100) as double) / 9) + 30 * cos(cast(o_orderkey % 100 as double) / 7)
    + cast(o_orderkey % 13 as double) as z
from orders""",
    ),
    "dem_point": (
        ("supplier",),
        """select distinct cast((s_suppkey * 31) % 150 as int) as row_id, cast((s_suppkey * 17) % 100 as int) as col_id
from supplier where s_suppkey % 10 = 0""",
    ),
}


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection ``name`` over the tables in ``sf_dir``."""
    tables, sql = PROJECTIONS[name]
    for t in tables:
        sql = _qualify(sql, t)
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def _qualify(sql: str, table: str) -> str:
    """Name a table as a DataFrame argument, so that no temporary view is left behind."""
    import re

    return re.sub(rf"(?<=from |join ){table}\b", "{" + table + "}", sql)


def cte(*names: str) -> str:
    """A WITH clause that gives the oracle the same projections."""
    return "with " + ", ".join(f"{n} as ({PROJECTIONS[n][1]})" for n in names) + " "
