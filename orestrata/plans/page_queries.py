"""Queries over page images as pixels, and over the terrain grid on other frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orestrata.operators import runs, tiles, warp
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection


def _pixels(spark, sf_dir):
    return projection(spark, sf_dir, "page_pixel")


def _sizes(spark, sf_dir):
    return _pixels(spark, sf_dir).groupBy("page_id").agg((F.max("row_id") + 1).alias("height"), (F.max("col_id") + 1).alias("width"))


_WEIGHTS = ", ".join(f"({i - 5}, {w!r}::double)" for i, w in enumerate(map(float, tiles.gaussian(11))))


@register(
    "page_threshold",
    cte("page_pixel")
    + f""", w as (select * from (values {_WEIGHTS}) t(o, w)), e as (select page_id, max(row_id) as r1, max(col_id) as c1 from page_pixel group by page_id),
h as (select p.page_id, p.row_id, p.col_id, any_value(p.v) as v, any_value(e.r1) as r1, sum(w.w * q.v) as s from page_pixel p join e on p.page_id = e.page_id cross join w
 join page_pixel q on q.page_id = p.page_id and q.row_id = p.row_id and q.col_id = greatest(0, least(e.c1, p.col_id + w.o)) group by p.page_id, p.row_id, p.col_id),
m as (select p.page_id, p.row_id, p.col_id, any_value(p.v) as v, round_even(sum(w.w * q.s), 0) as mean from h p cross join w
 join h q on q.page_id = p.page_id and q.col_id = p.col_id and q.row_id = greatest(0, least(p.r1, p.row_id + w.o)) group by p.page_id, p.row_id, p.col_id),
i as (select page_id, row_id, col_id, case when v - mean > -2 then 255 else 0 end as ink from m)
select page_id, row_id, col_id, (case when avg(ink) over (partition by page_id) > 127 then 255 - ink else ink end)::bigint as ink from i""",
)
def page_threshold(spark, sf_dir):
    return tiles.thresholded(_pixels(spark, sf_dir), side=64)


_CROSS = "(values (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) o(dr, dc)"


def _under(source: str, of: str) -> str:
    return f"""select p.page_id, p.row_id, p.col_id, {of}(q.v) as v from {source} p cross join {_CROSS} join {source} q on q.page_id = p.page_id and q.row_id = p.row_id + dr and q.col_id = p.col_id + dc
 group by p.page_id, p.row_id, p.col_id"""


@register("page_opening", cte("page_pixel") + f", a as ({_under('page_pixel', 'min')}), b as ({_under('a', 'max')}) select * from b")
def page_opening(spark, sf_dir):
    return tiles.opened(_pixels(spark, sf_dir), tiles.SPOT3, side=64)


@register("page_closing", cte("page_pixel") + f", a as ({_under('page_pixel', 'max')}), b as ({_under('a', 'min')}) select * from b")
def page_closing(spark, sf_dir):
    return tiles.closed(_pixels(spark, sf_dir), tiles.SPOT3, side=64)


_RUNS = """, i as (select *, col_id - row_number() over (partition by page_id, row_id order by col_id) as island from page_pixel where v >= {least}),
r as (select page_id, row_id, min(col_id) as x0, max(col_id) as x1 from i group by page_id, row_id, island)"""


@register("page_runs", cte("page_pixel") + _RUNS.format(least=80) + "select * from r where x1 - x0 + 1 >= 7 or (x0 = 0 and x1 = 59) or ((x0 = 0 or x1 = 59) and x1 - x0 + 1 > 3)")
def page_runs(spark, sf_dir):
    """Runs that an opening by a line of seven pixels leaves."""
    return runs.long_runs(runs.ink_runs(_pixels(spark, sf_dir), 80), _sizes(spark, sf_dir), 7).drop("run")


@register(
    "page_shapes",
    "with recursive "
    + cte("page_pixel").removeprefix("with ")
    + _RUNS.format(least=200)
    + """, n as (select *, row_number() over (order by page_id, row_id, x0) as run from r),
t as (select a.run, b.run as other from n a join n b on a.page_id = b.page_id and abs(a.row_id - b.row_id) = 1 and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1),
c as (select run, run as other from n union select c.run, t.other from c join t on c.other = t.run),
s as (select run, min(other) as shape from c group by run)
select any_value(page_id) as page_id, min(x0) as x, min(row_id) as y, max(x1) - min(x0) + 1 as w, max(row_id) - min(row_id) + 1 as h, sum(x1 - x0 + 1)::bigint as pixels from n join s using (run) group by shape""",
)
def page_shapes(spark, sf_dir):
    """Boxes of connected shapes."""
    r = runs.ink_runs(_pixels(spark, sf_dir), 200)
    d = r.join(runs.shapes(r), "run").groupBy("page_id", "shape")
    d = d.agg(F.min("x0").alias("x"), F.min("row_id").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("row_id") - F.min("row_id") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
    return d.drop("shape")


@register("page_outer_boxes")
def page_outer_boxes(spark, sf_dir):
    """Boxes of shapes that lie in no other shape's hole."""
    return runs.outer_boxes(runs.ink_runs(_pixels(spark, sf_dir), 150), _sizes(spark, sf_dir))


@register("page_angles")
def page_angles(spark, sf_dir):
    return runs.page_angles(runs.ink_runs(_pixels(spark, sf_dir), 250)).withColumn("angle", F.round("angle", 6))


_TURN = math.radians(30)
_FRAME, _TO = warp.Frame(30.0, 0.0, 0.0, 0.0, -30.0, 0.0), warp.Frame(45 * math.cos(_TURN), -45 * math.sin(_TURN), 900.0, -45 * math.sin(_TURN), -45 * math.cos(_TURN), 300.0)


@register(
    "turned_grid",
    cte("dem_grid")
    + f""", t as (select r::int as row_id, c::int as col_id, -(({_TO.d!r}::double * (c + 0.5) + {_TO.e!r}::double * (r + 0.5) + {_TO.f!r}::double) / 30) - 0.5 as y,
 ({_TO.a!r}::double * (c + 0.5) + {_TO.b!r}::double * (r + 0.5) + {_TO.c!r}::double) / 30 - 0.5 as x from range(120) rs(r) cross join range(90) cs(c)),
n as (select t.row_id, t.col_id, (1 - abs(y - g.row_id)) * (1 - abs(x - g.col_id)) as w, z from t join dem_grid g on g.row_id in (floor(y)::int, floor(y)::int + 1) and g.col_id in (floor(x)::int, floor(x)::int + 1))
select row_id, col_id, round(sum(w * z) / sum(w), 5) as z from n group by row_id, col_id having sum(w) > 0""",
)
def turned_grid(spark, sf_dir):
    """The grid in pixels of another size, turned by 30 degrees."""
    return warp.warped(projection(spark, sf_dir, "dem_grid"), _FRAME, _TO, 120, 90, side=64).withColumn("z", F.round("z", 5))
