"""Queries over the terrain grid and over labelled predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orestrata.operators import forest, terrain
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection
from orestrata.session import checkpointed, read_table


def _grid(spark, sf_dir):
    return projection(spark, sf_dir, "dem_grid")


def _dist(spark, sf_dir):
    return terrain.nearest_distance(_grid(spark, sf_dir), projection(spark, sf_dir, "dem_point"))


_SOBEL = """, s1 as (select *, coalesce(lag(z) over c, z) + 2 * z + coalesce(lead(z) over c, z) as s, coalesce(lead(z) over c, z) - coalesce(lag(z) over c, z) as d
 from dem_grid window c as (partition by col_id order by row_id)),
s2 as (select row_id, col_id, coalesce(lead(s) over r, s) - coalesce(lag(s) over r, s) as gx, coalesce(lag(d) over r, d) + 2 * d + coalesce(lead(d) over r, d) as gy
 from s1 window r as (partition by row_id order by col_id))"""


@register(
    "slope_aspect",
    cte("dem_grid") + _SOBEL + "select row_id, col_id, round(degrees(atan(sqrt((gx / 240) * (gx / 240) + (gy / 240) * (gy / 240)))), 5) as slope_deg, round(fmod(degrees(atan2(gy / 240, -gx / 240)) + 360, 360), 5) as aspect_deg from s2",
)
def slope_aspect(spark, sf_dir):
    return terrain.slope_aspect(_grid(spark, sf_dir)).select("row_id", "col_id", F.round("slope_deg", 5).alias("slope_deg"), F.round("aspect_deg", 5).alias("aspect_deg"))


@register(
    "edge_density",
    cte("dem_grid") + _SOBEL + ", m as (select row_id, col_id, sqrt(gx * gx + gy * gy) as m from s2) select row_id, col_id, round((m - (select min(m) from m)) / ((select max(m) - min(m) from m) + 1e-9), 6) as edge_density from m",
)
def edge_density(spark, sf_dir):
    return terrain.edge_density(_grid(spark, sf_dir)).withColumn("edge_density", F.round("edge_density", 6))


_DIST = """, pt as (select p.* from dem_point p join dem_grid g on p.row_id = g.row_id and p.col_id = g.col_id),
dist as (select g.row_id, g.col_id, min(sqrt(((g.row_id - p.row_id) * (g.row_id - p.row_id) + (g.col_id - p.col_id) * (g.col_id - p.col_id))::double)) * 30 as dist_m
 from dem_grid g left join pt p on true group by g.row_id, g.col_id)"""


@register("nearest_distance", cte("dem_grid", "dem_point") + _DIST + "select row_id, col_id, round(dist_m, 6) as dist_m from dist")
def nearest_distance(spark, sf_dir):
    return _dist(spark, sf_dir).withColumn("dist_m", F.round("dist_m", 6))


@register(
    "labels",
    cte("dem_grid", "dem_point")
    + _DIST
    + """, far as (select row_id, col_id, row_number() over (order by md5(concat('42-', row_id::varchar, '-', col_id::varchar))) as r from dist where dist_m > 1000),
n as (select count(*) filter (dist_m <= 300) as n from dist)
select d.row_id, d.col_id, case when f.r <= n.n then 0 when dist_m <= 300 then 1 else -1 end::int as label from dist d cross join n left join far f on d.row_id = f.row_id and d.col_id = f.col_id""",
)
def labels(spark, sf_dir):
    return terrain.labels(checkpointed(_dist(spark, sf_dir)))


_BLOCKS = """, e as (select min(row_id) as r0, max(row_id) + 1 as r1, min(col_id) as c0, max(col_id) + 1 as c1 from dem_grid),
b as (select row_id, col_id, (least(len(list_filter(range(0, 6), lambda i: floor(r0 + i * ((r1 - r0)::double / 5)) <= row_id)) - 1, 4) * 5
  + least(len(list_filter(range(0, 6), lambda i: floor(c0 + i * ((c1 - c0)::double / 5)) <= col_id)) - 1, 4))::int as block_id from dem_grid cross join e)"""


@register("spatial_blocks", cte("dem_grid") + _BLOCKS + "select * from b")
def spatial_blocks(spark, sf_dir):
    return terrain.blocks(_grid(spark, sf_dir))


@register("spatial_folds", cte("dem_grid") + _BLOCKS + "select block_id, ntile(5) over (order by md5(concat('42-', block_id::varchar)))::int as fold from (select distinct block_id from b)")
def spatial_folds(spark, sf_dir):
    return terrain.folds(terrain.blocks(_grid(spark, sf_dir)))


@register("hotspots", cte("dem_grid") + "select row_id, col_id, z from dem_grid order by z desc, row_id desc, col_id desc limit 10")
def hotspots(spark, sf_dir):
    return terrain.hotspots(_grid(spark, sf_dir), 10, "z")


@register(
    "median_impute",
    cte("dem_grid")
    + ", x as (select row_id, col_id, case when (row_id + col_id) % 11 = 0 then null else z end as z from dem_grid) select row_id, col_id, round(coalesce(z, (select median(z) from x)), 6) as z from x",
)
def median_impute(spark, sf_dir):
    x = _grid(spark, sf_dir).withColumn("z", F.when((F.col("row_id") + F.col("col_id")) % 11 != 0, F.col("z")))
    return terrain.median_impute(x, "z").withColumn("z", F.round("z", 6))


@register(
    "cv_fold_rows",
    cte("dem_grid", "dem_point")
    + _BLOCKS
    + _DIST
    + """, f as (select block_id, ntile(5) over (order by md5(concat('42-', block_id::varchar))) as fold from (select distinct block_id from b)),
l as (select b.block_id, case when dist_m <= 300 then 1 when dist_m > 1000 then 0 end as label from b join dist on b.row_id = dist.row_id and b.col_id = dist.col_id)
select k.fold::int as fold, count(*) filter (f.fold <> k.fold) as n_train, count(*) filter (f.fold = k.fold) as n_test, count(*) filter (f.fold = k.fold and label = 1) as n_test_positive
from l join f on l.block_id = f.block_id cross join (select unnest(range(1, 6)) as fold) k where label is not null group by k.fold""",
)
def cv_fold_rows(spark, sf_dir):
    """Rows that a cross-validation by blocks trains and tests on."""
    blocked = terrain.blocks(_grid(spark, sf_dir))
    folds = terrain.folds(blocked)
    label = F.when(F.col("dist_m") <= 300, 1).when(F.col("dist_m") > 1000, 0)
    rows = blocked.join(_dist(spark, sf_dir).select("row_id", "col_id", label.alias("label")), ["row_id", "col_id"]).where("label is not null")
    out = None
    for k in range(1, 6):
        training, tested = forest.in_fold(rows, folds, k)
        n = training.agg(F.count("*").alias("n_train")).join(F.broadcast(tested.agg(F.count("*").alias("n_test"), F.count_if(F.col("label") == 1).alias("n_test_positive"))))
        one = n.select(F.lit(k).alias("fold"), "n_train", "n_test", "n_test_positive")
        out = one if out is None else out.unionByName(one)
    return out


def _labels(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")


@register("confusion", "select quality as truth, toxic as predicted, count(*) as n from labels where quality is not null and toxic is not null group by quality, toxic")
def confusion(spark, sf_dir):
    return terrain.confusion(_labels(spark, sf_dir), "quality", "toxic")


@register(
    "class_report",
    """with d as (select quality as t, toxic as p from labels where quality is not null and toxic is not null), k as (select distinct t as label from d union select distinct p from d),
r as (select label, (select count(*) from d where t = label and p = label) as hit, (select count(*) from d where p = label) as said, (select count(*) from d where t = label) as support from k),
s as (select label, coalesce(hit / nullif(said, 0)::double, 0) as precision, coalesce(hit / nullif(support, 0)::double, 0) as recall, support from r)
select label, round(precision, 9) as precision, round(recall, 9) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) as f1, support from s""",
)
def class_report(spark, sf_dir):
    d = terrain.class_report(_labels(spark, sf_dir), "quality", "toxic")
    return d.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def _features(spark, sf_dir):
    return terrain.feature_stack(_grid(spark, sf_dir), projection(spark, sf_dir, "dem_point"))


@register(
    "feature_stack",
    cte("dem_grid", "dem_point")
    + _SOBEL
    + _DIST
    + """, m as (select row_id, col_id, sqrt(gx * gx + gy * gy) as m, round(degrees(atan(sqrt((gx / 240) * (gx / 240) + (gy / 240) * (gy / 240)))), 5) as slope_deg from s2)
select m.row_id, m.col_id, slope_deg, round((m - (select min(m) from m)) / ((select max(m) - min(m) from m) + 1e-9), 6) as edge_density, round(dist_m, 6) as dist_m from m join dist d on m.row_id = d.row_id and m.col_id = d.col_id""",
)
def feature_stack(spark, sf_dir):
    d = _features(spark, sf_dir)
    return d.select("row_id", "col_id", F.round("slope_deg", 5).alias("slope_deg"), F.round("edge_density", 6).alias("edge_density"), F.round("dist_m", 6).alias("dist_m"))


@register("spatial_cv")
def spatial_cv(spark, sf_dir):
    """Reports of a cross-validation by blocks: five forests of 300 trees of depth 30.

    The rows are few bytes but much work, so they are dealt to all cores; their order is fixed, as a forest draws by it.
    """
    f = checkpointed(_features(spark, sf_dir))
    label = F.when(F.col("dist_m") <= 300, 1).when(F.col("dist_m") > 1000, 0)
    blocked = terrain.blocks(f)
    rows = f.withColumn("label", label).where("label is not null").join(blocked, ["row_id", "col_id"])
    rows = rows.repartition(max(24, spark.sparkContext.defaultParallelism), "row_id", "col_id").sortWithinPartitions("row_id", "col_id")
    return forest.spatial_cv(checkpointed(rows), terrain.folds(blocked))


@register("rf_grid_proba")
def rf_grid_proba(spark, sf_dir):
    """Probability of every pixel by a forest of 300 trees."""
    f = checkpointed(_features(spark, sf_dir))
    known = checkpointed(f.join(terrain.labels(f.select("row_id", "col_id", "dist_m")).where("label >= 0"), ["row_id", "col_id"]))
    return forest.score(forest.train(known), f, forest.COLUMNS)


@register("within_300", cte("dem_grid", "dem_point") + _DIST + "select row_id, col_id from dist where dist_m <= 300")
def within_300(spark, sf_dir):
    return _dist(spark, sf_dir).where("dist_m <= 300").select("row_id", "col_id")


@register("outside_1000", cte("dem_grid", "dem_point") + _DIST + "select row_id, col_id from dist where dist_m > 1000")
def outside_1000(spark, sf_dir):
    return _dist(spark, sf_dir).where("dist_m > 1000").select("row_id", "col_id")


@register(
    "resampled_grid",
    cte("dem_grid")
    + """, e as (select min(row_id) as r0, max(row_id) as r1, min(col_id) as c0, max(col_id) as c1 from dem_grid),
a as (select *, unnest(range(0, ceil((r1 - r0 + 1) / 1.5::double)::bigint)) as i from e), b as (select *, unnest(range(0, ceil((c1 - c0 + 1) / 1.5::double)::bigint)) as j from a),
t as (select i::int as row_id, j::int as col_id, r0 + (i + 0.5::double) * 1.5 - 0.5 as y, c0 + (j + 0.5::double) * 1.5 - 0.5 as x from b),
n as (select t.row_id, t.col_id, (1 - abs(y - g.row_id)) * (1 - abs(x - g.col_id)) as w, z from t left join dem_grid g
  on g.row_id in (floor(y)::int, floor(y)::int + 1) and g.col_id in (floor(x)::int, floor(x)::int + 1))
select row_id, col_id, round(sum(w * z) / sum(w), 6) as z from n group by row_id, col_id""",
)
def resampled_grid(spark, sf_dir):
    return terrain.resample(_grid(spark, sf_dir)).withColumn("z", F.round("z", 6))


@register("smote_rows")
def smote_rows(spark, sf_dir):
    """Labelled pixels, positives against all that lie far enough: two classes of different size. Pixels without a label have no part."""
    d = _features(spark, sf_dir)
    label = F.when(F.col("dist_m") <= 300, 1).when(F.col("dist_m") > 1000, 0)
    return forest.smote(d.withColumn("label", label).where("label is not null"))
