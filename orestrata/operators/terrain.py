"""Terrain grids (``row_id, col_id, z``): slope, edges, distances, labels, blocks, sampling and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orestrata.operators import tiles
from orestrata.operators.selection import median


def sobel(grid: DataFrame) -> DataFrame:
    """``gx`` and ``gy`` by the 3 x 3 stencil, edges reflected, on tiles with a halo of a pixel."""
    d = grid.select("row_id", "col_id", F.col("z").cast("double").alias("z"))
    return tiles.on_tiles(d, tiles.sobel_kernel, 1, ["z"], "gx double, gy double")


def slope_aspect(grid: DataFrame, pixel: float = 30.0) -> DataFrame:
    dx, dy = F.col("gx") / (8 * pixel), F.col("gy") / (8 * pixel)
    return sobel(grid).select(
        "row_id", "col_id", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope_deg"), F.pmod(F.degrees(F.atan2(dy, -dx)) + 360, F.lit(360.0)).alias("aspect_deg")
    )


def edge_density(grid: DataFrame) -> DataFrame:
    """Gradient magnitude scaled to 0..1 by the least and greatest of the grid, which are one row."""
    d = sobel(grid).withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    ends = d.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return d.crossJoin(F.broadcast(ends)).select("row_id", "col_id", ((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("edge_density"))


def nearest_distance(grid: DataFrame, points: DataFrame, pixel: float = 30.0) -> DataFrame:
    """Distance of each pixel to the nearest point pixel; null if no point lies on the grid.

    Exact and separable: along columns, then along rows by the lower envelope of parabolas (:func:`tiles.squared_distances`).
    """
    return tiles.squared_distances(grid, points).select("row_id", "col_id", (F.sqrt(F.col("d2").cast("double")) * pixel).alias("dist_m"))


def feature_stack(grid: DataFrame, points: DataFrame | None = None, pixel: float = 30.0) -> DataFrame:
    """``row_id, col_id``, slope, aspect, edge density and, if there are ``points``, the distance to the nearest, of every pixel."""
    d = slope_aspect(grid, pixel).join(edge_density(grid), ["row_id", "col_id"])
    return d if points is None else d.join(nearest_distance(grid, points, pixel), ["row_id", "col_id"])


def labels(distances: DataFrame, inside: float = 300.0, outside: float = 1000.0, seed: int = 42) -> DataFrame:
    """1 within ``inside``, 0 for as many pixels beyond ``outside`` (in md5 order of seed and place), else -1."""
    d = distances.withColumn("_pos", F.col("dist_m") <= inside).withColumn("_far", F.col("dist_m") > outside)
    n = d.agg(F.count_if("_pos").alias("_n"), F.count_if("_far").alias("_all"))
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("row_id").cast("string"), F.col("col_id").cast("string")))
    far = d.where("_far").withColumn("_h", order)
    # Ranks by the leading digits first, as many as keep a part to a few thousand candidates, so that no single task sorts them all.
    digits = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.log(16.0, (F.col("_all") + 1) / 4096.0)))).cast("int")
    parts = far.crossJoin(F.broadcast(n.select(digits.alias("_digits")))).withColumn("_b", F.substring(F.col("_h"), F.lit(1), F.col("_digits"))).drop("_digits")
    before = parts.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h"))).join(before, "_b")
    chosen = ranked.crossJoin(F.broadcast(n.select("_n"))).where(F.col("_r") + F.col("_before") <= F.col("_n")).select("row_id", "col_id", F.lit(True).alias("_neg"))
    label = F.when(F.col("_neg"), 0).when(F.col("_pos"), 1).otherwise(-1)
    return d.join(chosen, ["row_id", "col_id"], "left").select("row_id", "col_id", label.alias("label"))


def blocks(grid: DataFrame, k: int = 5) -> DataFrame:
    """Each pixel's block: k x k cells between the grid's ends; the ends are one row."""
    e = grid.agg(*[f(c).alias(f"{n}_{c}") for c in ("row_id", "col_id") for n, f in (("lo", F.min), ("hi", F.max))])

    def part(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}") + 1
        edges = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.floor(lo + i * ((hi - lo) / k)))
        return F.least(F.size(F.filter(edges, lambda x: x <= F.col(c))) - 1, F.lit(k - 1))

    return grid.crossJoin(F.broadcast(e)).select("row_id", "col_id", (part("row_id") * k + part("col_id")).cast("int").alias("block_id"))


def folds(blocked: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Blocks (at most k * k of them) dealt to k folds in md5 order."""
    w = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("block_id").cast("string"))))
    return blocked.select("block_id").distinct().withColumn("fold", F.ntile(k).over(w))


def hotspots(scores: DataFrame, k: int = 10, column: str = "score") -> DataFrame:
    """The k highest scores; ties go to the later pixel."""
    return scores.orderBy(F.desc(column), F.desc("row_id"), F.desc("col_id")).limit(k)


def pixel_boxes(pixels: DataFrame, x0: float, y0: float, a: float = 30.0, e: float = -30.0) -> DataFrame:
    """Pixels with their box on the map: ``x0, y0`` is the raster's corner, ``a`` and ``e`` the steps of a column and a row."""
    x, y = x0 + F.col("col_id") * a, y0 + F.col("row_id") * e
    return pixels.select("row_id", "col_id", x.alias("x_min"), (x + a).alias("x_max"), (y + e).alias("y_min"), y.alias("y_max"))


def median_impute(rows: DataFrame, column: str) -> DataFrame:
    """Values that are null or not finite become the median of those that are not NaN."""
    finite = F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
    m = median(rows, column)
    return rows.withColumn(column, F.when(finite, F.col(column)).otherwise(F.lit(m).cast("double")))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support by class; 0 / 0 is 0."""
    return report_of(confusion(rows, truth, predicted))


def report_of(c: DataFrame) -> DataFrame:
    """The class report of confusion counts (:func:`confusion`)."""
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    d = t.join(p, "label", "full").fillna(0)
    d = d.withColumn("precision", F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return d.select("label", "precision", "recall", f1.alias("f1"), "support")


def report_rows(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The whole report: ``label`` (text), precision, recall, f1 and support of each class, then accuracy (as f1), and the plain and the weighted mean of the classes.

    All but the confusion counts is as small as the classes are few.
    """
    c = class_report(rows, truth, predicted)
    n = F.sum("support")
    mean = lambda label, of: c.agg(*[of(x).alias(x) for x in ("precision", "recall", "f1")], n.alias("support")).select(F.lit(label).alias("label"), "precision", "recall", "f1", "support")
    right = confusion(rows, truth, predicted).agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("support"))
    none = F.lit(None).cast("double")
    accuracy = right.select(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), F.try_divide("hit", "support").alias("f1"), "support")
    out = c.withColumn("label", F.col("label").cast("string")).unionByName(accuracy)
    return out.unionByName(mean("macro avg", F.avg)).unionByName(mean("weighted avg", lambda x: F.try_divide(F.sum(F.col(x) * F.col("support")), n)))


def resample(grid: DataFrame, pixel: float = 30.0, to_pixel: float = 45.0) -> DataFrame:
    """The grid's box in pixels of another size, bilinear: up to four neighbours by an equi-join, those that lack are left out."""
    ends = grid.agg(F.min("row_id").alias("r0"), F.max("row_id").alias("r1"), F.min("col_id").alias("c0"), F.max("col_id").alias("c1"))
    k = to_pixel / pixel
    upto = lambda lo, hi: F.sequence(F.lit(0), (F.ceil((F.col(hi) - F.col(lo) + 1) / k) - 1).cast("int"))
    rows = ends.where("r0 is not null").select("*", F.explode(upto("r0", "r1")).alias("row_id")).repartition("row_id")
    place = lambda i, lo: F.col(lo) + (F.col(i) + 0.5) * k - 0.5
    t = rows.select("*", F.explode(upto("c0", "c1")).alias("col_id")).select("row_id", "col_id", place("row_id", "r0").alias("y"), place("col_id", "c0").alias("x"))
    t = t.withColumns({"r": F.floor("y").cast("int"), "c": F.floor("x").cast("int")})
    fy, fx = F.col("y") - F.col("r"), F.col("x") - F.col("c")
    corner = lambda a, b: F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w"))
    near = t.select("row_id", "col_id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("n")).select("row_id", "col_id", "n.r", "n.c", "n.w")
    known = grid.select(F.col("row_id").alias("r"), F.col("col_id").alias("c"), "z")
    j = near.join(known, ["r", "c"], "left")
    weight = F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    return j.groupBy("row_id", "col_id").agg(F.try_divide(F.sum(F.col("w") * F.col("z")), weight).alias("z"))
