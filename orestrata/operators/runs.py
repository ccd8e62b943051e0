"""What ink on page images forms: runs along rows, ruled lines, connected shapes and their boxes, the angle of a page.

A page is a table of its pixels; a run is a row of this table's ink (``page_id, row_id, x0, x1``, ends
included). Runs are few, and neighbours in the next row are found by a join, so shapes of any size come together
across rows without a page being held anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orestrata.session import checkpointed


def ink_runs(pixels: DataFrame, least: int = 128) -> DataFrame:
    """Runs of neighbouring pixels of a row whose value ``v`` is ``least`` or more, each with a number ``run`` of its own."""
    w = Window.partitionBy("page_id", "row_id").orderBy("col_id")
    ink = pixels.where(F.col("v") >= least)
    begun = ink.withColumn("island", F.col("col_id") - F.row_number().over(w))
    return numbered(begun.groupBy("page_id", "row_id", "island").agg(F.min("col_id").alias("x0"), F.max("col_id").alias("x1")).drop("island"))


def numbered(runs: DataFrame) -> DataFrame:
    """Runs with a number each; they are written, so that it stays."""
    return checkpointed(runs.select("page_id", "row_id", "x0", "x1").withColumn("run", F.monotonically_increasing_id()))


def long_runs(runs: DataFrame, sizes: DataFrame, length: int = 25) -> DataFrame:
    """Runs that stay when a row is opened by a line of ``length`` pixels (an odd number).

    ``sizes`` has each page's ``width`` (by ``page_id``). Beyond a page's edge there is no pixel to miss, so a run at an edge stays if half the line fits.
    """
    half, n = length // 2, F.col("x1") - F.col("x0") + 1
    at_edge = (F.col("x0") == 0) | (F.col("x1") == F.col("width") - 1)
    whole = (F.col("x0") == 0) & (F.col("x1") == F.col("width") - 1)
    return runs.join(sizes.select("page_id", "width"), "page_id").where((n >= length) | whole | (at_edge & (n > half))).drop("width")


def upright(pixels: DataFrame) -> DataFrame:
    """Pages with rows and columns exchanged, so that what runs down becomes what runs along."""
    return pixels.withColumnsRenamed({"row_id": "_r", "col_id": "row_id"}).withColumnRenamed("_r", "col_id")


def shapes(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """``run, shape``: the least run number that each run is connected with. Neighbours touch along an edge, or also at a corner (``diagonal``).

    A run's neighbours are those of the next row that it overlaps. Shapes come together in turns, each of which hangs every run on the
    least one around it; the number of turns grows with the logarithm of a shape's rows.
    """
    reach = 1 if diagonal else 0
    a, b = runs.alias("a"), runs.alias("b")
    touch = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.row_id") + 1 == F.col("b.row_id")) & (F.col("a.x0") <= F.col("b.x1") + reach) & (F.col("b.x0") <= F.col("a.x1") + reach)
    edges = a.join(b, touch).select(F.greatest("a.run", "b.run").alias("u"), F.least("a.run", "b.run").alias("v"))
    return _roots(runs.select("run"), edges)


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The least node that each is connected with, by alternating stars."""
    now, before = checkpointed(edges.where("u <> v").distinct()), None
    while True:
        for large in (True, False):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else now
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            j = both.join(least, "u")
            kept = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            now = kept.where("u <> v").distinct()
        now = checkpointed(now)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return nodes.join(now.select(F.col("u").alias("run"), F.col("v").alias("root")), "run", "left").select("run", F.coalesce("root", "run").alias("shape"))


def gaps(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of what isn't ink, on a page with a margin of one pixel around it (rows -1 and ``height``, columns -1 and ``width``)."""
    rows = sizes.select("page_id", "width", F.explode(F.sequence(F.lit(-1), F.col("height"))).alias("row_id"))
    w = Window.partitionBy("page_id", "row_id").orderBy("x0")
    inner = runs.join(sizes.select("page_id", "width"), "page_id").select("page_id", "row_id", "x0", "x1", "width")
    before = inner.select("page_id", "row_id", (F.coalesce(F.lag("x1").over(w), F.lit(-2)) + 1).alias("g0"), (F.col("x0") - 1).alias("g1"))
    last = rows.join(inner.groupBy("page_id", "row_id").agg(F.max("x1").alias("e")), ["page_id", "row_id"], "left").select("page_id", "row_id", (F.coalesce("e", F.lit(-2)) + 1).alias("g0"), F.col("width").alias("g1"))
    return before.unionByName(last).where("g0 <= g1").select("page_id", "row_id", F.col("g0").alias("x0"), F.col("g1").alias("x1"))


def outer_boxes(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``page_id, x, y, w, h, pixels`` of the connected shapes that lie in no other shape's hole.

    What isn't ink is connected along edges alone. A shape is an outer one if it touches the ink-free part that reaches around the page.
    """
    labelled = checkpointed(runs.join(shapes(runs), "run"))
    free = numbered(gaps(runs, sizes))
    whole = free.join(shapes(free, diagonal=False), "run")
    outside = whole.where("row_id = -1").select("page_id", F.col("shape").alias("around")).distinct()
    around = whole.join(outside, (whole["page_id"] == outside["page_id"]) & (whole["shape"] == outside["around"]), "left_semi")
    near = around.select("page_id", F.explode(F.array(F.col("row_id") - 1, F.col("row_id"), F.col("row_id") + 1)).alias("row_id"), F.col("x0").alias("g0"), F.col("x1").alias("g1"))
    touch = (labelled["page_id"] == near["page_id"]) & (labelled["row_id"] == near["row_id"]) & (near["g0"] <= labelled["x1"] + 1) & (labelled["x0"] <= near["g1"] + 1)
    outer = labelled.join(near, touch, "left_semi").select("page_id", "shape").distinct()
    kept = labelled.join(outer, ["page_id", "shape"])
    box = kept.groupBy("page_id", "shape").agg(F.min("x0").alias("x"), F.min("row_id").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("row_id") - F.min("row_id") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
    return box.select("page_id", "x", "y", "w", "h", "pixels")


def ruled_lines(pixels: DataFrame, sizes: DataFrame, length: int = 25) -> DataFrame:
    """``page_id, orientation, x, y, w, h`` of the shapes that stay when pages are opened by a line of ``length`` pixels along rows and down columns.

    Which of them are rulings (long and thin) is for whoever takes them, as :func:`layout.intersections` does.
    """
    along = outer_boxes(numbered(long_runs(ink_runs(pixels), sizes, length)), sizes)
    turned = sizes.select("page_id", F.col("height").alias("width"), F.col("width").alias("height"))
    down = outer_boxes(numbered(long_runs(ink_runs(upright(pixels)), turned, length)), turned)
    down = down.select("page_id", F.lit("v").alias("orientation"), F.col("y").alias("x"), F.col("x").alias("y"), F.col("h").alias("w"), F.col("w").alias("h"))
    return along.select("page_id", F.lit("h").alias("orientation"), "x", "y", "w", "h").unionByName(down)


# The angle of a page


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the least convex figure around the points, counter-clockwise from the leftmost."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def chain(q) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for x, y in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return chain(p) + chain(reversed(p))


def least_rectangle(corners: list[tuple[int, int]]) -> tuple[float, float]:
    """Area of the least rectangle around a convex figure, and the angle in degrees of its side, from 0 up to 90. One side lies on an edge of the figure."""
    if len(corners) < 3:
        if len(corners) < 2:
            return 0.0, 0.0
        (x0, y0), (x1, y1) = corners
        return 0.0, math.degrees(math.atan2(y1 - y0, x1 - x0)) % 90
    best = None
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        n = math.hypot(x1 - x0, y1 - y0)
        ux, uy = (x1 - x0) / n, (y1 - y0) / n
        along, across = [x * ux + y * uy for x, y in corners], [y * ux - x * uy for x, y in corners]
        area, angle = (max(along) - min(along)) * (max(across) - min(across)), math.degrees(math.atan2(uy, ux)) % 90
        if best is None or (round(area, 6), angle) < (round(best[0], 6), best[1]):
            best = (area, angle)
    return best


def page_angles(runs: DataFrame) -> DataFrame:
    """``page_id, angle``: by how many degrees each page is turned, from over -45 to 45, by the least rectangle around its ink.

    Ends of runs are all that counts. Hulls of parts of a page are made where the runs are, and a page's hulls, a few corners each, are merged.
    """
    ends = "page_id long, x array<long>, y array<long>"

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            here: dict[int, list[tuple[int, int]]] = {}
            for page, y, x0, x1 in zip(*(c.to_pylist() for c in b.columns)):
                here.setdefault(page, []).extend([(x0, y), (x1, y)])
            for page, points in here.items():
                kept[page] = hull(kept.get(page, []) + points)
            if len(kept) > 4096:  # pages of a task that are done with, or come again as another part
                yield packed(kept)
                kept = {}
        yield packed(kept)

    def packed(kept: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        columns = [list(kept), [[x for x, _ in p] for p in kept.values()], [[y for _, y in p] for p in kept.values()]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["page_id", "x", "y"])

    def angle_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angles = []
            for parts in b.column("parts").to_pylist():
                points = [p for part in parts for p in zip(part["x"], part["y"])]
                a = least_rectangle(hull(points))[1]
                angles.append(a - 90 if a > 45 else a)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(angles, pa.float64())], names=["page_id", "angle"])

    parts = runs.select(F.col("page_id").cast("long").alias("page_id"), F.col("row_id").cast("long"), F.col("x0").cast("long"), F.col("x1").cast("long")).mapInArrow(of_parts, ends)
    return parts.groupBy("page_id").agg(F.collect_list(F.struct("x", "y")).alias("parts")).mapInArrow(angle_of, "page_id long, angle double")
