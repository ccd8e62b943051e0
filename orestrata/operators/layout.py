"""Page layout: paragraphs, table rows, ruled tables, block classes and the choice between engines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_confident(blocks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Blocks at or above the threshold; a missing confidence is 0."""
    return blocks.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def page_text(blocks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A page's kept text in block order, the number of kept blocks, and the confidence of all its blocks."""
    ok = F.coalesce("confidence", F.lit(0.0)) >= threshold
    kept = F.array_sort(F.collect_list(F.when(ok, F.struct("block_ord", "text"))))
    return blocks.groupBy("page_id").agg(
        F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"), F.count_if(ok).alias("filtered_blocks"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence")
    )


def paragraphs(blocks: DataFrame, gap: int = 30) -> DataFrame:
    """Blocks with their paragraph: a new one begins where a block lies ``gap`` or more below the one before."""
    w = Window.partitionBy("page_id").orderBy("y", "block_ord")
    new = F.when(F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) >= gap, 1).otherwise(0)
    return blocks.withColumn("_new", new).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def pixel_rows(blocks: DataFrame, step: int = 20, least: int = 3) -> DataFrame:
    """Blocks in table rows: rounded (half to even) places with ``least`` blocks or more."""
    d = blocks.withColumn("row_y", (F.bround(F.col("y") / step, 0) * step).cast("long"))
    return d.withColumn("row_blocks", F.count("*").over(Window.partitionBy("page_id", "row_y"))).where(F.col("row_blocks") >= least)


def line_rows(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Table rows by line number: one row each, with its width in blocks."""
    return blocks.groupBy("page_id", "line_num").agg(F.count("*").alias("n_blocks")).where(F.col("n_blocks") >= least)


def anchored_rows(blocks: DataFrame, reach: int = 50) -> DataFrame:
    """Blocks with the number of their row group; a group holds what lies less than ``reach`` from its first member.

    The fold depends on each group's first member, so a page's blocks go by in order; nothing of a page is held but its last group's place.
    """
    page = blocks.select("page_id", "y", "block_ord").repartition("page_id").sortWithinPartitions("page_id", "y", "block_ord")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = anchor = None
        group = 0
        for b in batches:
            out = []
            for page_id, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if page_id != now:
                    now, anchor, group = page_id, y, 1
                elif abs(y - anchor) >= reach:
                    anchor, group = y, group + 1
                out.append(group)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int32())], names=["page_id", "block_ord", "row_group"])

    return page.mapInArrow(fold, T.StructType([blocks.schema["page_id"], blocks.schema["block_ord"], T.StructField("row_group", T.IntegerType())]))


def intersections(lines: DataFrame, stripe: int = 64) -> DataFrame:
    """Points where the middles of a horizontal and a vertical line cross on the same page. Shapes that are no ruling are left out first.

    Lines meet by page and by stripes of ``stripe`` pixels: a vertical line lies in one, a horizontal one in those that it spans.
    """
    h = lines.where((F.col("orientation") == "h") & (F.col("w") > 50) & (F.col("h") < 10)).select("page_id", F.col("line_ord").alias("h_ord"), F.col("x").alias("hx"), F.expr("y + h div 2").alias("hy"), F.col("w").alias("hw"))
    v = lines.where((F.col("orientation") == "v") & (F.col("h") > 50) & (F.col("w") < 10)).select("page_id", F.col("line_ord").alias("v_ord"), F.expr("x + w div 2").alias("vx"), F.col("y").alias("vy"), F.col("h").alias("vh"))
    at = lambda x: F.floor(x / stripe)
    h = h.withColumn("stripe", F.explode(F.sequence(at(F.col("hx")), at(F.col("hx") + F.col("hw")))))
    j = h.join(v.withColumn("stripe", at(F.col("vx"))), ["page_id", "stripe"])
    j = j.where(F.col("vx").between(F.col("hx"), F.col("hx") + F.col("hw")) & F.col("hy").between(F.col("vy"), F.col("vy") + F.col("vh")))
    return j.select("page_id", "h_ord", "v_ord", F.col("vx").alias("x"), F.col("hy").alias("y"))


def page_tables(points: DataFrame, least: int = 4) -> DataFrame:
    """Pages with enough intersections: the box, and distinct rows and columns."""
    d = points.groupBy("page_id").agg(
        F.count("*").alias("n_points"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.countDistinct("y").alias("n_rows"), F.countDistinct("x").alias("n_cols"),
    )
    return d.where(F.col("n_points") >= least)


def in_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose middle lies in a table's box, borders included."""
    x, y = F.expr("x + w div 2"), F.expr("y + h div 2")
    boxes = tables.select("page_id", "x_min", "x_max", "y_min", "y_max").alias("t")
    inside = (F.col("b.page_id") == F.col("t.page_id")) & F.col("b.mx").between(F.col("t.x_min"), F.col("t.x_max")) & F.col("b.my").between(F.col("t.y_min"), F.col("t.y_max"))
    return blocks.withColumns({"mx": x, "my": y}).alias("b").join(boxes, inside, "left_semi").drop("mx", "my")


def classes(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks as paragraph or, in one of the page's ``tables``, table; then header (y < 100) and footer (y > 1000), the later winning.

    Each block is judged by its own place, whatever its number. A page's tables are few: they lie ``reach`` apart (:func:`table_clusters`).
    """
    boxes = tables.groupBy("page_id").agg(F.collect_list(F.struct("x_min", "x_max", "y_min", "y_max")).alias("_boxes"))
    x, y = F.expr("x + w div 2"), F.expr("y + h div 2")
    inside = F.exists("_boxes", lambda t: x.between(t["x_min"], t["x_max"]) & y.between(t["y_min"], t["y_max"]))
    kind = F.when(F.col("y") > 1000, "footer").when(F.col("y") < 100, "header").when(inside, "table").otherwise("paragraph")
    return blocks.join(boxes, "page_id", "left").withColumn("text_type", kind).drop("_boxes")


def page_structure(classified: DataFrame) -> DataFrame:
    """Blocks of each class by page and the dominant structure; shares are compared in whole numbers, for 0.7 * 90 is less than 63 in binary."""
    n = F.count("*")
    count = {k: F.count_if(F.col("text_type") == k) for k in ("paragraph", "table", "header", "footer")}
    kind = F.when(count["table"] * 2 > n, "table_heavy").when(count["paragraph"] * 10 > n * 7, "text_heavy").otherwise("mixed")
    return classified.groupBy("page_id").agg(*[c.alias(f"n_{k}") for k, c in count.items()], kind.alias("structure"))


def best_engine(results: DataFrame) -> DataFrame:
    """The engine with the highest confidence on each page, of those that didn't fail; ties go to the first by name."""
    d = results.where(F.col("error").isNull())
    return d.groupBy("page_id").agg(F.max_by(F.struct("engine", "confidence"), F.struct("confidence", F.when(F.col("engine") == "paddle", 1).otherwise(0))).alias("b")).select("page_id", "b.engine", "b.confidence")


def _first_places(page: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the first of equal points, in order."""
    order = np.lexsort((y, x, page))
    a, b, c = page[order], x[order], y[order]
    return np.sort(order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]])


def _gathered(page: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int, least: int) -> list[np.ndarray]:
    """Tables of whole pages, whose distinct points come in order: in each turn the first free point of every page gathers."""
    step, free, turn = np.zeros(len(page), dtype=np.int64), np.arange(len(page)), 0
    while len(free):
        new = np.r_[True, page[free][1:] != page[free][:-1]]
        anchor = free[new][np.cumsum(new) - 1]
        near = (abs(x[free] - x[anchor]) < reach) & (abs(y[free] - y[anchor]) < reach)
        step[free[near]] = turn = turn + 1
        free = free[~near]

    def groups(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values in order of page, turn and size, and where a new page or turn begins."""
        o = np.lexsort((value, step, page))
        return value[o], np.flatnonzero(np.r_[True, (page[o][1:] != page[o][:-1]) | (step[o][1:] != step[o][:-1])])

    (xs, at), (ys, _), (ps, _) = groups(x), groups(y), groups(page)
    last = np.r_[at[1:], len(xs)] - 1

    def distinct(v: np.ndarray) -> np.ndarray:
        new = np.r_[True, v[1:] != v[:-1]]
        new[at] = True
        return np.add.reduceat(new.astype(np.int64), at)

    n = last - at + 1
    kept = n >= least
    pages = ps[at][kept]
    first = np.r_[True, pages[1:] != pages[:-1]] if len(pages) else np.zeros(0, dtype=bool)
    number = np.arange(len(pages)) - np.flatnonzero(first)[np.cumsum(first) - 1] + 1
    return [pages, number.astype(np.int32), *[v[kept] for v in (n, xs[at], xs[last], ys[at], ys[last], distinct(ys), distinct(xs))]]


def table_clusters(points: DataFrame, reach: int = 100, least: int = 4) -> DataFrame:
    """Tables of a page: the first free point gathers the free points less than ``reach`` away on both axes, and so on.

    Only distinct points count. Pages go by in order, and all pages of a batch take a turn at once; what is held beyond a batch is the distinct points
    of its last page, bounded by its pixels. A page's clusters are bounded by how many anchors lie ``reach`` apart.
    """
    names = ["page_id", "table_no", "n_points", "x_min", "x_max", "y_min", "y_max", "n_rows", "n_cols"]
    known = points.where("page_id is not null and x is not null and y is not null")
    ordered = known.select(*[F.col(c).cast("long").alias(c) for c in ("page_id", "x", "y")], "h_ord", "v_ord").repartition("page_id").sortWithinPartitions("page_id", "h_ord", "v_ord")

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _gathered(*held, reach, least)], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 3
        for b in batches:
            if b.num_rows:
                held = [np.r_[h, b.column(i).to_numpy()] for i, h in enumerate(held)]
                places = _first_places(*held)
                held = [h[places] for h in held]
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last page may go on
                if whole:
                    yield told([h[:whole] for h in held])
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield told(held)

    return ordered.mapInArrow(gather, "page_id long, table_no int, n_points long, x_min long, x_max long, y_min long, y_max long, n_rows long, n_cols long")


def column_boxes(grouped: DataFrame, least: int = 2) -> DataFrame:
    """The box of each row group (``row_group``) of ``least`` blocks or more: left edges from first to last, top to the lowest bottom."""
    d = grouped.groupBy("page_id", "row_group").agg(
        F.count("*").alias("n_blocks"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max(F.col("y") + F.col("h")).alias("y_max")
    )
    return d.where(F.col("n_blocks") >= least)


def line_tables(blocks: DataFrame, least: int = 3) -> DataFrame:
    """A table of one row for each line of ``least`` words or more, with its cells in block order."""
    cells = F.array_sort(F.collect_list(F.struct("block_ord", "text")))
    d = blocks.groupBy("page_id", "line_num").agg(F.count("*").alias("col_count"), F.transform(cells, lambda c: c["text"]).alias("cells"))
    return d.where(F.col("col_count") >= least).withColumn("row_count", F.lit(1))


def word_blocks(words: DataFrame) -> DataFrame:
    """Recognised words with text and a whole confidence above 0; the text is trimmed and the confidence a share."""
    d = words.withColumn("text", F.trim("text")).where((F.col("text") != "") & (F.col("conf").cast("int") > 0))
    return d.withColumn("confidence", F.col("conf").cast("int") / 100.0).drop("conf")


def polygon_box(polygon) -> list:
    """``x, y, w, h`` of a polygon (an array of points with ``x`` and ``y``), each cut to whole pixels; a missing one has no box."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    ends = {"x": F.array_min(xs), "y": F.array_min(ys), "w": F.array_max(xs) - F.array_min(xs), "h": F.array_max(ys) - F.array_min(ys)}
    return [c.cast("int").alias(n) for n, c in ends.items()]


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with text, numbered from 1 on their page in order."""
    d = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return d.withColumn("block_no", F.row_number().over(Window.partitionBy("page_id").orderBy("block_ord")))


def by_height(blocks: DataFrame) -> DataFrame:
    """Blocks with their place from top to bottom of their page; a page's order is a number, so nothing is sorted as a whole."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "block_ord")))


def image_error(height, width, dims):
    """The first rule that an image breaks, or null: missing, not 2 or 3 dimensions, empty, too small, too large."""
    least, most = F.least(height, width), F.greatest(height, width)
    return (
        F.when(dims.isNull(), "missing").when(~dims.isin(2, 3), "dimensions").when((height == 0) | (width == 0), "empty").when(least < 10, "too small").when(most > 10000, "too large")
    )


def text_shapes(boxes: DataFrame) -> DataFrame:
    """Boxes shaped like text (area above 200, height above a twentieth of the width) with the confidence of their shape."""
    area, aspect = F.col("w") * F.col("h"), F.try_divide("h", "w")
    return boxes.where((area > 200) & (aspect > 0.05)).withColumn("shape_confidence", F.least(F.lit(1.0), (area / 10000) * (aspect / 0.5)))


def text_regions(boxes: DataFrame) -> DataFrame:
    """Boxes of regions with text: area above 100 and height above a tenth of the width."""
    return boxes.where((F.col("w") * F.col("h") > 100) & (F.try_divide("h", "w") > 0.1))


def numbered_paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraphs by the number that recognition gave: their text by line and place, and how many blocks they have."""
    parts = F.array_sort(F.collect_list(F.struct("line_num", "block_ord", "text")))
    return blocks.groupBy("page_id", "par_num").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(parts, lambda b: b["text"]), " ").alias("text"))
