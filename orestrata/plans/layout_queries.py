"""Queries over recognised page blocks and ruling lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from orestrata.operators import layout
from orestrata.plans.catalog import register
from orestrata.plans.fixtures import cte, projection


def _blocks(spark, sf_dir):
    return projection(spark, sf_dir, "ocr_block")


def _recursive(sql: str) -> str:
    return "with recursive " + sql.removeprefix("with ")


# Groups as a fold over a page's blocks: where a block lies away from its group's first one, it begins the next.
_GROUPS = """, s0 as (select page_id, list({'y': y, 'b': block_ord, 'x': x, 'e': y + h} order by y, block_ord) as free from ocr_block group by page_id),
g as (select page_id, 0 as row_group, free, list_filter(free, lambda q: false) as got from s0
 union all select page_id, row_group + 1, list_filter(free, lambda q: abs(q.y - free[1].y) >= 50), list_filter(free, lambda q: abs(q.y - free[1].y) < 50) from g where len(free) > 0)"""


@register("conf_filter", cte("ocr_block") + "select block_ord, page_id, text from ocr_block where coalesce(confidence, 0) >= 0.8")
def conf_filter(spark, sf_dir):
    return layout.keep_confident(_blocks(spark, sf_dir)).select("block_ord", "page_id", "text")


@register(
    "page_confidence",
    cte("ocr_block")
    + """select page_id, coalesce(string_agg(text, ' ' order by block_ord) filter (confidence >= 0.2), '') as text,
count(*) filter (confidence >= 0.2) as filtered_blocks, round(coalesce(avg(confidence), 0), 6) as confidence from ocr_block group by page_id""",
)
def page_confidence(spark, sf_dir):
    return layout.page_text(_blocks(spark, sf_dir), 0.2).withColumn("confidence", F.round("confidence", 6))


@register("doc_confidence", cte("ocr_block") + "select round(coalesce(avg(c), 0), 6) as confidence from (select page_id, avg(confidence) as c from ocr_block group by page_id)")
def doc_confidence(spark, sf_dir):
    return layout.page_text(_blocks(spark, sf_dir)).agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"))


@register(
    "paragraphs",
    cte("ocr_block")
    + """, a as (select *, case when y - lag(y + h) over (partition by page_id order by y, block_ord) >= 30 then 1 else 0 end as n from ocr_block)
select page_id, block_ord, sum(n) over (partition by page_id order by y, block_ord)::bigint + 1 as paragraph from a""",
)
def paragraphs(spark, sf_dir):
    return layout.paragraphs(_blocks(spark, sf_dir)).select("page_id", "block_ord", "paragraph")


@register(
    "table_rows_px",
    cte("ocr_block")
    + """, r as (select page_id, block_ord, (round_even(y / 20.0::double, 0) * 20)::bigint as row_y from ocr_block),
c as (select *, count(*) over (partition by page_id, row_y) as row_blocks from r) select * from c where row_blocks >= 3""",
)
def table_rows_px(spark, sf_dir):
    return layout.pixel_rows(_blocks(spark, sf_dir)).select("page_id", "block_ord", "row_y", "row_blocks")


@register("table_rows_line", cte("ocr_block") + "select page_id, line_num, count(*) as n_blocks from ocr_block group by page_id, line_num having count(*) >= 3")
def table_rows_line(spark, sf_dir):
    return layout.line_rows(_blocks(spark, sf_dir))


@register("row_groups_anchor", _recursive(cte("ocr_block")) + _GROUPS + "select page_id, unnest(got).b as block_ord, row_group from g where len(got) > 0")
def row_groups_anchor(spark, sf_dir):
    return layout.anchored_rows(_blocks(spark, sf_dir))


@register(
    "engine_arbitration",
    cte("ocr_engine_page")
    + """, r as (select *, row_number() over (partition by page_id order by confidence desc, case when engine = 'paddle' then 0 else 1 end) as k from ocr_engine_page where error is null)
select page_id, engine, round(confidence, 6) as confidence from r where k = 1""",
)
def engine_arbitration(spark, sf_dir):
    return layout.best_engine(projection(spark, sf_dir, "ocr_engine_page")).withColumn("confidence", F.round("confidence", 6))


_POINTS = """, h as (select * from ocr_line where orientation = 'h' and w > 50 and h < 10), v as (select * from ocr_line where orientation = 'v' and h > 50 and w < 10),
p as (select h.page_id, h.line_ord as h_ord, v.line_ord as v_ord, v.x + v.w // 2 as x, h.y + h.h // 2 as y from h join v on h.page_id = v.page_id
 and v.x + v.w // 2 between h.x and h.x + h.w and h.y + h.h // 2 between v.y and v.y + v.h),
t as (select page_id, count(*) as n_points, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, count(distinct y) as n_rows, count(distinct x) as n_cols
 from p group by page_id having count(*) >= 4)"""

# One step takes the first free point and what lies near it off the list of a page's free points.
_NEAR = "abs(q.x - free[1].x) < 100 and abs(q.y - free[1].y) < 100"
_CLUSTERS = (
    _POINTS
    + f""", u as (select page_id, x, y, min({{'h': h_ord, 'v': v_ord}}) as o from p group by page_id, x, y),
s0 as (select page_id, list({{'x': x, 'y': y}} order by o) as free from u group by page_id),
g as (select page_id, 0 as step, free, list_filter(free, lambda q: false) as got from s0
 union all select page_id, step + 1, list_filter(free, lambda q: not ({_NEAR})), list_filter(free, lambda q: {_NEAR}) from g where len(free) > 0),
c as (select page_id, row_number() over (partition by page_id order by step)::int as table_no, len(got) as n_points,
 list_min(list_transform(got, lambda q: q.x)) as x_min, list_max(list_transform(got, lambda q: q.x)) as x_max,
 list_min(list_transform(got, lambda q: q.y)) as y_min, list_max(list_transform(got, lambda q: q.y)) as y_max,
 list_unique(list_transform(got, lambda q: q.y))::bigint as n_rows, list_unique(list_transform(got, lambda q: q.x))::bigint as n_cols from g where len(got) >= 4)"""
)


def _points(spark, sf_dir):
    return layout.intersections(projection(spark, sf_dir, "ocr_line"))


@register("line_intersections", cte("ocr_line") + _POINTS + "select * from p")
def line_intersections(spark, sf_dir):
    return _points(spark, sf_dir)


@register("page_tables", cte("ocr_line") + _POINTS + "select * from t")
def page_tables(spark, sf_dir):
    return layout.page_tables(_points(spark, sf_dir))


_CLASSES = (
    _CLUSTERS
    + """, k as (select b.page_id, b.block_ord, case when y > 1000 then 'footer' when y < 100 then 'header' when exists (select 1 from c where c.page_id = b.page_id
 and b.x + b.w // 2 between x_min and x_max and b.y + b.h // 2 between y_min and y_max) then 'table' else 'paragraph' end as text_type from ocr_block b)"""
)


def _classified(spark, sf_dir):
    return layout.classes(_blocks(spark, sf_dir), layout.table_clusters(_points(spark, sf_dir)))


@register("block_classes", _recursive(cte("ocr_line", "ocr_block") + _CLASSES + "select * from k"))
def block_classes(spark, sf_dir):
    return _classified(spark, sf_dir).select("page_id", "block_ord", "text_type")


@register("block_classes_by_page", _recursive(cte("ocr_line", "page_block") + _CLASSES.replace("from ocr_block b", "from page_block b") + "select * from k"))
def block_classes_by_page(spark, sf_dir):
    """Blocks whose numbers start anew on every page."""
    blocks = projection(spark, sf_dir, "page_block")
    return layout.classes(blocks, layout.table_clusters(_points(spark, sf_dir))).select("page_id", "block_ord", "text_type")


@register(
    "page_structure",
    _recursive(cte("ocr_line", "ocr_block"))
    + _CLASSES
    + """, n as (select page_id, count(*) as n, count(*) filter (text_type = 'paragraph') as n_paragraph, count(*) filter (text_type = 'table') as n_table,
 count(*) filter (text_type = 'header') as n_header, count(*) filter (text_type = 'footer') as n_footer from k group by page_id)
select page_id, n_paragraph, n_table, n_header, n_footer, case when n_table > n * 0.5 then 'table_heavy' when n_paragraph > n * 0.7 then 'text_heavy' else 'mixed' end as structure from n""",
)
def page_structure(spark, sf_dir):
    return layout.page_structure(_classified(spark, sf_dir))


@register("table_clusters", _recursive(cte("ocr_line") + _CLUSTERS + "select * from c"))
def table_clusters(spark, sf_dir):
    return layout.table_clusters(_points(spark, sf_dir))


@register(
    "text_shapes",
    cte("ocr_line") + "select line_ord, round(least(1.0::double, (w * h / 10000::double) * (h / w::double / 0.5::double)), 6) as shape_confidence from ocr_line where w * h > 200 and h / w::double > 0.05",
)
def text_shapes(spark, sf_dir):
    return layout.text_shapes(projection(spark, sf_dir, "ocr_line")).select("line_ord", F.round("shape_confidence", 6).alias("shape_confidence"))


@register("text_regions", cte("ocr_block") + "select page_id, block_ord, y from ocr_block where w * h > 100 and h / w::double > 0.1")
def text_regions(spark, sf_dir):
    return layout.text_regions(_blocks(spark, sf_dir)).select("page_id", "block_ord", "y")


@register("numbered_paragraphs", cte("ocr_block") + "select page_id, par_num, count(*) as n_blocks, string_agg(text, ' ' order by line_num, block_ord) as text from ocr_block group by page_id, par_num")
def numbered_paragraphs(spark, sf_dir):
    return layout.numbered_paragraphs(_blocks(spark, sf_dir))


@register(
    "blocks_in_tables",
    _recursive(cte("ocr_line", "ocr_block"))
    + _CLUSTERS
    + "select page_id, block_ord from ocr_block b where exists (select 1 from c where c.page_id = b.page_id and b.x + b.w // 2 between x_min and x_max and b.y + b.h // 2 between y_min and y_max)",
)
def blocks_in_tables(spark, sf_dir):
    return layout.in_tables(_blocks(spark, sf_dir), layout.table_clusters(_points(spark, sf_dir))).select("page_id", "block_ord")


@register("column_boxes", _recursive(cte("ocr_block")) + _GROUPS + """select page_id, row_group, len(got) as n_blocks, list_min(list_transform(got, lambda q: q.x)) as x_min,
 list_max(list_transform(got, lambda q: q.x)) as x_max, list_min(list_transform(got, lambda q: q.y)) as y_min, list_max(list_transform(got, lambda q: q.e)) as y_max from g where len(got) >= 2""")
def column_boxes(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return layout.column_boxes(layout.anchored_rows(b).join(b, ["page_id", "block_ord"]))


@register("line_tables", cte("ocr_block") + """select page_id, line_num, 1 as row_count, count(*) as col_count, string_agg(text, '|' order by block_ord) as cells from ocr_block
group by page_id, line_num having count(*) >= 3""")
def line_tables(spark, sf_dir):
    return layout.line_tables(_blocks(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


@register("word_filter", cte("ocr_block") + """, w as (select page_id, block_ord, case when block_ord % 5 = 0 then '  ' else concat(' ', text) end as text, confidence * 120 - 10 as conf from ocr_block)
select page_id, block_ord, trim(text) as text, trunc(conf)::int / 100.0::double as confidence from w where trim(text) <> '' and trunc(conf)::int > 0""")
def word_filter(spark, sf_dir):
    w = _blocks(spark, sf_dir).select("page_id", "block_ord", F.when(F.col("block_ord") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), (F.col("confidence") * 120 - 10).alias("conf"))
    return layout.word_blocks(w)


@register("polygon_boxes", cte("ocr_block") + """select block_ord, trunc(x - 0.75::double)::int as x, trunc(y + 0.25::double)::int as y, trunc((x + w + 0.5::double) - (x - 0.75::double))::int as w,
 trunc((y + h + 0.5::double) - (y + 0.25::double))::int as h from ocr_block""")
def polygon_boxes(spark, sf_dir):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    p = F.array(point(x - 0.75, y + 0.5), point(x + w, y + 0.25), point(x + w + 0.5, y + h), point(x, y + h + 0.5))
    return _blocks(spark, sf_dir).select("block_ord", *layout.polygon_box(p))


@register("numbered_blocks", cte("ocr_block") + "select page_id, block_ord, row_number() over (partition by page_id order by block_ord)::int as block_no from ocr_block where trim(text) <> ''")
def numbered_blocks(spark, sf_dir):
    return layout.numbered(_blocks(spark, sf_dir)).select("page_id", "block_ord", "block_no")


@register("blocks_by_height", cte("ocr_block") + "select page_id, block_ord, row_number() over (partition by page_id order by y, block_ord)::int as place from ocr_block")
def blocks_by_height(spark, sf_dir):
    return layout.by_height(_blocks(spark, sf_dir)).select("page_id", "block_ord", "place")


@register("image_errors", cte("ocr_line") + """select line_ord, case when line_ord % 11 = 0 then 'missing' when line_ord % 4 not in (2, 3) then 'dimensions' when x = 0 or y * 11 = 0 then 'empty'
 when least(x, y * 11) < 10 then 'too small' when greatest(x, y * 11) > 10000 then 'too large' end as error from ocr_line""")
def image_errors(spark, sf_dir):
    dims = F.when(F.col("line_ord") % 11 != 0, F.col("line_ord") % 4)
    return projection(spark, sf_dir, "ocr_line").select("line_ord", layout.image_error(F.col("x"), F.col("y") * 11, dims).alias("error"))
