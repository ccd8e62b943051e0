"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

1. Word counts per source give each source's target: the weights share the
   total, no source passes ``max_repeat`` times its size, and the excess is
   shared again by weight (a water level over sources, found with windows over
   one row per source).
2. Every source is dealt into cells of about ``cell_words`` words by a hash of
   id and text, so a source, an id or a text with a third of all rows is many
   cells. A cell's documents in hash order are one stream, cut into equal blocks.
3. Cells at the same relative place form a shard. In a shard, seats (blocks)
   go to cells by the highest quotients votes / (2 k + 1). Only quotients near
   the expected seat count are made, as the others are decided beforehand.
4. A cell of n blocks with q seats takes every block q div n times, and q mod n
   further blocks picked by a seeded permutation of block numbers.

Defined cases: a null or empty text has size 0, is returned with taken 0 and
takes no part in the shares of words; a null source is a source of its own and
comes last; repeated rows (one id, one text) are separate documents that lie one
after the other in one cell;
an empty table gives no rows. Columns besides the three that are read are kept
by ``mix``; its own columns start with ``_m_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orestrata.llm.common import cut, hash_int, n_words, table


@dataclass(frozen=True)
class MixPlan:
    """Parameters of a mix; ``weights`` repeat over the sources in code point order."""

    weights: tuple[int, ...] = (5, 2, 1)
    total_share: float = 1.5
    max_repeat: float = 2.0
    block_words: int = 64
    cell_words: int = 1 << 18
    seed: str = "mix-1"


PLAN = MixPlan()
#: Multipliers of block numbers. Each is prime, so it permutes any number of blocks that it doesn't divide.
_STEPS = (1000003, 999983)


def source_targets(sized: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """One row per source: ``_m_idx``, ``_m_source``, size, target, cells and shards (all named ``_m_``, as ``docs`` may have such columns).

    ``sized`` has ``_m_source`` and ``_m_size``. Unpartitioned windows see one row per source.
    """
    totals = sized.groupBy("_m_source").agg(F.sum("_m_size").alias("_m_source_size"))
    by_name = Window.orderBy(F.col("_m_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in plan.weights]), (F.col("_m_idx") % len(plan.weights) + 1).cast("int"))
    s = totals.withColumn("_m_idx", (F.row_number().over(by_name) - 1).cast("int")).withColumn("_m_w", weight)
    s = s.withColumn("_m_cap", F.lit(plan.max_repeat) * F.col("_m_source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("_m_cap") / F.col("_m_w"), "_m_idx")
    s = s.withColumn("_m_before", F.sum("_m_cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m_cap"))
    s = s.withColumn("_m_rest", F.sum("_m_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_m_total", F.lit(plan.total_share) * F.sum("_m_source_size").over(everything))
    # The level rises while capped sources leave the sharing and falls after, so its peak is the final one.
    s = s.withColumn("_m_level", F.max((F.col("_m_total") - F.col("_m_before")) / F.col("_m_rest")).over(everything))
    s = s.withColumn("_m_target", F.least(F.col("_m_cap"), F.col("_m_w") * F.col("_m_level")))
    s = s.withColumn("_m_cells", F.greatest(F.lit(1), F.ceil(F.col("_m_source_size") / F.lit(plan.cell_words))).cast("long"))
    s = s.withColumn("_m_shards", F.max("_m_cells").over(everything))
    return s.select("_m_idx", "_m_source", "_m_source_size", "_m_target", "_m_cells", "_m_shards")


def cell_quotas(cells: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """Seats of every cell: ``_m_idx, _m_cell, _m_cell_size, _m_n`` (blocks) and ``_m_q`` (seats).

    ``cells`` has one row per cell with its size and its source's numbers. The
    window of a shard holds one row per source and a few quotients for each.
    """
    c = cells.withColumn("_m_n", F.ceil(F.col("_m_cell_size") / F.lit(plan.block_words)).cast("long"))
    c = c.withColumn("_m_votes", F.when(F.col("_m_source_size") > 0, F.col("_m_target") / F.col("_m_source_size") * F.col("_m_n")).otherwise(0.0))
    c = c.withColumn("_m_shard", F.floor(F.col("_m_cell") * F.col("_m_shards") / F.col("_m_cells")))
    shard = Window.partitionBy("_m_shard")
    # Whole millionths add up to the same in any order, so the seats don't hang on it.
    c = c.withColumn("_m_seats", F.floor((F.sum(F.floor(F.col("_m_votes") * 1_000_000)).over(shard) + 500_000) / 1_000_000).cast("long"))
    slack = F.lit(2) + F.ceil(F.col("_m_votes") * F.count("*").over(shard) / F.greatest(F.lit(1), F.col("_m_seats")))
    most = F.ceil(F.lit(plan.max_repeat) * F.col("_m_n")).cast("long")
    c = c.withColumn("_m_lo", F.greatest(F.lit(0), F.floor("_m_votes") - slack).cast("long"))
    c = c.withColumn("_m_hi", F.least(most, F.floor("_m_votes") + slack).cast("long"))
    c = c.withColumn("_m_left", F.col("_m_seats") - F.sum("_m_lo").over(shard))
    ks = F.when(F.col("_m_hi") > F.col("_m_lo"), F.sequence(F.col("_m_lo"), F.col("_m_hi") - 1))
    c = c.withColumn("_m_k", F.explode_outer(ks))
    tie = hash_int(F.lit(plan.seed), F.col("_m_idx").cast("string"), F.col("_m_cell").cast("string"))
    highest = shard.orderBy((F.col("_m_votes") / (2 * F.col("_m_k") + 1)).desc_nulls_last(), tie, "_m_idx", "_m_cell")
    c = c.withColumn("_m_won", (F.col("_m_k").isNotNull() & (F.row_number().over(highest) <= F.col("_m_left"))).cast("long"))
    return c.groupBy("_m_idx", "_m_cell", "_m_cell_size", "_m_n", "_m_lo").agg(F.sum("_m_won").alias("_m_won")).select(
        "_m_idx", "_m_cell", "_m_cell_size", "_m_n", (F.col("_m_lo") + F.col("_m_won")).alias("_m_q")
    )


def mix(docs: DataFrame, plan: MixPlan = PLAN, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``_m_size``, ``_m_source_size``, ``_m_target``, ``_m_base`` (whole copies),
    ``_m_ranges`` (word ranges, from 0, of one more partial copy) and ``_m_taken``."""
    order = hash_int(F.lit(plan.seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    sized = cut(docs.select(F.col(doc_id).alias("_m_doc"), F.col(source).alias("_m_source"), n_words(F.col(text)).alias("_m_size"), order.alias("_m_hash")))
    sources = cut(source_targets(sized, plan))

    def dealt(rows: DataFrame) -> DataFrame:
        j = rows.join(sources.withColumnRenamed("_m_source", "_m_s"), rows["_m_source"].eqNullSafe(F.col("_m_s")), "left")
        return j.withColumn("_m_cell", F.pmod("_m_hash", "_m_cells")).drop("_m_s")

    numbers = ["_m_idx", "_m_cell", "_m_source_size", "_m_target", "_m_cells", "_m_shards"]
    cells = dealt(sized).groupBy(*numbers).agg(F.sum("_m_size").alias("_m_cell_size"))
    quotas = cut(cell_quotas(cells, plan))
    rows = dealt(docs.withColumn("_m_doc", F.col(doc_id)).withColumn("_m_source", F.col(source)).withColumn("_m_size", n_words(F.col(text))).withColumn("_m_hash", order))
    stream = Window.partitionBy("_m_idx", "_m_cell").orderBy("_m_hash", "_m_doc", "_m_size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_m_end", F.sum("_m_size").over(stream)).withColumn("_m_start", F.col("_m_end") - F.col("_m_size"))
    out = out.join(quotas, ["_m_idx", "_m_cell"], "left")
    n, size = F.col("_m_n"), F.col("_m_cell_size")
    offset = hash_int(F.lit(plan.seed), F.col("_m_idx").cast("string"), F.col("_m_cell").cast("string"), F.lit("blocks"))
    step = F.when(n % _STEPS[0] == 0, F.lit(_STEPS[1])).otherwise(F.lit(_STEPS[0])).cast("long")
    has = F.col("_m_size") > 0
    out = (
        out.withColumn("_m_base", F.when(has, F.expr("_m_q div _m_n")).otherwise(0).cast("long"))
        .withColumn("_m_more", F.when(has, F.col("_m_q") % n).otherwise(0))
        .withColumn("_m_offset", offset)
        .withColumn("_m_first", F.expr("((_m_start + 1) * _m_n - 1) div nullif(_m_cell_size, 0)"))
        .withColumn("_m_last", F.expr("(_m_end * _m_n - 1) div nullif(_m_cell_size, 0)"))
    )
    picked = F.filter(F.sequence("_m_first", "_m_last"), lambda b: (b * step + F.col("_m_offset")) % n < F.col("_m_more"))
    edge = lambda b: _int_div(b * size, n)
    ranges = F.transform(
        picked,
        lambda b: F.struct(
            (F.greatest(F.col("_m_start"), edge(b)) - F.col("_m_start")).alias("from"),
            (F.least(F.col("_m_end"), edge(b + 1)) - F.col("_m_start")).alias("to"),
        ),
    )
    out = out.withColumn("_m_ranges", F.when(has & (F.col("_m_more") > 0), ranges))
    extra = F.coalesce(F.aggregate("_m_ranges", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"]), F.lit(0))
    out = out.withColumn("_m_taken", (F.col("_m_base") * F.col("_m_size") + extra).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_m_") and c not in ("_m_size", "_m_source_size", "_m_target", "_m_base", "_m_ranges", "_m_taken")])


def _int_div(a, b):
    """Exact whole quotient of positive longs below 2^53."""
    return ((a - a % b) / b).cast("long")


def mixed_texts(docs: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as taken, a part as a row with the words of its ranges.

    A word keeps the white space before it, so lines stay lines. ``n_chars`` is made to fit.
    """
    cols = docs.columns
    m = mix(docs, plan)
    tokens = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    m = m.withColumn("_m_tokens", F.when(F.size("_m_ranges") > 0, tokens))
    part = F.array_join(F.flatten(F.transform("_m_ranges", lambda r: F.slice("_m_tokens", (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), "")
    part = F.regexp_replace(part, r"^[\x20\x09-\x0D]+", "")
    whole = F.array_repeat(F.col("text"), F.col("_m_base").cast("int"))
    texts = F.concat(whole, F.when(F.size("_m_ranges") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return m.withColumn("_m_text", F.explode(texts)).select(
        *[F.col("_m_text").alias("text") if c == "text" else F.length("_m_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in cols]
    )


def op1_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), F.col("_m_taken").alias("taken"))


OP1_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 8))::bigint as h from documents),
t as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as idx from d group by source),
s0 as (select *, case idx % 3 when 0 then 5 when 1 then 2 else 1 end::double as w, 2.0::double * source_size as cap from t),
s1 as (select *, sum(cap) over (order by cap / w, idx rows unbounded preceding) - cap as before,
    sum(w) over (order by cap / w, idx rows between current row and unbounded following) as rest,
    1.5::double * sum(source_size) over () as total from s0),
s2 as (select *, max((total - before) / rest) over () as level from s1),
s as (select idx, source, source_size, least(cap, w * level) as target,
    greatest(1, ceil(source_size / 262144.0))::bigint as cells from s2),
x as (select d.*, s.idx, s.source_size, s.target, s.cells, d.h % s.cells as cell from d join s on d.source is not distinct from s.source),
c0 as (select idx, cell, source_size, target, cells, sum(size)::bigint as cell_size from x group by all),
c1 as (select *, ceil(cell_size / 64.0)::bigint as n, (select max(cells) from s) as shards from c0),
c2 as (select *, case when source_size > 0 then target / source_size * n else 0 end as votes, cell * shards // cells as shard from c1),
c3 as (select *, (sum(floor(votes * 1000000)::bigint) over (partition by shard)::bigint + 500000) // 1000000 as seats, count(*) over (partition by shard) as sources from c2),
c4 as (select *, 2 + ceil(votes * sources / greatest(1, seats))::bigint as slack from c3),
c5 as (select *, greatest(0, floor(votes)::bigint - slack) as lo, least(2 * n, floor(votes)::bigint + slack) as hi from c4),
c6 as (select *, seats - sum(lo) over (partition by shard) as need from c5),
k0 as (select *, unnest(range(lo, hi)) as k from c6),
k1 as (select *, row_number() over (partition by shard order by votes / (2 * k + 1) desc,
    ('0x' || substr(md5('mix-1|' || idx || '|' || cell), 1, 8))::bigint, idx, cell) as r from k0),
won as (select idx, cell, count(*) filter (where r <= need) as won from k1 group by idx, cell),
q as (select c6.idx, c6.cell, cell_size, n, lo + coalesce(won, 0) as q,
    ('0x' || substr(md5('mix-1|' || c6.idx || '|' || c6.cell || '|blocks'), 1, 8))::bigint as off
  from c6 left join won on c6.idx = won.idx and c6.cell = won.cell),
y as (select x.*, cell_size, n, q, off, sum(size) over (partition by x.idx, x.cell order by h, doc_id, size rows unbounded preceding)::bigint as e
  from x join q on x.idx = q.idx and x.cell = q.cell),
z as (select *, e - size as b, ((e - size + 1) * n - 1) // nullif(cell_size, 0) as j0, (e * n - 1) // nullif(cell_size, 0) as j1 from y)
select doc_id, source, size, source_size, target, case when size = 0 then 0 else (q // n) * size + coalesce(list_sum(list_transform(
    list_filter(range(j0, j1 + 1), lambda j: (j * 1000003 + off) % n < q % n),
    lambda j: least(e, (j + 1) * cell_size // n) - greatest(b, j * cell_size // n))), 0) end::bigint as taken
from z
"""
