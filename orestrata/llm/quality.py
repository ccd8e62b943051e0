"""Quality rules: per-document measures and cross-document line frequency.

DataFrame functions only. A host's boilerplate is found by hashing normalised
lines and counting, for each host, the distinct documents that hold a line, and
how many different texts these documents have. Lines above both limits are taken
out (``_q_text`` is the text without them), and documents that they leave
depleted are rejected.

Defined cases: a null text counts as empty (no words, so it fails the base
rules); an empty table gives no rows; repeated rows are judged alike, and each
counts as a document, but copies of a few texts alone never make a line
boilerplate: deduplication is left with one of them; a null host is a host of its own; columns other
than the three that are read pass through ``judge`` untouched, whatever their
names (internal columns start with ``_q_``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orestrata.llm.common import SPACE, WORD, cut, spread_join, table, words


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    A line is boilerplate on a host when more than ``min_documents`` documents of
    the host, with more than ``min_texts`` different texts, hold it. A document is
    depleted when fewer than ``min_words`` words, or less than ``min_left`` of its
    words, lie outside boilerplate lines.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    min_documents: int = 20
    min_texts: int = 5
    min_left: float = 0.3


RULES = QualityRules()
#: The pipeline's: groups of near copies, of which one document is to stay, share their lines in many texts.
CORPUS_RULES = QualityRules(min_texts=20)
#: Lists of up to so many lines (8 bytes each) are broadcast; beyond that they meet the documents in a shuffle.
BROADCAST_LINES = 1_000_000


def line_key(line: Column) -> Column:
    """A line as it is compared across documents: lower case, digits as 0, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))), "[0-9]", "0"), " +", " ")


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` that begin at the ascending ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )


def measures(docs: DataFrame, rules: QualityRules = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``_q_`` measures of every text added."""
    k = rules.window
    x = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(x, "\n", -1), lambda s: s.rlike(WORD))
    out = docs.withColumn("_q_words", words(F.col(text))).withColumn("_q_lines", lines)
    out = out.withColumn("_q_wh", F.transform("_q_words", lambda w: F.xxhash64(w)))
    out = out.withColumn(
        "_q_win",
        F.when(F.size("_q_wh") > k, F.transform(F.sequence(F.lit(1), F.size("_q_wh") - (k - 1)), lambda i: F.xxhash64(F.slice("_q_wh", i, k)))),
    )
    # Only texts in which a window comes twice need the sorted look at neighbours.
    out = out.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct("_q_win")) < F.size("_q_win"),
            F.array_sort(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda x, j: F.get("_q_sorted", j)["h"] == x["h"]
    out = out.withColumn(
        "_q_starts",
        F.array_sort(
            F.transform(
                F.filter("_q_sorted", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    return (
        out.withColumn("_q_n_words", F.size("_q_words").cast("long"))
        .withColumn("_q_word_chars", F.length(F.regexp_replace(x, SPACE, "")).cast("long"))
        .withColumn("_q_n_symbols", F.regexp_count(x, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("_q_n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
        .withColumn("_q_n_repeat_words", F.coalesce(_covered(F.col("_q_starts"), k), F.lit(0).cast("long")))
        .withColumn("_q_base_failed", (F.col("_q_n_words") < rules.min_words) | (100 * F.col("_q_n_repeat_words") > rules.max_repeat_percent * F.col("_q_n_words")))
        .drop("_q_words", "_q_wh", "_q_win", "_q_sorted", "_q_starts", "_q_lines")
    )


def _lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda s: s.rlike(WORD))


def _copy(text: str, host: str) -> Column:
    """A key of host and text, alike for copies."""
    return F.xxhash64(F.col(host), F.coalesce(F.col(text), F.lit("")))


def _host_line(line: Column, host: str) -> Column:
    """A key of host and normalised line."""
    return F.xxhash64(F.col(host), F.xxhash64(line_key(line)))


def line_rows(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``_q_copy, _q_lines``: one small row a document with the keys ``k`` of its lines and their words ``n``."""
    line = F.transform(_lines(text), lambda s: F.struct(_host_line(s, host).alias("k"), F.regexp_count(s, F.lit(WORD)).alias("n")))
    return docs.select(_copy(text, host).alias("_q_copy"), line.alias("_q_lines"))


def boilerplate(rows: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """``_q_line, n``: the keys of lines above the limits, and how many documents hold them. ``rows`` are those of ``line_rows``.

    Copies are merged before texts are counted, and both counts combine on the
    map side, so neither a large host nor a line that all documents share meets
    in one task.
    """
    held = rows.select("_q_copy", F.explode(F.array_distinct(F.transform("_q_lines", lambda s: s["k"]))).alias("_q_line"))
    texts = held.groupBy("_q_line", "_q_copy").agg(F.count("*").alias("n"))
    counted = texts.groupBy("_q_line").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    return counted.where((F.col("n") > rules.min_documents) & (F.col("texts") > rules.min_texts)).select("_q_line", "n")


def _above_limits(rows: DataFrame, rules: QualityRules) -> DataFrame:
    """``_q_copy, _q_gone, _q_bad``: of texts with lines above the limits, these lines' words and keys."""
    above = cut(boilerplate(rows, rules))
    held = rows.select("_q_copy", F.posexplode("_q_lines").alias("_q_at", "_q_l")).select("_q_copy", "_q_at", F.col("_q_l.k").alias("_q_line"), F.col("_q_l.n").alias("_q_n"))
    held = held.join(F.broadcast(above.drop("n")), "_q_line") if above.count() <= BROADCAST_LINES else spread_join(held, above, "_q_line")
    # Copies have the same lines at the same places.
    once = held.groupBy("_q_copy", "_q_at").agg(F.min("_q_line").alias("_q_line"), F.min("_q_n").alias("_q_n"))
    return once.groupBy("_q_copy").agg(F.sum("_q_n").alias("_q_gone"), F.collect_set("_q_line").alias("_q_bad"))


def judge(docs: DataFrame, rules: QualityRules = RULES, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with the measures, ``_q_left`` (words outside boilerplate), ``_q_text`` (the text without its boilerplate lines) and ``_q_kept``.

    Only small rows of line keys meet the lines above the limits. What they find
    for a text is broadcast up to ``BROADCAST_LINES`` lines, and beyond that
    meets the measures in a shuffle by copies, which takes the texts along only
    where ``_q_text`` is used.
    """
    rows = cut(line_rows(docs, text, host))
    bad = cut(_above_limits(rows, rules))
    if (bad.agg(F.count("*") + F.sum(F.size("_q_bad"))).first()[0] or 0) <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    joined = measures(docs, rules, text).withColumn("_q_copy", _copy(text, host)).join(bad, "_q_copy", "left").drop("_q_copy")
    kept = ~F.col("_q_base_failed") & (F.col("_q_left") >= rules.min_words) & (F.col("_q_left") >= F.lit(rules.min_left) * F.col("_q_n_words"))
    # Exploding one verdict keeps a filter on it above: pushed down, it would repeat the measures within one another.
    out = joined.withColumn("_q_left", F.col("_q_n_words") - F.coalesce("_q_gone", F.lit(0))).withColumn("_q_kept", F.explode(F.array(kept)))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rest = F.array_join(F.filter(lines, lambda s: ~(s.rlike(WORD) & F.array_contains("_q_bad", _host_line(s, host)))), "\n")
    return out.withColumn("_q_text", F.when(F.col("_q_bad").isNotNull(), rest).otherwise(F.col(text))).drop("_q_bad", "_q_gone")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document; the host is ``source``."""
    d = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select(
        "doc_id",
        F.col("_q_n_words").alias("n_words"),
        F.col("_q_word_chars").alias("word_chars"),
        F.col("_q_n_symbols").alias("n_symbols"),
        F.col("_q_n_dup_lines").alias("n_dup_lines"),
        F.col("_q_n_repeat_words").alias("n_repeat_words"),
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_left").alias("n_words_left"),
        F.col("_q_kept").alias("kept"),
    )


OP3_SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
pos as (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8),
win as (select rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') as g from pos),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, sum(least(8, i - coalesce(prev, i - 8))) as n from
  (select rid, i, lag(i) over (partition by rid order by i) as prev from dup) group by rid),
ln as (select rid, source, text, unnest(string_split(text, chr(10))) as line from d),
lw as (select rid, source, text, line,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n,
    regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') as k
  from ln),
lx as (select * from lw where n > 0),
dl as (select rid, count(*) - count(distinct line) as n from lx group by rid),
bad as (select source, k from lx group by source, k having count(distinct rid) > 20 and count(distinct text) > 5),
gone as (select rid, sum(n) as n from lx join bad on lx.source is not distinct from bad.source and lx.k = bad.k group by rid),
m as (select d.rid, doc_id, len(ws)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dl.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
    (len(ws) - coalesce(gone.n, 0))::bigint as n_words_left
  from d join w using (rid) left join dl using (rid) left join cov using (rid) left join gone using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left,
  not base_failed and n_words_left >= 20 and n_words_left >= 0.3::double * n_words as kept
from b
"""
