"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through BK-trees.

A fingerprint votes over the XXH64 of all word shingles of a whole text. Distinct
fingerprints are dealt into shards that any two fingerprints within the radius
share at least once: two differing bits leave one third of the 64 bits alike, so
each third's value is a key. A shard's BK-tree is built in the task that holds
the shard, and every member looks for its neighbours along the edges within the
radius. The trees of all fingerprints have no size bound, so they aren't
broadcast. Shards above ``shard_rows`` fingerprints are dealt again by thirds of
the bits that aren't fixed yet, until at most 2^14 fingerprints can share a key,
so no shard is unbounded and none is skipped.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle; ties of a bit (half
of the shingles) give 0; repeated rows and ids are returned as often as they
come; documents whose id is null belong to a component but never name it
(a component of null ids alone has a null component_id); an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, small_batches, spread_join, table
from orestrata.llm.components import components

#: Shingles summed at a time, so that one very long text needs bounded memory.
_BLOCK = 1 << 16
#: How often bits are dealt in thirds: 64 bits leave 42, 28, 18 and then 12 open.
_DEPTHS = 4


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    ws = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not ws:
        return 0
    if len(ws) < width:
        ws = [b" ".join(ws)]
    n = max(1, len(ws) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        part = ws[at : at + _BLOCK + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(ws) >= width else part
        h = np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def find(self, x: int, radius: int) -> list[int]:
        if not self.values:
            return []
        found, stack = [], [0]
        values, children = self.values, self.children
        while stack:
            i = stack.pop()
            d = (values[i] ^ x).bit_count()
            if d <= radius:
                found.append(i)
            for k, child in children[i].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return found

    def add(self, x: int) -> None:
        at = len(self.values)
        self.values.append(x)
        self.children.append({})
        if not at:
            return
        i = 0
        while True:
            d = (self.values[i] ^ x).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = at
                return
            i = self.children[i][d]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within the radius, directly or by steps, inside one shard: (value, least of its group)."""
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    tree = BKTree()
    for i, x in enumerate(values):
        for k in tree.find(x, radius):
            a, b = root(i), root(k)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(x)
    return [(x, values[root(i)]) for i, x in enumerate(values) if root(i) != i]


def _thirds(free: list[int]) -> list[list[int]]:
    k = -(-len(free) // 3)
    return [free[:k], free[k : 2 * k], free[2 * k :]]


def _free_bits(path: int, depth: int) -> list[int]:
    """The bits, lowest first, that a path leaves open. A path's digits in base 3 are the thirds chosen, the last one last."""
    free = list(range(64))
    for k in reversed(range(depth)):
        chosen = set(_thirds(free)[path // 3**k % 3])
        free = [b for b in free if b not in chosen]
    return free


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    """Three rows for each of ``rows`` (``fp, path, key``): the open bits in thirds, one of which two fingerprints with two differing bits share."""
    out = None
    for c in range(3):
        # The values of the chosen bits, by path; xxhash64 makes them a part of the key.
        masks = {p: sum(1 << b for b in _thirds(_free_bits(p, depth))[c]) for p in range(3**depth)}
        mask = F.element_at(F.create_map(*[F.lit(x) for p, m in masks.items() for x in (p, m - (1 << 64) if m >= 1 << 63 else m)]), F.col("path"))
        one = rows.select("fp", (F.col("path") * 3 + c).alias("path"), F.xxhash64("key", F.col("fp").bitwiseAND(mask)).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def links(fps: DataFrame, radius: int = 2, shard_rows: int = 2048) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (``fp``) that give all pairs within the radius the same component."""
    if radius > 2:
        raise ValueError("the keys cover two differing bits at most")
    small_batches(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on in the next batch."""
        rest: tuple[np.ndarray, np.ndarray, np.ndarray] = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))

        def of(path, key, fp) -> pa.RecordBatch:
            edge = np.flatnonzero((np.diff(path) != 0) | (np.diff(key) != 0)) + 1
            first, last = np.r_[0, edge], np.r_[edge, len(fp)]
            a, b = [], []
            for i in np.flatnonzero(last - first > 1) if len(fp) else ():
                for x, y in shard_links([int(v) for v in fp[first[i] : last[i]].view(np.uint64)], radius):
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

        for batch in batches:
            path, key, fp = (np.r_[r, batch.column(i).to_numpy(zero_copy_only=False)] for i, r in enumerate(rest))
            if not len(fp):
                continue
            k = np.flatnonzero((path != path[-1]) | (key != key[-1]))
            end = int(k[-1]) + 1 if len(k) else 0
            rest = path[end:], key[end:], fp[end:]
            if end:
                yield of(path[:end], key[:end], fp[:end])
        yield of(*rest)

    out = None
    rows = _dealt(fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")), 0)
    for depth in range(_DEPTHS):
        counts = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        large = cut(counts.where(F.col("n") > shard_rows).select("path", "key"))
        deeper = depth + 1 < _DEPTHS and not large.isEmpty()
        fit = rows.join(large, ["path", "key"], "left_anti") if deeper else rows
        shards = fit.select(F.col("path").cast("long"), "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key", "fp")
        found = shards.mapInArrow(run, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not deeper:
            return out
        rows = _dealt(rows.join(large, ["path", "key"], "left_semi"), depth + 1)
    return out


def fingerprint_groups(by_doc: DataFrame, radius: int = 2) -> DataFrame:
    """``fp, n, root, component_id`` of every distinct fingerprint of ``by_doc`` (``doc_id, fp``), ``n`` of whose rows have it.

    ``root`` is a fingerprint of the group; where an id has several texts, groups can share a ``component_id``.
    """
    groups = by_doc.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(links(groups.select("fp"), radius))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(best, "root").select("fp", "root", "component_id")
    return groups.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near-duplicates stays: that of the least id.

    Where ids repeat or are missing, rows are told apart by their fingerprint as
    well, which takes a second pass over the texts.
    """
    by_doc = cut(fingerprints(docs, width))
    each = cut(fingerprint_groups(by_doc, radius))
    if by_doc.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.join(each.select(F.col("component_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(*docs.columns)
    # The least (id, fingerprint) of each group, null ids last; of its equal rows, any one.
    ranked = spread_join(by_doc.distinct(), each, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("s"))
    stay = ranked.select(F.col("s.doc_id").alias("_s_id"), F.col("s.fp").alias("_s_fp"))
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64))

    rows = docs.withColumn("_s_row", of("text"))
    kept = rows.join(stay, rows["doc_id"].eqNullSafe(stay["_s_id"]) & (rows["_s_row"] == stay["_s_fp"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_s_row"]).select(*docs.columns)


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Only distinct fingerprints are compared, so exact copies meet nowhere; the
    sums over copies combine on the map side, and the rows of a common
    fingerprint are spread over tasks when they get their component.
    """
    by_doc = cut(fingerprints(docs, width))
    each = cut(fingerprint_groups(by_doc, radius))
    return spread_join(by_doc, each, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    d = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
