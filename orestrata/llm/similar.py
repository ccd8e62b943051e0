"""Near copies by the Jaccard similarity of their word shingles: MinHash bands find pairs, the whole texts decide.

A 64-bit fingerprint can't stand for a similarity of 0.8: two such texts differ
in about 10 of its bits, many in more, and shards that hold all pairs so far
apart hold everything. So shards are made by bands of least hashes instead: at
similarity 0.8, two texts share one of 40 bands of 5 with a probability of
1 - 1e-7, and every pair of a shard is then decided by the
exact similarity of both whole texts.

Rows are compared in turns, first by a few bands and then by all. In a turn, shards are dealt into parts of about
``shard_rows`` rows, and the rows of a part are compared with its least row
alone; what is similar to it goes. Texts meet once for each such pair, and only
those that have one. Shards that lose many rows, as groups of copies do, go on
with another turn. Large shards that don't, because their rows have a passage in
common and little else, are dealt again by a second band that two rows share (similar rows do
with a probability of 1 - 1e-5), and at last the few rows that still share a
shard are compared with each other: by sketches inside the join, which let a
similar pair go with a probability of 1e-9 and few others through, then by their texts. So no two rows that stay share a shard and
reach the similarity, and whatever goes is similar to a lesser row.

Defined cases: a null or empty text has one shingle, the empty one; a text of
fewer words than a shingle is one shingle; ids may repeat or be null, null ids
come last; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orestrata.llm.common import cut, small_batches, stored

BANDS, ROWS = 40, 5
#: A sketch holds the low four bits of this many least hashes, 16 in a long.
SKETCHED = 192
#: Bands that the first turns look at.
PEELED = 8
#: Shingles hashed at a time, so that one very long text needs bounded memory.
_BLOCK = 1 << 12
_rng = np.random.default_rng(42)
_ADD, _MUL = (_rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if len(ws) < width:
        ws, width = [b" ".join(ws)], 1
    grams = map(b" ".join, zip(*(ws[i:] for i in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bands(grams: np.ndarray) -> tuple[list[int], list[int]]:
    """One key a band, and the sketch."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), _BLOCK):
        h = (grams[at : at + _BLOCK, None] ^ _ADD) * _MUL
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0))
    parts = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(p.tobytes(), i) - (1 << 63) for i, p in enumerate(parts)]
    low = (least[:SKETCHED] & np.uint64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return keys, np.bitwise_or.reduce(low, axis=1).view(np.int64).tolist()


def sketches_meet(x: str, y: str, least: float):
    """Whether two sketches agree in as many places as texts of similarity ``least`` do, less 6.5 standard deviations."""
    p = least + (1 - least) / 16
    most = SKETCHED - math.floor(SKETCHED * p - 6.5 * math.sqrt(SKETCHED * p * (1 - p)))
    differ = F.lit(0)
    for i in range(SKETCHED // 16):
        d = F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(d)
    return differ <= most


def _one_shard(x: str, y: str):
    """The one shard of those that two rows share in which they are compared: the least of the small ones, or that of the two least large ones."""
    shared = lambda c: F.array_sort(F.array_intersect(f"{x}.{c}", f"{y}.{c}"))
    big = shared("big")
    return F.coalesce(F.get(shared("small"), 0), F.xxhash64(F.get(big, 0), F.get(big, 1)))


def _keys(rows: DataFrame, width: int) -> DataFrame:
    """``id, n`` (shingles), ``keys`` and ``sketch`` of every row of ``id, text``."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sketches = [], [], []
            for x in b.column(1):
                g = shingles(x.as_py(), width)
                n.append(len(g))
                k, s = bands(g)
                keys.append(k)
                sketches.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (keys, sketches)]], names=["id", "n", "keys", "sketch"])

    return rows.mapInArrow(run, "id long, n long, keys array<long>, sketch array<long>")


def _alike(pairs: DataFrame, rows: DataFrame, least: float, width: int, most: int = 1_000_000) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose texts reach the similarity. The text of ``a`` and those of its partners meet in one task, in a stream.

    Up to ``most`` pairs (16 bytes each) go to the texts as a broadcast, so that only texts with a pair are moved."""
    pairs = cut(pairs)
    few = F.broadcast if pairs.count() <= most else lambda d: d
    first = rows.join(few(pairs.select(F.col("a").alias("id")).distinct()), "id").select(F.col("id").alias("a"), F.lit(0).alias("kind"), F.col("id").alias("b"), "text")
    second = rows.join(few(pairs.select("a", F.col("b").alias("id"))), "id").select("a", F.lit(1).alias("kind"), F.col("id").alias("b"), "text")
    met = first.unionByName(second).repartition("a").sortWithinPartitions("a", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for p in batches:
            keep = []
            for kind, text in zip(p.column(1).to_pylist(), p.column(3), strict=True):
                grams = shingles(text.as_py(), width)
                if kind == 0:
                    of = grams
                keep.append(kind == 1 and similarity(of, grams) >= least)
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def _parts(size, shard_rows: int):
    """As many parts as a shard's size asks for, as a power of two, so that shards of like sizes deal their rows alike."""
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.col(size) / shard_rows)))).cast("int")


def one_of_similar(docs: DataFrame, least: float = 0.8, width: int = 5, shard_rows: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of similar texts stays: that of the least id."""
    small_batches(docs.sparkSession)
    docs = stored(docs.withColumn("_j_id", F.monotonically_increasing_id()))
    rows = docs.select(F.col("_j_id").alias("id"), "text")
    order = docs.select(F.col("_j_id").alias("id"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("_j_id").alias("i")).alias("o"))
    keys = cut(_keys(rows, width).join(order, "id"))
    each = keys.select("id", "o", "n", F.posexplode("keys").alias("band", "key"))
    shared = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = cut(each.join(shared, "key", "left_semi"))
    # Groups of copies share nearly all bands, so a few bands peel most of them before all bands are looked at.
    gone, turn, peeled, again, last, now = None, 0, False, True, False, cut(members.where(F.col("band") < PEELED).drop("band"))
    members = members.drop("band")
    left = lambda d: d if gone is None else d.join(gone, "id", "left_anti")
    while True:
        if last:
            members = left(members).join(keys.select("id", *[F.get("sketch", i).alias(f"s{i}") for i in range(SKETCHED // 16)]), "id").join(shards, "id")
            x, y = members.alias("x"), members.alias("y")
            size = F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n")
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.o") < F.col("y.o")) & size & sketches_meet("x", "y", least) & (F.col("x.key") == _one_shard("x", "y"))).select(F.col("x.o").alias("lo"), F.col("x.n").alias("m"), "y.id", "y.n")
        else:
            # Small shards are left to the last join, once most copies are gone.
            few = shard_rows // 4 if peeled else 1
            sizes = now.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > few)
            dealt = cut(now.join(sizes, "key").select("key", "id", "o", "n", F.pmod(F.xxhash64("id", F.lit(turn)), _parts("size", shard_rows)).alias("part")))
            lead = dealt.groupBy("key", "part").agg(F.min(F.struct("o", F.col("n").alias("m"))).alias("lead"))
            pairs = dealt.join(lead, ["key", "part"]).where(F.col("id") != F.col("lead.o.i")).select(F.col("lead.o").alias("lo"), F.col("lead.m").alias("m"), "id", "n")
        near = F.least("m", "n") >= F.lit(least) * F.greatest("m", "n")
        lost = cut(_alike(pairs.where(near).select(F.col("lo.i").alias("a"), F.col("id").alias("b")).distinct(), rows, least, width).select(F.col("b").alias("id")).distinct())
        found = not lost.isEmpty()
        if found:
            gone = lost if gone is None else cut(gone.unionByName(lost).distinct())
        if last:
            break
        turn += 1
        if found:
            # Shards that lost an eighth of their rows or more are mostly copies and go on so.
            of_shard = now.join(lost, "id", "left_semi").groupBy("key").agg(F.count("*").alias("lost"))
            active = of_shard.join(sizes, "key").where((8 * F.col("lost") >= F.col("size")) & (F.col("size") - F.col("lost") > few)).select("key")
            now = cut(now.join(active, "key", "left_semi").join(lost, "id", "left_anti"))
            if not now.isEmpty():
                continue
        if not peeled:
            peeled, rest = True, left(members)
            some = rest.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
            members = now = cut(rest.join(some, "key", "left_semi"))
            continue
        if again:
            here = left(members)
            large = cut(here.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > shard_rows).select("key"))
            listed = here.join(large.withColumn("big", F.lit(True)), "key", "left")
            some = lambda big: F.collect_list(F.when(F.col("big").isNotNull() == big, F.col("key")))
            shards = cut(listed.groupBy("id").agg(some(False).alias("small"), some(True).alias("big")))
        if again and not large.isEmpty():
            # Rows of large shards that are no copies: dealt by this key and each other one that they share with some row.
            wide = here.join(large, "key", "left_semi").join(here.select("id", F.col("key").alias("other")), "id").where("key <> other")
            both = F.xxhash64(F.least("key", "other"), F.greatest("key", "other"))
            wide = wide.select(both.alias("key"), "id", "o", "n").distinct()
            some = wide.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
            now = cut(wide.join(some, "key", "left_semi"))
            members = cut(here.join(large, "key", "left_anti").select(*now.columns)).unionByName(now)
        else:
            last = True
        again = False
    kept = docs if gone is None else docs.join(gone.select(F.col("id").alias("_j_id")).distinct(), "_j_id", "left_anti")
    return kept.drop("_j_id")
