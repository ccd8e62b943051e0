"""Maximum inner product search: partitions, score-aware product quantisation, exact reranking.

Vectors are dealt to the nearest of k-means cells and their residuals are coded
with 4 bits for every two dimensions. The codebooks are fitted with the
anisotropic loss: the error along the vector counts more than the error across
it, because it changes large inner products more. A query looks into the cells
with the largest inner products, adds up table entries for the codes, and the
candidates with the best sums are scored again exactly on the original vectors,
as are all whose coding error doesn't rule them out.
How many cells it looks into is measured for some of the queries on the sample
and the longest vectors: as few as hold ``coverage`` of the nearest neighbours there.

The index stays where it is: a cell's codes and vectors go to one task (a large
cell's to several), queries are sent to the cells that they look into and stream
past in batches, so a task holds ``block_rows`` rows and one batch, whatever the
number of queries.

Equal vectors are one class: only its ``k`` + 1 least ids can be among the
nearest ``k`` (ties go to the lesser id), so the other copies needn't be
searched, and the answer is as if they were. Every class is indexed.

Defined cases: vectors that are null, all zero, or hold null or non-finite
components take no part, as queries or candidates; a query compares only with
candidates of its own length; fewer than ``k`` candidates give all that lie in
the cells looked into, and all cells are looked into while the table holds
``min_rows`` rows or less; null ids take no part; rows that repeat an id with one
vector count once, and an id with different vectors counts with each; a query's
own id is never among its candidates; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, sample, small_batches, table


@dataclass(frozen=True)
class AnnParams:
    """Cells and codebooks are fitted on ``sample`` vectors, or as many as give each cell 16 of them where that is more, ``most_sample`` at
    most; every vector is indexed. There are about sqrt(rows) / ``root_share`` cells; a cell of more than ``block_rows`` rows takes several blocks. The number of cells that a query looks into is measured for
    ``asked`` queries on the sample and the ``longest`` vectors. ``rerank`` candidates per query and block are scored exactly, then all that their errors don't rule out. Beyond ``block_queries`` queries a
    block is held by several tasks, which bounds how long one works."""

    k: int = 20
    sample: int = 8192
    most_sample: int = 500_000
    root_share: float = 3.0
    min_rows: int = 64
    coverage: float = 0.95
    longest: int = 2048
    asked: int = 512
    rerank: int = 64
    block_rows: int = 8192
    block_queries: int = 2_000_000
    batch_queries: int = 256
    parallel_weight: float = 4.0
    iterations: int = 6
    seed: int = 5


PARAMS = AnnParams()


@dataclass(frozen=True)
class Codebook:
    """Cell centres and, for each pair of dimensions, 16 points."""

    centres: np.ndarray  # cells x d
    points: np.ndarray  # pairs x 16 x 2

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)).argmax(axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x pairs). Starting from the nearest points, each pair in turn takes the point with the least
        anisotropic loss |e|^2 + (eta - 1) (e . u)^2, with u the direction of the vector and e the whole error."""
        r = _pairs(x - self.centres[cell])
        u = _pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
        m = len(self.points)
        e2 = ((r[:, :, None, :] - self.points[None]) ** 2).sum(axis=3)  # rows, pairs, 16
        along = ((r[:, :, None, :] - self.points[None]) * u[:, :, None, :]).sum(axis=3)
        code = e2.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[rows, j, code[:, j]]
                best = (e2[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
                total = rest + along[rows, j, best]
                code[:, j] = best
        return code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries' pairs with the points, for two codes (a byte) at a time: bytes x 256 x queries."""
        t = np.einsum("qmd,mkd->mkq", _pairs(q), self.points).astype(np.float32)
        if len(t) % 2:
            t = np.concatenate([t, np.zeros_like(t[:1])])
        return (t[0::2, None, :, :] + t[1::2, :, None, :]).reshape(len(t) // 2, 256, -1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What packed codes stand for, beside their cell's centre: rows x d."""
        code = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, : len(self.points)]
        return self.points[np.arange(len(self.points))[None], code].reshape(len(codes), -1)[:, : self.centres.shape[1]]

    def scan(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Sums of table entries, rows x queries. ``codes`` are rows x bytes. A cell's own centre adds the same to all its rows."""
        out = np.take(tables[0], codes[:, 0], axis=0)
        for j in range(1, codes.shape[1]):
            out += np.take(tables[j], codes[:, j], axis=0)
        return out


def _pairs(x: np.ndarray) -> np.ndarray:
    """Rows as pairs of dimensions; an odd last one gets a zero beside it."""
    if x.shape[1] % 2:
        x = np.pad(x, ((0, 0), (0, 1)))
    return x.reshape(len(x), -1, 2)


def fit(x: np.ndarray, cells: int, p: AnnParams = PARAMS) -> Codebook:
    """Fit on a bounded sample: k-means cells, then codebooks by turns of anisotropic coding and weighted least squares."""
    rng = np.random.default_rng(p.seed)
    x = np.asarray(x, dtype=np.float64)
    cells = max(1, min(cells, len(x)))
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(p.iterations):
        at = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        n = np.bincount(at, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    at = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
    r = _pairs(x - centres[at])
    u = _pairs(x / np.linalg.norm(x, axis=1, keepdims=True))
    m = r.shape[1]
    points = np.stack([r[rng.choice(len(r), 16, replace=len(r) < 16), j] + rng.normal(0, 1e-6, (16, 2)) for j in range(m)])
    for _ in range(p.iterations):
        book = Codebook(centres, points)
        code = book.encode(x, at, p.parallel_weight)
        for j in range(m):
            # Least squares with the weight matrix I + (eta - 1) u u' of each row, the other pairs' error left as it is.
            w = np.eye(2) + (p.parallel_weight - 1) * u[:, j, :, None] * u[:, j, None, :]
            chosen = points[np.arange(m)[None], code]
            other = ((r - chosen) * u).sum(axis=(1, 2)) - ((r[:, j] - chosen[:, j]) * u[:, j]).sum(axis=1)
            target = np.einsum("nab,nb->na", w, r[:, j]) + (p.parallel_weight - 1) * other[:, None] * u[:, j]
            for k in range(16):
                rows = code[:, j] == k
                if rows.any():
                    points[j, k] = np.linalg.solve(w[rows].sum(axis=0) + 1e-9 * np.eye(2), target[rows].sum(axis=0))
    return Codebook(centres, points)


def probes_needed(x: np.ndarray, book: Codebook, p: AnnParams = PARAMS, q: np.ndarray | None = None) -> int:
    """The least number of cells that hold ``coverage`` of the ``k`` nearest in the sample ``x`` of queries ``q`` (or of some of its own rows); a query's own vector doesn't count.

    Of a larger table the nearest lie nearer, in cells that come earlier, so the sample asks for rather too many."""
    q = x[:: max(1, len(x) // 256)] if q is None else q
    own = {r.tobytes(): i for i, r in enumerate(x)}
    score = q @ x.T
    for i, r in enumerate(q):
        if r.tobytes() in own:
            score[i, own[r.tobytes()]] = -np.inf
    k = max(1, min(p.k, len(x) - 1))
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ book.centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(q), 0), 1)
    at = np.sort(np.take_along_axis(place, book.cells_of(x)[best], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(p.coverage * len(at))))]) + 1


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, as they are stored."""
    v = F.col("v")
    ok = (
        F.col("vec_id").isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("v").isNotNull()).where(ok)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: each vector with the ``k`` + 1 least of its ids. A task passes on ``k`` + 1 rows of a vector at most."""
    once = rows.groupBy("vec_id", "v").agg(F.lit(1).alias("one")).withColumn("h", F.xxhash64("v"))
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    least = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return least.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "ids")


def search(vectors: DataFrame, is_query, p: AnnParams = PARAMS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest ``k`` of every query. ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    small_batches(spark, 4)
    rows = valid(vectors)
    classes = cut(classes_of(rows, p.k))
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row for each length of vectors
    out = None
    for r in sizes:
        one = _search_dimension(classes.where(F.size("v") == r["d"]), rows.where(is_query & (F.size("v") == r["d"])), r["n"], p)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def codebook(classes: DataFrame, n: int, p: AnnParams, queries: DataFrame | None = None) -> tuple[Codebook, int]:
    """The codebook fitted on the sample, and the number of cells that a query looks into.

    That number is measured for ``queries``, where they are given, on the sample and the longest vectors of all: these have the largest inner
    products, and a sample holds few of them."""
    wanted = min(p.most_sample, max(p.sample, round(16 * n**0.5 / p.root_share)))
    rows = lambda d: np.array([r["v"] for r in d.select("v").collect()], dtype=np.float64)
    x = rows(sample(classes, n, wanted, F.element_at("ids", 1), "v", seed="ann"))
    cells = 1 if n <= p.min_rows else max(1, min(len(x) // 16, round(n**0.5 / p.root_share)))
    book = fit(x, cells, p)
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    longest = rows(classes.orderBy(F.desc(length), F.element_at("ids", 1)).limit(p.longest))
    asked = None if queries is None else rows(sample(queries, queries.count(), p.asked, "id", "v", seed="asked"))
    return book, probes_needed(np.unique(np.vstack([x, longest]), axis=0), book, p, asked if asked is not None and len(asked) else None)


def _search_dimension(classes: DataFrame, queries: DataFrame, n: int, p: AnnParams) -> DataFrame:
    q = queries.select(F.col("vec_id").alias("id"), "v").distinct()
    fitted, probes = codebook(classes, n, p, q)
    book = classes.sparkSession.sparkContext.broadcast(fitted)
    kind = classes.schema["v"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebook = book.value
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                cell = b.cells_of(v)
                codes = [_pack(c) for c in b.encode(v, cell, p.parallel_weight)]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(codes, pa.binary()), *batch.columns], names=["cell", "codes", "v", "ids"])

    fields = [T.StructField("v", kind), T.StructField("ids", T.ArrayType(T.LongType()))]
    index = cut(classes.select("v", "ids").mapInArrow(encode, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType()), *fields])))
    per_cell = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    # Blocks: a cell of more than block_rows rows takes several. first is a cell's first block, parts their number.
    parts = np.zeros(len(fitted.centres), dtype=np.int64)
    for c, m in per_cell.items():
        parts[c] = -(-m // p.block_rows)
    first = np.cumsum(parts) - parts
    blocks = classes.sparkSession.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in per_cell], "cell int, first int, parts int")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebook = book.value
        for batch in batches:
            if batch.num_rows:
                cell = np.argsort(-(_matrix(batch.column(1)) @ b.centres.T), axis=1, kind="stable")[:, :probes]
                met = [np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in row]).astype(np.int32) for row in cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, pa.list_(pa.int32()))], names=["id", "v", "blocks"])

    turns = max(1, -(-q.count() // p.block_queries))
    left = index.join(F.broadcast(blocks), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("parts"))).cast("int")).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "v", "codes", "ids"
    )
    routed = q.mapInArrow(route, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", kind), T.StructField("blocks", T.ArrayType(T.IntegerType()))]))
    right = routed.select(
        F.explode("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<long>").alias("ids")
    )
    dealt = left.unionByName(right).repartition("block", "turn").sortWithinPartitions("block", "turn", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: those of a block, then its queries."""
        here, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.r_[0, np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1, batch.num_rows] if batch.num_rows else np.zeros(1, dtype=int)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if tuple(key[:2, lo]) != here:
                    here, held, block = tuple(key[:2, lo]), [], None
                if key[2, lo] == 0:
                    held.append((_matrix(part.column(4)), np.stack([np.frombuffer(c, dtype=np.uint8) for c in part.column(5).to_pylist()]), part.column(6).to_pylist()))
                elif held:
                    if block is None:
                        block = _block(held, book.value)
                    for at in range(0, part.num_rows, p.batch_queries):
                        few = part.slice(at, p.batch_queries)
                        yield _nearest(block, few.column(3).to_numpy(), _matrix(few.column(4)), book.value, p)

    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _block(held: list[tuple], book: Codebook) -> tuple:
    """Vectors, codes and ids of a block, a centre, and how far each row lies from what its code stands for (with what single precision adds to that)."""
    v, codes, ids = np.vstack([h[0] for h in held]), np.vstack([h[1] for h in held]), [i for h in held for i in h[2]]
    centre = book.centres[book.cells_of(v[:1])[0]]
    near = book.decode(codes)
    error = np.linalg.norm(v - centre - near, axis=1) + codes.shape[1] * 2e-7 * np.linalg.norm(near, axis=1) + 1e-12 * np.linalg.norm(v, axis=1)
    return v, codes, ids, centre, error


def _nearest(block: tuple, qid: np.ndarray, q: np.ndarray, book: Codebook, p: AnnParams) -> pa.RecordBatch:
    """The nearest ``k`` of a block for each query: a table scan of the codes, then exact scores.

    The best sums are scored first. The last of the ``k`` + 1 best so far bounds the rest: a row whose sum and error can't reach it
    needs no score. So rows that share a code, or are coded badly, aren't lost.
    """
    v, codes, ids, centre, error = block
    reach = np.linalg.norm(q, axis=1)
    if max(p.rerank, p.k + 1) < len(v):
        # All rows of a block lie in one cell, so what the centre adds doesn't change their order.
        rough = book.scan(codes, book.tables(q)).T
        best = np.argpartition(-rough, max(p.rerank, p.k + 1) - 1, axis=1)[:, : max(p.rerank, p.k + 1)]
        last = np.partition(np.einsum("qrd,qd->qr", v[best], q), -(p.k + 1), axis=1)[:, -(p.k + 1)]
        may = ~(rough + (q @ centre - last)[:, None] + reach[:, None] * error < 0)
    else:
        may = np.ones((len(q), len(v)), dtype=bool)
    if may.mean() > 1 / 32:
        exact = np.where(may, q @ v.T, -np.inf)
    else:
        at_q, at_c = np.nonzero(may)
        exact = np.full(may.shape, -np.inf)
        exact[at_q, at_c] = np.einsum("nd,nd->n", v[at_c], q[at_q])
    # Classes below the k + 1 best can't be among the k nearest; what a product rounds differently is left to the scores themselves.
    if len(v) > p.k + 1:
        last = np.partition(exact, -(p.k + 1), axis=1)[:, -(p.k + 1)]
        may &= exact >= (last - 1e-12 * reach * np.linalg.norm(v, axis=1).max())[:, None]
    at_q, row = np.nonzero(may)
    score = np.einsum("nd,nd->n", v[row], q[at_q])
    n = np.array([len(i) for i in ids])[row]
    if (n > 1).any():
        cand = np.array([x for j in row for x in ids[j]], dtype=np.int64)
    else:
        cand = np.array([i[0] for i in ids], dtype=np.int64)[row]
    asked, score = np.repeat(qid[at_q], n), np.repeat(score, n)
    other = cand != asked
    return pa.RecordBatch.from_arrays([pa.array(c[other]) for c in (asked, cand, score)], names=["query_id", "vec_id", "score"])


def _pack(codes: np.ndarray) -> bytes:
    """Two 4-bit codes a byte."""
    if len(codes) % 2:
        codes = np.append(codes, 0)
    return (codes[0::2] | (codes[1::2] << 4)).astype(np.uint8).tobytes()


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, among all rows."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
