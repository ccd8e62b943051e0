"""Random forest over grid features, with balanced classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.operators.selection import median
from orestrata.operators.terrain import confusion, report_of
from orestrata.session import checkpointed

COLUMNS = ("slope_deg", "aspect_deg", "edge_density", "dist_m")

#: Rows times trees of one fit in a cross-validation: up to 5 GB on the cluster, as bootstrap counts and node ids take up to 16 bytes each.
BAGGED = 300_000_000


def finite(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def train(rows: DataFrame, columns=COLUMNS, trees: int = 300, depth: int = 30, seed: int = 42, **params) -> RandomForestClassificationModel | None:
    """Fit on rows whose features are finite; classes weigh alike. None if a class is missing. ``params`` are Spark's for the forest."""
    d = rows.where(finite(columns))
    n = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}  # two rows
    if len(n) < 2:
        return None
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))
    x = VectorAssembler(inputCols=list(columns), outputCol="features").transform(d.withColumn("w", weight))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, weightCol="w", **params).fit(x)


def importances(model: RandomForestClassificationModel, columns=COLUMNS) -> list[tuple[str, float]]:
    return sorted(zip(columns, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: x[1])


def medians(rows: DataFrame, columns=COLUMNS) -> dict[str, float]:
    """The median of each column over what is neither null nor NaN; 0 for a column without any."""
    return {c: median(rows, c) or 0.0 for c in columns}


def imputed(rows: DataFrame, columns, keep) -> DataFrame:
    """``keep`` and ``features``; those that are not finite become their column's median, which is looked for in those columns alone that need one."""
    holes = rows.agg(*[F.count_if(~finite([c])).alias(c) for c in columns]).first()  # one row
    m = medians(rows, [c for c in columns if holes[c]])
    d = rows.select(*keep, *[F.when(finite([c]), F.col(c)).otherwise(m[c]).alias(c) if c in m else F.col(c) for c in columns])
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(d)


def score(model: RandomForestClassificationModel | None, rows: DataFrame, columns=COLUMNS, keep=("row_id", "col_id")) -> DataFrame:
    """``keep`` and ``proba``; features that are not finite become their column's median. Without a model: null. ``rows`` is read several times."""
    if model is None:
        return rows.select(*keep, F.lit(None).cast("double").alias("proba"))
    return model.transform(imputed(rows, columns, keep)).select(*keep, vector_to_array("probability")[1].alias("proba"))


def in_fold(blocked: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a fold: a row is tested in the fold of its block. The blocks are few and broadcast."""
    own = F.broadcast(folds.where(F.col("fold") == fold).select("block_id"))
    return blocked.join(own, "block_id", "left_anti"), blocked.join(own, "block_id", "left_semi")


def spatial_cv(rows: DataFrame, folds: DataFrame, k: int = 5, columns=COLUMNS, trees: int = 300, depth: int = 30, seed: int = 42, bins: int = 256, bagged: int = BAGGED) -> DataFrame:
    """``fold, label, precision, recall, f1, support``: for each fold of blocks a forest fitted on the others and tested on it.

    ``rows`` has ``label`` (0 or 1), ``block_id`` and the features. Classes weigh
    alike and are not filled up; a fold without training or test rows, or whose
    training rows are of one class, is left out. One job after another trains
    the ``k`` models; each is a distributed fit. ``rows`` is read many times, by as
    many tasks as it has partitions; the folds are written once, and of a fold's
    predictions only the counts are kept.

    A forest has ``trees`` trees, each fitted on all training rows. It is fitted in
    parts of trees that keep rows times trees within ``bagged``, and a test
    row's votes are summed over them: the trees of a forest don't depend on each
    other, and what a fit holds then doesn't grow with the table. Features are cut
    at ``bins`` quantiles.
    """
    spark, out, folds = rows.sparkSession, None, checkpointed(folds)
    some = math.ceil(trees / max(1, math.ceil(rows.count() * trees / bagged)))
    for fold in range(1, k + 1):
        training, tested = in_fold(rows, folds, fold)
        if tested.isEmpty():
            continue
        votes = None
        for at in range(0, trees, some):
            n = min(some, trees - at)
            model = train(training, columns, n, depth, seed + at, maxBins=bins, cacheNodeIds=True, checkpointInterval=-1)
            if model is None:
                break
            if votes is None:
                votes = imputed(tested, columns, ["label"]).select("label", "features", F.lit(0.0).alias("votes"))
            votes = checkpointed(model.transform(votes).select("label", "features", (F.col("votes") + n * vector_to_array("probability")[1]).alias("votes")))
        if votes is None:
            continue
        said = votes.select("label", (F.col("votes") > trees / 2).cast("int").alias("said"))
        report = report_of(checkpointed(confusion(said, "label", "said")))
        one = report.withColumn("fold", F.lit(fold)).select("fold", "label", "precision", "recall", "f1", "support")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "fold int, label int, precision double, recall double, f1 double, support long")


class Cells:
    """A k-d tree over a bounded sample of rows: which cell of feature space a row lies in. Any tree gives exact neighbours; the sample makes cells alike in size."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis, self.edge = np.zeros(1 << self.depth, dtype=int), np.zeros(1 << self.depth)

        def split(node: int, rows: np.ndarray) -> None:
            if node >= 1 << self.depth:
                return
            if len(rows):
                self.axis[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                self.edge[node] = float(np.median(rows[:, self.axis[node]]))
            right = rows[:, self.axis[node]] > self.edge[node]
            split(2 * node, rows[~right])
            split(2 * node + 1, rows[right])

        split(1, sample)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.edge[node])
        return node - (1 << self.depth)


def _nearest(x: np.ndarray, y: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and squared distance of the ``k`` nearest of y for each of x, some rows of x at a time. ``itself``: x and y are the same rows."""
    parts = []
    for at in range(0, len(x), 512):
        some = x[at : at + 512]
        apart = sum((some[:, c, None] - y[None, :, c]) ** 2 for c in range(x.shape[1]))
        if itself:
            apart[np.arange(len(some)), np.arange(at, at + len(some))] = np.inf
        near = np.argsort(apart, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(some)), near.shape[1])
        parts.append((i + at, near.ravel(), apart[i, near.ravel()]))
    i, j, d = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, dtype=int),) * 3
    return i[np.isfinite(d)], j[np.isfinite(d)], d[np.isfinite(d)]


def neighbours(members: DataFrame, columns, key, k: int, bucket_rows: int = 2000, sample_rows: int = 20_000) -> DataFrame:
    """``_bucket`` (its cell), ``key``, ``columns``, and ``_apart`` and ``_o_`` columns of each of the ``k`` nearest rows, exactly.

    Rows are dealt into cells of feature space of about ``bucket_rows``; cells that hold more, as of equal rows, are dealt on by ``key``. A row is compared with its
    own cell first. The distance of its k-th neighbour there bounds the search: only cells whose box lies nearer are looked into, and many rows that look into one cell
    are dealt into parts. What is sent to all tasks is the tree and the boxes, a few numbers for each ``bucket_rows`` rows; ``sample_rows`` bounds the tree's sample.
    """
    spark, cols, keys = members.sparkSession, list(columns), list(key)
    others, okeys = [f"_o_{c}" for c in cols], [f"_k_{c}" for c in keys]
    n = members.count()
    sample = members.orderBy(F.xxhash64(*keys)).limit(sample_rows).select(*cols).toPandas().to_numpy(dtype=float).reshape(-1, len(cols))
    tree = spark.sparkContext.broadcast(Cells(sample, -(-n // bucket_rows)))
    base = members.select(*cols, *keys)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_cell=tree.value.of(b[cols].to_numpy(dtype=float)))

    kind = lambda d, names: [T.StructField(c, d.schema[c].dataType) for c in names]
    rows = base.mapInPandas(placed, T.StructType([*kind(base, base.columns), T.StructField("_cell", T.LongType())]))
    sizes = rows.groupBy("_cell").agg(F.ceil(F.count("*") / bucket_rows).alias("_parts"))
    part = F.pmod(F.xxhash64(*keys), F.col("_parts"))
    rows = checkpointed(rows.join(sizes, "_cell").withColumn("_bucket", F.xxhash64("_cell", part)).drop("_cell", "_parts"))
    found = T.StructType([T.StructField("_bucket", T.LongType()), *kind(base, [*cols, *keys]), T.StructField("_apart", T.DoubleType()), *[T.StructField(o, T.DoubleType()) for o in others], *[T.StructField(o, base.schema[c].dataType) for o, c in zip(okeys, keys)]])

    def told(own: pd.DataFrame, other: pd.DataFrame, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pd.DataFrame:
        out = own.iloc[i][["_bucket", *cols, *keys]].reset_index(drop=True)
        out["_apart"] = d
        out[others] = other[cols].to_numpy(dtype=float)[j]
        for o, c in zip(okeys, keys):
            out[o] = other[c].to_numpy()[j]
        return out[found.names]

    def within(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(keys)
        x = cell[cols].to_numpy(dtype=float)
        return told(cell, cell, *_nearest(x, x, k, True))

    own = checkpointed(rows.groupBy("_bucket").applyInPandas(within, found))
    boxes = rows.groupBy("_bucket").agg(*[f(c).alias(f"{m}_{c}") for c in cols for m, f in (("lo", F.min), ("hi", F.max))]).toPandas()  # one row for each ``bucket_rows``
    edges = spark.sparkContext.broadcast((boxes["_bucket"].to_numpy(), *[boxes[[f"{m}_{c}" for c in cols]].to_numpy(dtype=float) for m in ("lo", "hi")]))
    kth = own.groupBy("_bucket", *keys).agg(F.when(F.count("*") >= k, F.max("_apart")).alias("_bound"))
    search = rows.join(kth, ["_bucket", *keys], "left").select("_bucket", *cols, *keys, F.coalesce("_bound", F.lit(float("inf"))).alias("_bound"))
    visit = T.StructType([*search.schema.fields, T.StructField("_to", T.LongType())])

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, lo, hi = edges.value
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                x = some[cols].to_numpy(dtype=float)
                gap = sum(np.maximum(0, np.maximum(lo[None, :, c] - x[:, c, None], x[:, c, None] - hi[None, :, c])) ** 2 for c in range(len(cols)))
                i, j = np.nonzero((gap < some["_bound"].to_numpy()[:, None]) & (some["_bucket"].to_numpy()[:, None] != name[None, :]))
                yield some.iloc[i].assign(_to=name[j])[visit.names]

    going = search.mapInPandas(visits, visit)
    crowds = going.groupBy("_to").agg(F.ceil(F.count("*") / (8 * bucket_rows)).alias("_crowds"))
    going = going.join(crowds, "_to").withColumn("_crowd", F.pmod(F.xxhash64(*keys), F.col("_crowds"))).drop("_crowds")
    hosts = rows.withColumnRenamed("_bucket", "_to").join(crowds, "_to").withColumn("_crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_crowds") - 1))).drop("_crowds")

    def across(guests: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if guests.empty or cell.empty:
            return pd.DataFrame({c: [] for c in found.names})
        cell = cell.sort_values(keys)
        return told(guests, cell, *_nearest(guests[cols].to_numpy(dtype=float), cell[cols].to_numpy(dtype=float), k, False))

    far = going.groupBy("_to", "_crowd").cogroup(hosts.groupBy("_to", "_crowd")).applyInPandas(across, found)
    order = Window.partitionBy("_bucket", *keys).orderBy("_apart", *okeys)
    return own.unionByName(far).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop(*okeys)


def smote(rows: DataFrame, columns=COLUMNS, key=("row_id", "col_id"), k: int = 5, bucket_rows: int = 2000, seed: int = 42) -> DataFrame:
    """``columns`` and ``label`` of all rows with finite features, and new rows of the rarer class until both are as many.

    A new row lies between a row and one of its ``k`` nearest of the whole class (:func:`neighbours`). Each cell makes as many as its rows ask for. With fewer than
    two rows of a class nothing is added.
    """
    d = rows.where(finite(columns)).withColumn("label", F.col("label").cast("int"))
    kept = d.select(*columns, "label")
    n = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}  # two rows
    if len(n) < 2 or min(n.values()) < 2 or len(set(n.values())) < 2:
        return kept
    rare = min(n, key=n.get)
    few, need = n[rare], max(n.values()) - n[rare]
    cols, others = list(columns), [f"_o_{c}" for c in columns]
    members = checkpointed(d.where(F.col("label") == rare).select(*[F.col(c).cast("double").alias(c) for c in columns], *key))
    near = checkpointed(neighbours(members, columns, key, k, bucket_rows))
    end = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))  # a row a cell
    share = lambda at: F.floor(at * need / F.lit(few))
    wanted = near.where("_nth = 1").groupBy("_bucket").agg(F.count("*").alias("_size")).withColumn("_end", end).select("_bucket", (share(F.col("_end")) - share(F.col("_end") - F.col("_size"))).alias("_want"))

    def between(bucket: pd.DataFrame) -> pd.DataFrame:
        b = bucket.sort_values([*key, "_nth"])
        x, y, want = b[cols].to_numpy(dtype=float), b[others].to_numpy(dtype=float), int(b["_want"].iloc[0])
        first = np.flatnonzero(b["_nth"].to_numpy() == 1)
        count = np.diff([*first, len(b)])
        rng = np.random.default_rng([seed, int(b["_bucket"].iloc[0]) & ((1 << 63) - 1)])
        base = rng.integers(len(first), size=want)
        pick = first[base] + rng.integers(count[base])
        out = pd.DataFrame(x[pick] + rng.random((want, 1)) * (y[pick] - x[pick]), columns=cols)
        return out.assign(label=rare)

    new = near.join(wanted, "_bucket").groupBy("_bucket").applyInPandas(between, ", ".join(f"{c} double" for c in columns) + ", label int")
    return kept.unionByName(new)
